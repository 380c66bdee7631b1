"""Toxicity, quality and language: held-out accuracy, the contract's columns, and edge cases."""

import random
import time
import unicodedata
import zlib

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import common, langid, quality, toxicity  # noqa: E402
from tests.llm import edges  # noqa: E402

SF = "/root/testdata/sf0.01"


def labelled(spark, query, label):
    return query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").collect()


def test_toxicity_held_out(spark):
    rows = labelled(spark, toxicity.query, "toxic")
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_held_out(spark):
    rows = labelled(spark, quality.query, "quality")
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_language_held_out(spark):
    rows = langid.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("query", [toxicity.query, quality.query, langid.query])
def test_edges(spark, tmp_path, query):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    at = edges.sf_dir(spark, tmp_path, documents=edges.documents(spark), labels=labels)
    rows = query(spark, at).collect()
    assert len(rows) == 12 and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    twins = [r for r in rows if r.doc_id == 6]
    assert len(twins) == 2 and twins[0] == twins[1]
    if query is langid.query:
        by = {r.doc_id: r.lang_pred for r in rows if r.doc_id is not None}
        assert [by[i] for i in (1, 2, 3, 7, 9)] == ["und"] * 5 and by[4] == "en"


@pytest.mark.parametrize("query", [toxicity.query, quality.query, langid.query])
def test_nothing_to_learn(spark, tmp_path, query):
    at = edges.sf_dir(spark, tmp_path / "a", documents=edges.documents(spark).where("lang is null"))
    rows = query(spark, at).collect()
    assert len(rows) == 2 and all(r.score == 0.0 for r in rows)
    assert query(spark, edges.sf_dir(spark, tmp_path / "b")).count() == 0


def brute_language(model, text):
    """The score of one text, word by word and gram by gram."""
    langs = model["langs"]
    known, back = ({k: model[f"{n}_rows"][i] for i, k in enumerate(model[n])} for n in ("known", "back"))
    total = np.zeros(len(langs))
    for word in "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split():
        if word in known:
            total += known[word]
            continue
        marked, picked = f"<{word}>", []
        for i in range(len(marked)):
            for k in (4, 3, 2, 1):
                if len(marked[i : i + k]) == k and marked[i : i + k] in back:
                    picked.append(back[marked[i : i + k]])
                    break
        if picked:
            total += np.mean(picked, axis=0)
    k = int(total.argmax())
    return langs[k], float(np.exp(total[k] - total.max()) / np.exp(total - total.max()).sum())


def test_language_by_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("doc_id % 5 > 0"), words=300, grams=400)
    monkeypatch.setattr(langid, "CHUNK", 1000)
    texts = [r.text for r in docs.collect() if r.text] + ["zzqx", "naïve Straße zwölf", "x" * 5000]
    pred, score, known = langid.Scorer(model)([t.encode() for t in texts])
    for t, p, s in zip(texts, pred, score, strict=True):
        assert (p, pytest.approx(s)) == brute_language(model, t)
    assert min(known) >= 0 and max(known) <= 1 and known[-1] == 0


def test_language_bounds(spark):
    """Equal counts and rare languages: each language keeps its share, none is crowded out."""
    name = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:05d}")
    rows = [(" ".join(name(500 * i + j) for j in range(10)), "big") for i in range(500)] + [("kuru malo teni", "rare")] * 3
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit(df, words=1000, grams=500)
    kept = set(model["known"])
    assert {"kuru", "malo", "teni"} <= kept and 800 <= len(kept) <= 1200
    assert langid.Scorer(model)([b"kuru teni malo"])[0] == ["rare"]
    assert langid.fit(df, words=1000, grams=500)["known"] == model["known"]


def test_letters_and_marks():
    assert langid.words_of("½ ² ³ 12 _ ٣".encode()) == []
    assert langid.words_of("हिन्दी में x".encode()) == ["हिन्दी", "में", "x"]


def test_words_of_narrow_and_wide_texts():
    """Texts of ASCII, of 16 bits and of wider characters have the words that the categories give, and of the first two a blank costs about
    as much as a letter."""
    rng = random.Random(3)
    narrow = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    wide = [chr(c) for c in range(0x10000, 0x110000) if unicodedata.category(chr(c))[0] in "LMNS"]
    for pool in (narrow[:128], narrow, narrow[:128] + wide):
        text = "".join(rng.choices(pool, k=20_000) + pool[:1000] + [c + d for c in rng.choices(pool, k=5000) for d in "aé "[: 3 if pool is not narrow[:128] else 1]])
        lowered, split = text.lower(), []
        for i, c in enumerate(lowered):
            kind = unicodedata.category(c)[0]
            if kind in "LM" and i and inside:
                split[-1] += c
            elif kind == "L":
                split.append(c)
            inside = kind == "L" or kind == "M" and i > 0 and inside
        assert langid.words_of(text.encode()) == split

    def cost(text):
        langid.words_of(text)
        took = []
        for _ in range(5):
            began = time.process_time()
            langid.words_of(text)
            took.append(time.process_time() - began)
        return min(took)

    for c in ("a", "é"):
        assert cost(b"  " * 200_000 + c.encode()) < 10 * cost(c.encode() * 400_000)


def test_labels_both_ways_teach_nothing(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    assert [tuple(r) for r in common.agreed(labels, "doc_id", "toxic").collect()] == [(2, 1)]


def test_toxicity_scores_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    from pyspark.sql import functions as F

    got = {r.doc_id: r.score for r in toxicity.score(docs, model, {"doc_id": F.col("doc_id")}).collect()}
    for r in docs.limit(40).collect():
        text, z = r.text.lower(), model["bias"]
        grams = {text[i : i + n] for n in toxicity.NS for i in range(len(text) - n + 1)}
        places = set()
        for g in grams:
            h = 0
            for c in g:
                h = (h * int(toxicity._BASE) + ord(c)) % 2**64
            places.add(int(model["index"][((h * int(toxicity._MULT)) % 2**64) >> (64 - toxicity.BITS)]))
        z += sum(model["weight"][k] for k in places - {0})
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_scores_by_brute_force(spark):
    """Densities from the covariances themselves."""
    rng = np.random.default_rng(3)
    k = len(quality.STATS)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, k)) * np.arange(1, k + 1) + y[:, None]
    df = spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "__id long, quality int, stats array<double>")
    model = quality.fit(df, shares=((0.3, 0.2, 0.1),))
    scores = np.array([r.score for r in quality.score(df, model).orderBy("__id").collect()])
    scale = x.std(0)
    z = x / scale
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    both = sum((y == c).mean() * covs[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        cov = 0.7 * covs[c] + 0.3 * both
        cov = 0.8 * cov + 0.2 * np.diag(np.diag(cov))
        cov = 0.9 * cov + (0.1 * np.trace(cov) / k + 1e-6) * np.eye(k)
        d = z - z[y == c].mean(0)
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert scores == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)


def test_quality_shares_come_from_the_inner_fold(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, len(quality.STATS))) + 0.5 * y[:, None]
    df = spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "__id long, quality int, stats array<double>")
    got = quality.fit(df)
    one = [quality.fit(df, shares=(s,)) for s in quality.SHARES]
    assert any(np.allclose(got["chol"], m["chol"]) for m in one)


def test_long_texts_keep_all_ngrams():
    text = ("x" * toxicity.CHUNK + "idiot").encode()
    cut = set()
    for b in toxicity.buckets(text):
        cut |= set(b.tolist())
    assert set(next(toxicity.buckets(b"idi")).tolist()) <= cut
    last = set().union(*(set(b.tolist()) for b in toxicity.buckets(b"idiot")))
    assert last <= cut


def test_statistics_are_finite():
    import math

    for t in (None, b"", b" ", b"a", b"\xff\xfe", b"x" * 100_000, "é! ü? 1".encode()):
        assert all(map(math.isfinite, quality.statistics(t))) and len(quality.statistics(t)) == len(quality.STATS)
