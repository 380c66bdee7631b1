"""The source divergence audit against brute force and SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import divergence  # noqa: E402
from tests.llm import edges  # noqa: E402

SF = "/root/testdata/sf0.01"


def brute(docs, least=30, top=50):
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        df[lang].update(set(cut(text)))
        counts[lang, source].update(cut(text))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        share = lambda held: {t: 1 + 10**9 * (held[t] + 5) // (sum(held[x] for x in kept) + 5 * v) for t in kept}  # noqa: E731, B023
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -value, k) for part, held in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(held, 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert rows(divergence.query(spark, SF)) == sorted(con.execute(divergence.oracle()).fetchall())


@pytest.mark.parametrize(("heavy", "block", "tile", "flush"), [(0.25, 256, 200_000, 10**6), (2.0, 4, 50, 100), (0.0, 3, 40, 60), (0.4, 5, 100, 200)])
def test_audit_against_brute_force(spark, monkeypatch, heavy, block, tile, flush):
    monkeypatch.setattr(divergence, "FLUSH", flush)
    monkeypatch.setattr(divergence, "MOST_BYTES", flush)  # both ways to the counts of kept terms
    rng = random.Random(7)
    docs = [(f"l{rng.randrange(2)}", f"s{min(rng.randrange(12), rng.randrange(12))}", " ".join("w" + chr(97 + min(rng.randrange(26), rng.randrange(26))) + chr(97 + rng.randrange(3)) for _ in range(rng.randrange(30)))) for _ in range(400)]
    docs += [("l0", "alone", None), ("l0", "none", "12 34"), ("few", "a", "x y"), ("few", "b", "x"), ("one", "a", "x " * 9), (None, None, "Ünder ünder"), (None, "s1", "ünder A_B")]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    assert rows(divergence.audit(df, least_docs=5, top=7, heavy=heavy, block=block, tile=tile)) == brute(docs, 5, 7)


def test_pair_sums_of_a_tile():
    rng = np.random.default_rng(1)
    for heavy in (0.0, 0.3, 2.0):
        p = np.where(rng.random((9, 200)) < rng.random(200) ** 2, rng.integers(50, 10**9, (9, 200)), 0)
        absent = rng.integers(1, 10**6, 9)
        group, term = np.nonzero(p)
        _, term_ = np.unique(term, return_inverse=True)
        full = np.where(p > 0, p, absent[:, None])[:, np.unique(term)]
        for first, second in ((np.arange(9), np.arange(9)), (np.arange(4), np.arange(4, 9))):
            want = np.abs(full[first][:, None, :] - full[second][None, :, :]).sum(axis=2)
            got = divergence.pair_sums(first, second, group, term_, p[group, term], absent, heavy)
            assert (got == want)[first[:, None] != second[None, :]].all()


def test_shares_do_not_overflow(spark):
    pairs = [(5, 5), (0, 7), (6 * 10**13, 9 * 10**13 + 7), (10**15, 10**15 + 1), (3, 10**15), (3, 0)]
    want = [1 + 10**9 * a // b if b else None for a, b in pairs]
    df = spark.createDataFrame(pairs, "a long, b long").coalesce(1)
    assert [r[0] for r in df.select(divergence.share("a", "b")).collect()] == want
    assert divergence.shares(*np.array(pairs).T).tolist() == [w or 0 for w in want]


def test_edges(spark, tmp_path):
    docs = edges.documents(spark)
    held = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    assert rows(divergence.query(spark, edges.sf_dir(spark, tmp_path, documents=docs))) == brute(held)
    assert divergence.query(spark, edges.sf_dir(spark, tmp_path / "none")).count() == 0
    odd = spark.sql("select cast(X'65FF' as string) as lang, 's' as source, cast(X'6162FF63' as string) as text from range(40)")
    assert [(r.part, r.value) for r in divergence.audit(odd).collect()] == []


def test_dropped_terms_are_not_shuffled_with_their_counts(spark, monkeypatch):
    """Kept terms whose own bytes are beyond the bound: rows without one are dropped where they are read, by hashes."""
    docs = [("en", f"s{i % 3}", "kept also " + " ".join(f"rare{chr(97 + i % 26)}{chr(97 + j)}" for j in range(i % 20))) for i in range(60)]
    plans = []
    written = divergence.materialize
    monkeypatch.setattr(divergence, "materialize", lambda df: plans.append(df._jdf.queryExecution().toString()) or written(df))
    monkeypatch.setattr(divergence, "MOST_BYTES", 64)
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    assert rows(divergence.audit(df, least_docs=10, top=7)) == brute(docs, 10, 7)
    assert any("BroadcastHashJoin [h#" in p and "LeftSemi" in p for p in plans)
