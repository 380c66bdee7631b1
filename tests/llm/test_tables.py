"""Sharding, license scans, and the pipeline."""

import random
import re
import zlib

import pytest

pytest.importorskip("graphloom.llm")
import corpus_pipeline  # noqa: E402
from graphloom.llm import decontaminate, langid, licenses, minhash, quality, registry, sentencepiece, sharding  # noqa: E402
from tests.llm import edges  # noqa: E402

SF = "/root/testdata/sf0.01"


def check_shards(rows, texts, shards=24):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    return {s: sum(r.size for r in held) for s, held in by.items()}


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.query(spark, SF).collect()
    assert len(rows) == len(texts)
    sizes = check_shards(rows, texts)
    assert len(sizes) == 24 and max(sizes.values()) <= 1.01 * min(sizes.values())
    where = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard


def test_sharding_of_a_hot_group(spark):
    docs = [(i, "same text" if i % 3 == 0 else f"text {i} " * (1 + i % 7)) for i in range(3000)]
    from pyspark.sql import functions as F

    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), {"doc_id": F.col("doc_id")}, chunk=50).collect()
    sizes = check_shards(rows, dict(docs))
    assert len({r.shard for r in rows if r.doc_id % 3 == 0}) == 1
    hot = next(r.shard for r in rows if r.doc_id == 0)
    rest = [v for s, v in sizes.items() if s != hot]
    assert max(rest) <= 1.02 * min(rest) + 100


def test_sharding_edges(spark, tmp_path):
    rows = sharding.query(spark, edges.sf_dir(spark, tmp_path, documents=edges.documents(spark))).collect()
    assert len(rows) == 12
    check_shards(rows, None)
    by = {r.doc_id: r for r in rows}
    assert by[1].size == by[2].size == 8 and by[1].text_crc32 == 0 and by[1].shard == by[9].shard
    assert sharding.query(spark, edges.sf_dir(spark, tmp_path / "none")).count() == 0


def test_best_fit():
    import random

    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted((rng.randrange(1, 100) for _ in range(rng.randrange(1, 120))), reverse=True)
        capacity, most = 150, 200
        left, want = [], []
        for s in sizes:  # the same choice by search over all bins
            fits = [(c, i) for i, c in enumerate(left) if c >= s]
            if fits:
                _, i = min(fits)
            else:
                i = len(left)
                left.append(capacity)
            left[i] -= s
            want.append(i)
        assert sharding.best_fit(sizes, capacity, most) == want
    assert sharding.best_fit([5, 5, 5], 5, 2) is None
    assert sharding.pack([], 4) == [] and sorted(sharding.pack([9, 1, 1, 1], 2)) == [0, 1, 1, 1]


def brute_scan(text):
    words = lambda t: [w for w in re.split(licenses.NO_WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t)) if w]
    w = words(text or "")
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    own = {}
    for spans in (1, 2, 4, 8):
        here = [(n, label, set(words(t)), set(must.split())) for n, (label, t, must) in enumerate(licenses.TEMPLATES) if -(-len(words(t)) // licenses.RUN) <= spans and (spans == 1 or -(-len(words(t)) // licenses.RUN) > spans // 2)]
        step = spans * licenses.RUN
        for k in range(max(1, -(-max(1, -(-len(w) // licenses.RUN)) // spans) - 1)):
            block = set(w[k * step : k * step + 2 * step])
            met = [(len(block & t) / len(t), len(block & t), label, block & t) for _, label, t, must in here if 100 * len(block & t) >= licenses.PERCENT * len(t) and must <= block]
            for c, size, label, shared in met:
                if not any((x[0], x[1]) > (c, size) and shared <= x[3] for x in met):
                    own[label] = max(own.get(label, 0), c)
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted({x for _, x in places} | set(own))), max(own.values(), default=0.0))


def test_license_scan(spark):
    from pyspark.sql import functions as F

    texts = [t for _, t, _ in licenses.TEMPLATES] + [" ".join(random.Random(k).sample(t.split(), len(t.split()) * 9 // 10)) for k, (_, t, _) in enumerate(licenses.TEMPLATES)] + [edges.LONG + t + edges.LONG for _, t, _ in licenses.TEMPLATES[9:]] + [
        None, "", "MIT  license, mit-License MIT\nlicense; apache license", "cc by", "CC\nBY gnu general public license gnu general public", edges.LONG + "Released under the MIT License.\n" + edges.LONG,
        "x " * 40 + "licensed under the apache license version 2.0 " + "y " * 40, "Licensed under the Apache", "ÄMIT license mit licenseé", "license mit license",
        "this work is licensed under the gnu general public license", "Released under the mit\nlicense",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(df, {"doc_id": F.col("doc_id")}).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_scan(t)), t


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("Licensed under the Apache License 2.0 or released under the MIT License", "apache,apache-2.0,mit", 1.0),
        ("Licensed under CC BY-NC 4.0, or released under the mit-like license", "cc-by,cc-by-nc-4.0,mit", 1.0),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0", 1.0),
        ("This library is licensed under the GNU Lesser General Public License, version 2.1", "lgpl-2.1", 1.0),
        ("this software is released under the BSD license", "", 0.0),
        ("Released under a license: see the file", "", 0.0),
        ("released by the team under a commercial license the buyer signs", "", 0.0),
        (next(t for label, t, _ in licenses.TEMPLATES if label == "agpl-3.0"), "agpl-3.0", 1.0),
        (next(t for label, t, _ in licenses.TEMPLATES if label == "isc").replace(" ", "\n * "), "isc", 1.0),
    ],
)
def test_licenses_side_by_side(spark, text, labels, score):
    from pyspark.sql import functions as F

    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), {"doc_id": F.col("doc_id")}).first()
    assert (row.labels, row.score) == (labels, score)


def test_licenses_across_lines(spark, tmp_path):
    bsd, mpl = licenses.TEMPLATES[1][1], licenses.TEMPLATES[8][1]
    texts = [bsd.replace("BSD-style ", "BSD-style\n"), "# " + mpl.replace("subject", "subject\n#").replace("Public", "Public\r\n#"), edges.LONG + "Released under\nthe MIT-like\nLicense. " + edges.LONG, "a\nb " * 30 + bsd + "\nx" * 90]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = licenses.query(spark, edges.sf_dir(spark, tmp_path, documents=docs)).collect()
    assert {r.doc_id: (r.labels, r.score) for r in rows} == {0: ("bsd-3-clause", 1.0), 1: ("mpl-2.0", 1.0), 2: ("mit", 1.0), 3: ("bsd-3-clause", 1.0)}


def test_license_edges(spark, tmp_path):
    rows = licenses.query(spark, edges.sf_dir(spark, tmp_path, documents=edges.documents(spark))).collect()
    assert len(rows) == 12 and {r.doc_id: r.labels for r in rows}[None] == "mit"
    assert licenses.query(spark, edges.sf_dir(spark, tmp_path / "none")).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        out.append((name, given, docs))
    return out


def test_pipeline_stages(spark, stages):
    from pyspark.sql import functions as F

    assert [s[0] for s in stages] == ["quality", "language", "near_duplicates", "decontamination", "sentencepiece"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, given, gave in stages[:-1]:
        assert gave.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert ids(gave) <= ids(given)
    (_, docs, good), (_, _, spoken), (_, _, single), (_, _, clean), (_, _, coded) = stages
    scored = quality.scored(spark, docs, SF, {"doc_id": F.col("doc_id")})
    assert ids(good) == ids(scored.where(F.col("score") >= corpus_pipeline.QUALITY))
    predicted = langid.predict(good, langid.fit(good), {"doc_id": F.col("doc_id")})
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= corpus_pipeline.LANGUAGE) & (F.col("known") >= corpus_pipeline.KNOWN)
    assert ids(spoken) == ids(predicted.where(sure)) == ids(predicted.where(F.col("lang_pred") != "und"))
    from tests.llm.test_pairs import brute

    want, _ = brute([(r.doc_id, r.text) for r in spoken.collect()], 5)
    assert ids(single) == {i for i, c in want.items() if i == c}
    leaked = decontaminate.scan(single, spark.read.parquet(f"{SF}/benchmark.parquet"), {"doc_id": F.col("doc_id")}).where("contaminated")
    assert ids(clean) == ids(single) - ids(leaked)
    back = {r.doc_id: r.text for r in sentencepiece.decode(coded, ["doc_id"]).collect()}
    assert back == {r.doc_id: r.text for r in clean.collect()}


def test_pipeline_keeps_what_op8_calls_good(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "scored", lambda spark, docs, sf_dir, keep: docs.select(*(c.alias(n) for n, c in keep.items()), (F.col("doc_id") / 10).alias("score")))
    docs = spark.createDataFrame([(i, "text", "en", "src0", 4) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()) == [7, 8, 9]


def test_pipeline_drops_text_of_no_learnt_language(spark):
    rows = [(i, "the dog and the cat went home with the small bird", "en") for i in range(20)] + [(20, "zqxv wkkq jjxz vvkw qzzx", None), (21, "the dog vvkw home", None)]
    docs = spark.createDataFrame([(*r, "src0", 4) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_language(spark, docs, SF).collect()) == [*range(20), 21]


def test_pipeline_edges(spark, tmp_path):
    bench = spark.createDataFrame([(1, "the small dog went over the hill and saw a large bird")], "item_id long, text string")
    at = edges.sf_dir(spark, tmp_path / "a", documents=edges.documents(spark), benchmark=bench)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert out.count() <= 12, name
    assert corpus_pipeline.keep_first(spark, docs, at).count() == 10
    assert sorted(r.doc_id for r in corpus_pipeline.keep_uncontaminated(spark, docs, at).collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert corpus_pipeline.run(spark, edges.sf_dir(spark, tmp_path / "b")).count() == 0


def test_registry():
    names = registry.queries()
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{i}" for i in range(1, 14)] + ["pipeline"])
    assert set(registry.oracle_sql()) <= set(names) and minhash.BANDS * minhash.ROWS % minhash.BATCH == 0


def test_license_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(licenses.oracle()).fetchall())
    got = sorted(tuple(r) for r in licenses.query(spark, SF).collect())
    assert got == want
