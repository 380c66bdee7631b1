"""Ranked lexical search against brute force and SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import lexical  # noqa: E402
from tests.llm import edges  # noqa: E402

SF = "/root/testdata/sf0.001"


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, queries, most=10):
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(lexical.query(spark, SF)) == sorted(con.execute(lexical.oracle()).fetchall(), key=repr)


@pytest.mark.parametrize(("postings", "block"), [(40, 3), (10**6, 10**6)])
def test_search_against_brute_force(spark, postings, block):
    rng = random.Random(1)
    word = lambda: "w%d" % min(rng.randrange(1, 60), rng.randrange(1, 60))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    docs += [(1000 + i, "W1 w2-w3 rare%d" % (i % 3)) for i in range(60)] + [(None, "w1 w2 w3"), (None, "rare1 rare1"), (5, "w1 w1"), (7, None)]
    queries = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(25)] + [(100, "rare1 W2, rare2"), (101, "unseen"), (102, None), (103, "w1"), (None, "w5 w5 w6"), (100, "w9")]
    held = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_postings=postings)
    got = rows(lexical.search(held, spark.createDataFrame(queries, "item_id long, text string"), block_terms=block))
    assert got == brute(docs, queries)


def test_shard_skips_what_cannot_enter():
    """The pivots are few where a rare word decides, and all scores stay exact."""
    rng = np.random.default_rng(3)
    n = 5000
    shard = lexical.Shard(list(range(n)), np.full(n, 50), n, 50 * n)
    lists = {b"common": np.arange(n), b"often": np.arange(0, n, 2), b"rare": np.sort(rng.choice(n, 40, False))}
    for t, d in lists.items():
        shard.add(t, d.astype(np.int32), rng.integers(1, 9, len(d)).astype(np.int32))
    query = {b"common": 1, b"often": 700, b"rare": 5000, b"none": 9}
    want = np.zeros(n, np.int64)
    for t, (docs, impact, _) in shard.lists.items():
        want[docs] += impact * query[t]
    seen = []
    real = lexical._scores
    lexical._scores = lambda held, docs: seen.append(len(docs)) or real(held, docs)
    try:
        got = sorted(shard.search(query, 10), reverse=True)
    finally:
        lexical._scores = real
    order = sorted(range(n), key=lambda i: (-want[i], i))[:10]
    assert sorted(got, key=lambda x: (-x[0], x[1])) == [(int(want[i]), i) for i in order] and sum(seen[1:]) <= 40


def test_edges(spark, tmp_path):
    bench = spark.createDataFrame([(1, "The SMALL dog"), (2, ""), (3, None), (4, "without a number 日本語")], "item_id long, text string")
    docs = edges.documents(spark)
    got = rows(lexical.query(spark, edges.sf_dir(spark, tmp_path, documents=docs, benchmark=bench)))
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    assert lexical.query(spark, edges.sf_dir(spark, tmp_path / "none")).count() == 0
    assert lexical.query(spark, edges.sf_dir(spark, tmp_path / "some", documents=docs)).count() == 0


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(X'6162FF6320' as string) as text union all select 2L, 'plain'")
    asked = spark.sql("select 1L as item_id, cast(X'6162FF63' as string) as text")
    assert [(r.doc_id, r.rank) for r in lexical.search(lexical.index(docs), asked).collect()] == [(1, 1)]
