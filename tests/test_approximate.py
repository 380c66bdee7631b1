"""Approximate names against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import approximate, relational


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_within_equals_all_pairs(spark, most):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abé_", k=rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15])))
    names = {word() for _ in range(150)}
    typo = lambda s: "".join(c for c in s if rng.random() > 0.1) + rng.choice(["", "a", "x"])
    queries = {typo(n) for n in names} | {word() for _ in range(40)}
    got = {tuple(r) for r in approximate.within(spark.createDataFrame([(q,) for q in [*queries, None]], "query string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string"), most).collect()}
    assert got == {(q, n, edits(q, n)) for q in queries for n in names if edits(q, n) <= most}


def test_nearest_symbols(spark):
    symbols = spark.createDataFrame([(1, "parse_config"), (2, "Parse_Config"), (3, "parse_confit"), (4, "other"), (5, None)] + [(10 + i, "load") for i in range(20)], "id long, name string")
    queries = spark.createDataFrame([(1, "prase_config"), (2, "lod"), (3, "nothing_like_it"), (4, None), (5, "parse_config")], "qid int, query string")
    got = sorted((r.qid, r.place, r.id, r.distance) for r in approximate.nearest(queries, symbols, limit=3).collect())
    assert got == [(1, 1, 2, 2), (1, 2, 1, 2), (2, 1, 10, 1), (2, 2, 11, 1), (2, 3, 12, 1), (5, 1, 2, 0), (5, 2, 1, 0), (5, 3, 3, 1)]


def test_search_batch_finds_typos(spark):
    symbols = spark.createDataFrame([(1, "parse_config", "function"), (2, "unrelated", "function")], "id long, name string, kind string")
    ranks = spark.createDataFrame([("parse_config", 0.5)], "symbol_name string, page_rank double")
    queries = spark.createDataFrame([(1, "prase_confg"), (2, "config"), (3, "zzz")], "qid int, query string")
    assert {(r.qid, r.id) for r in relational.search_batch(symbols, ranks, queries, edits=3).collect()} == {(1, 1), (2, 1)}
    assert relational.search_batch(symbols, ranks, queries.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("most", [0, 10])
def test_search_batch_ranks_a_repeated_text_once(spark, monkeypatch, most):
    kept, written = [], relational.written
    monkeypatch.setattr(relational, "written", lambda df: kept.append(df) or written(df))
    monkeypatch.setattr(relational, "MOST_LISTS", most)
    symbols = spark.createDataFrame([(i, f"load_{i % 5}", "function") for i in range(100)], "id long, name string, kind string")
    ranks = spark.createDataFrame([("load_3", 0.5)], "symbol_name string, page_rank double")
    queries = spark.range(300).selectExpr("id as qid", "'load_x' as query").union(spark.createDataFrame([(1, "load_3"), (400, None)], "qid long, query string"))
    out = relational.search_batch(symbols, ranks, queries, limit=3)
    assert out.columns == ["name", "query", "qid", "page_rank", "score", "id", "kind", "place"]
    got = sorted((r.qid, r.place, r.id) for r in out.collect())
    want = [(q, k + 1, 3 + 5 * k) for q in range(300) for k in range(3)]
    assert got == want
    assert [df.count() for df in kept] == [2]  # a list a text, not one a query
