"""Classes in place of pairs, and ranks without moving edges."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, matching
from graphloom.plans import storage


def symbols(spark, n=300):
    rng = random.Random(2)
    rows = [(i, rng.choice(["main", "init", "getName", f"own{i}", None]), rng.choice(["function", "class", "method", "Type"]), rng.choice(["python", "go", "rust", None])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, name string, kind string, language string")


def test_classes_hold_all_pairs(spark):
    held = symbols(spark)
    pairs = matching.cross_language(held).collect()
    classes = matching.cross_language_classes(held)
    assert sum(r.pairs for r in classes.collect()) == len(pairs) and classes.count() < len(pairs) / 5
    key = lambda r: (r.name, r.id_a, r.id_b, r.language_a, r.language_b, round(r.confidence, 9), tuple(r.reasons))
    assert sorted(map(key, matching.expanded(classes, held).collect())) == sorted(map(key, pairs))
    assert matching.cross_language_classes(held.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1, 7, 150, 100_000])
def test_top_equals_sorting_all_pairs(spark, limit):
    held = symbols(spark)
    want = sorted(((-r.confidence, r.name, r.id_a, r.id_b) for r in matching.cross_language(held).collect()))[:limit]
    assert [(-r.confidence, r.name, r.id_a, r.id_b) for r in matching.cross_language_top(held, limit).collect()] == want
    assert matching.cross_language_top(held.limit(0), limit).count() == 0


def test_bucketed_ranks_equal_an_oracle_and_move_no_edges(spark):
    rng = random.Random(4)
    edges = [(f"n{min(rng.randrange(30), rng.randrange(30))}", f"n{rng.randrange(30)}") for _ in range(120)] + [("a", "end")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.name: r.rank for r in graph.pagerank(df, tolerance=1e-4, few_rows=0).collect()}
    names = {x for e in edges for x in e}
    rank = dict.fromkeys(names, 1 / len(names))
    outs = {s: [d for a, d in edges if a == s] for s, _ in edges}
    while True:
        dangling = sum(rank[x] for x in names - outs.keys())
        new = dict.fromkeys(names, (0.15 + 0.85 * dangling) / len(names))
        for s, targets in outs.items():
            for d in targets:
                new[d] += 0.85 * rank[s] / len(targets)
        delta = sum(abs(new[x] - rank[x]) for x in names)
        rank = new
        if delta <= 1e-4:
            break
    assert got == pytest.approx(rank, abs=1e-9)
    weights = storage.bucketed(df.selectExpr("src", "dst", "1.0D as w"), "src", 4)
    ranks = storage.bucketed(df.selectExpr("src as name").distinct().selectExpr("name", "true as sends", "0.1D as rank"), "name", 4)
    plan = graph.pagerank_round(weights, ranks, 0.1, 0.85, False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan  # the contributions
    storage.drop_tables(spark)


def test_pairs_of_a_hot_name_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 20, raising=False)
    monkeypatch.setattr(matching, "PAIRS", 4000, raising=False)
    rows = [(i, "main" if i % 10 else "init", "function", ("python", "go", "rust")[i % 3]) for i in range(600)] + [(700, "main", None, "go"), (701, None, "class", "go"), (702, None, "class", "rust"), (703, "one", "class", "go")]
    pairs = matching.cross_language(spark.createDataFrame(rows, "id long, name string, kind string, language string"))
    want = {(a[1], a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and a[3] < b[3]}
    assert sorted((r.name, r.id_a, r.id_b) for r in pairs.collect()) == sorted(want)
    shares = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(shares) > 20 and max(shares) < len(want) / 10
