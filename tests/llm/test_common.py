"""Shared helpers: components against union-find, cut-offs, batches."""

import random

import pyarrow as pa
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import common  # noqa: E402


def roots(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5), (300, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: v for k, v in roots([x for x in links if x[0] != x[1]]).items()}
    assert got == want


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rng = random.Random(3)
    links = [(0, i) for i in range(1, 90)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(40)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots([x for x in links if x[0] != x[1]])
    left = spark.createDataFrame([(i % 3 if i % 5 else 9, i) for i in range(200)], "k long, i long")
    right = left.groupBy("k").agg(common.F.count("*").alias("n"))
    assert sorted(map(tuple, common.spread_join(left, right, "k", "n", "i").collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    monkeypatch.setattr(common, "MOST_HOT", 1)  # too many hot keys to broadcast
    assert common.spread_join(left, right, "k", "n", "i").count() == 200


def test_scratch_deletes_all_but_the_last_table(spark):
    import os

    place = lambda p: p.removeprefix("file://")
    with common.scratch():
        common.materialize(spark.range(3))
        first = common._written[-1]
        last_df = common.materialize(spark.range(5))
    assert not os.path.exists(place(first)) and os.path.exists(place(common._written[-1])) and last_df.count() == 5


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_most_frequent(spark):
    df = spark.createDataFrame([(i, 1 + i % 50, f"g{i % 2}") for i in range(1000)], "k long, n long, g string")
    kept = df.where(common.most_frequent(df, "n", 300, "k")).collect()
    assert 250 <= len(kept) <= 350 and min(r.n for r in kept) >= 30
    equal = df.withColumn("n", common.F.lit(7))  # ties: those of least hash, about as many as the bound says
    assert 240 <= equal.where(common.most_frequent(equal, "n", 300, "k")).count() <= 360
    assert df.limit(0).where(common.most_frequent(df.limit(0), "n", 10, "k")).count() == 0
    skewed = df.where("g = 'g0' or k < 20")
    per = skewed.where(common.most_frequent_each(skewed, "n", 100, "k", "g")).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in per}["g1"] == 10 and 70 <= {r.g: r["count"] for r in per}["g0"] <= 130


def test_row_numbers_hold_for_any_plan(spark, tmp_path):
    df = spark.range(1000).withColumn("v", common.F.col("id") % 7)
    df.write.parquet(f"{tmp_path}/t")
    scan = common.numbered(spark.read.parquet(f"{tmp_path}/t").where("v < 5"))
    assert "Repartition" not in scan._jdf.queryExecution().analyzed().toString()
    mixed = common.numbered(df.repartition(5))
    assert "Repartition" not in mixed._jdf.queryExecution().analyzed().toString()  # written and read again
    assert mixed.select("uid").distinct().count() == 1000


def test_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a" * 10, None, "b" * 100, ""])], names=["k", "t"])
    parts = list(common.by_bytes(batch, 20))
    assert sum(p.num_rows for p in parts) == 4 and [v for p in parts for v in p.column(0).to_pylist()] == [1, 2, 3, 4]


def test_fold(spark):
    import zlib

    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i,) for i in [0, 7, 123456789, -5, None]], "d long").select("d", common.fold(F.col("d"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32((str(r.d) if r.d is not None else "").encode()) % 5 for r in rows)
