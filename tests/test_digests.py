"""Folder digests against the full comparison."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import digests, incremental

SCHEMA = "path string, hash string"


def status(spark, a, b):
    return {(r.path, r.status) for r in incremental.integrity_status(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).where("status != 'clean'").collect()}


@pytest.mark.parametrize("most", [10_000, 0])
def test_differences_equal_the_full_comparison(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(digests, "MOST", most)
    rng = random.Random(most)
    path = lambda: "/".join(f"d{rng.randrange(3)}" for _ in range(rng.randrange(4))) + f"/f{rng.randrange(40)}"
    was = {path().lstrip("/"): rng.choice(["a", "b", None]) for _ in range(150)}
    now = {p: ("c" if rng.random() < 0.1 else h) for p, h in was.items() if rng.random() > 0.1} | {path().lstrip("/"): "n" for _ in range(10)} | {"new/deep/er/x": "n"}
    for name, held in (("a", was), ("b", now), ("same", was)):
        digests.save(spark.createDataFrame([*held.items(), (None, "x")], SCHEMA), str(tmp_path / name))
    got = {tuple(r) for r in digests.differences(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert got == status(spark, list(was.items()), list(now.items())) and len(got) > 15
    assert digests.differences(spark, str(tmp_path / "a"), str(tmp_path / "same")).count() == 0


def test_equal_subtrees_are_not_compared(spark, tmp_path):
    rows = [(f"t{i % 40}/s{i % 3}/f{i}", f"h{i}") for i in range(2400)]
    digests.save(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"))
    digests.save(spark.createDataFrame([(p, "x" if p == "t7/s1/f7" else h) for p, h in rows], SCHEMA), str(tmp_path / "b"))
    assert [r.folder for r in digests.changed_folders(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()] == ["t7/s1"]
    assert [tuple(r) for r in digests.differences(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()] == [("t7/s1/f7", "dirty")]


def test_empty_states(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    digests.save(none, str(tmp_path / "none"))
    digests.save(spark.createDataFrame([("a", None), ("b/c", "1")], SCHEMA), str(tmp_path / "some"))
    assert digests.differences(spark, str(tmp_path / "none"), str(tmp_path / "none")).count() == 0
    assert {tuple(r) for r in digests.differences(spark, str(tmp_path / "none"), str(tmp_path / "some")).collect()} == {("a", "unknown"), ("b/c", "unknown")}
    assert {r.folder for r in digests.nodes(spark.createDataFrame([("b/c", "1")], SCHEMA).withColumn("folder", F.lit("b"))).collect()} == {"", "b"}
