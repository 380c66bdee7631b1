"""The operation log: commits, aborts, tokens, truncation."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import incremental
from graphloom.sources import operations


def records(spark, *paths, **more):
    df = spark.createDataFrame([(p, "Enqueue") for p in paths], "file_path string, op string").repartition(3)
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v))
    return df


def test_numbers_follow_commits(spark, tmp_path):
    at = str(tmp_path / "log")
    assert operations.read(spark, at).count() == 0
    operations.append(records(spark, "a", "b", "c", "d", "e"), at)
    operations.append(records(spark).limit(0), at)
    operations.append(records(spark, "f", file_hash="h", status="Committed"), at)
    rows = sorted(operations.read(spark, at).collect())
    assert [r.seq for r in rows] == [1, 2, 3, 4, 5, 6] and {r.file_path for r in rows[:5]} == set("abcde")
    assert (rows[5].file_path, rows[5].status, rows[5].file_hash) == ("f", "Committed", "h") and all(r.timestamp > 1e12 for r in rows)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "log")
    operations.append(records(spark, "a"), at)
    bad = records(spark, *(f"p{i}" for i in range(50))).withColumn("op", F.when(F.col("file_path") == "p7", F.raise_error(F.lit("on purpose"))).otherwise(F.col("op")))
    with pytest.raises(Exception, match="on purpose"):
        operations.append(bad, at)
    with pytest.raises(Exception, match="needs file_path"):
        operations.append(records(spark, "x").withColumn("op", F.lit(None).cast("string")), at)
    assert [r.file_path for r in operations.read(spark, at).collect()] == ["a"]
    (tmp_path / "log" / "files" / "left.parquet").write_bytes(b"half a rec")  # of a task that was killed
    assert operations.read(spark, at).count() == 1
    operations.append(records(spark, "b"), at)
    assert sorted((r.seq, r.file_path) for r in operations.read(spark, at).collect()) == [(1, "a"), (2, "b")]


def test_tokens_and_truncation(spark, tmp_path):
    at = str(tmp_path / "log")
    for _ in range(2):
        operations.append(records(spark, "a", "b"), at, token="batch-1")
    assert operations.read(spark, at).count() == 2
    disk = spark.createDataFrame([("a", "1")], "path string, hash string")
    assert {(r.path, r.action) for r in incremental.recover(operations.read(spark, at), disk).collect()} == {("a", "reindex"), ("b", "skip_missing")}
    operations.truncate(at, stale_seconds=0)
    assert operations.read(spark, at).count() == 0 and os.listdir(tmp_path / "log" / "files") == [] and len(os.listdir(tmp_path / "log" / "commits")) == 1
    operations.append(records(spark, "c"), at)
    assert [(r.seq, r.file_path) for r in operations.read(spark, at).collect()] == [(3, "c")]
