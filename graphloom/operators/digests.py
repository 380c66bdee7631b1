"""Comparing two states of a tree by digests of its folders: equal subtrees are never read.

``save`` writes a state (path, hash) as its files, in the order of their folders, and a node a folder with two digests: of the files in it, and
of the whole subtree. A digest is the number of files and two exclusive ors of 64-bit hashes of path and hash, so it doesn't depend on an
order, combines before the shuffle, and a folder's is that of its parts. ``differences`` goes down from the root, a join of nodes a level,
only below folders whose digests differ, and joins the files of folders whose own digests differ.

Two different states pass for equal with probability about 2 to the -128 a folder. Defined results: paths are cut at ``/``; a null hash
is a hash of its own; repeated paths count as so many files, compared row by row; empty states are equal; null paths are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.storage import written

#: Folders that a filter of a scan may name.
MOST = 10_000
_DIGEST = ("n", "x", "y")


def _folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def nodes(files: DataFrame) -> DataFrame:
    """(depth, folder, parent, n, x, y, own_n, own_x, own_y) a folder of (path, folder, hash) rows; the root is the empty folder."""
    own = files.groupBy("folder").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "hash")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "hash", "path", F.hash("path", "hash"))).alias("y"))
    parts = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    each = own.select("*", F.explode(above).alias("depth"), parts.alias("parts"))
    at = lambda d: F.array_join(F.slice("parts", F.lit(1), d), "/")
    each = each.select("depth", at(F.col("depth")).alias("at"), at(F.greatest(F.lit(0), F.col("depth") - 1)).alias("parent"), (at(F.col("depth")) == F.col("folder")).alias("own"), *_DIGEST)
    some = lambda c: F.when(F.col("own"), F.col(c)).otherwise(F.lit(0))
    return each.groupBy("depth", F.col("at").alias("folder"), "parent").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum(some("n")).alias("own_n"), F.bit_xor(some("x")).alias("own_x"), F.bit_xor(some("y")).alias("own_y"))


def save(files: DataFrame, path: str) -> None:
    """Write a state (path, hash) below ``path``, which must be new."""
    spark = files.sparkSession
    rows = files.where("path is not null").select("path", "hash", _folder(F.col("path")).alias("folder"))
    rows.repartitionByRange("folder", "path").sortWithinPartitions("folder", "path").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/files")
    nodes(spark.read.schema(rows.schema).parquet(f"{path}/files")).repartition("depth", F.pmod(F.xxhash64("parent"), F.lit(8))).sortWithinPartitions("depth", "parent").write.partitionBy("depth").parquet(f"{path}/nodes")


_NODES = "folder string, parent string, n long, x long, y long, own_n long, own_x long, own_y long, depth int"


def _part(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose column is in ``wanted`` (folder): by a filter of the scan if it names few, else by a join."""
    names = [r[0] for r in wanted.limit(MOST + 1).collect()]
    return df.where(F.col(column).isin(names)) if len(names) <= MOST else df.join(wanted.select(F.col("folder").alias(column)), column, "left_semi")


def changed_folders(spark: SparkSession, was: str, now: str) -> DataFrame:
    """(folder) of those whose own files differ between two states."""
    a, b = (spark.read.schema(_NODES).parquet(f"{p}/nodes") for p in (was, now))
    found, depth = None, 0
    frontier = spark.createDataFrame([("",)], "folder string")
    while True:
        left, right = (_part(df.where(F.col("depth") == depth), "parent", frontier) for df in (a, b))
        both = left.select("folder", *(F.col(c).alias(f"a_{c}") for c in left.columns if c not in ("folder", "parent", "depth"))).join(right.select("folder", *(F.col(c).alias(f"b_{c}") for c in right.columns if c not in ("folder", "parent", "depth"))), "folder", "full_outer")
        differ = lambda *columns: ~F.lit(True).eqNullSafe(F.forall(F.array(*(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns)), lambda x: x))
        level = written(both.where(differ(*_DIGEST)).select("folder", differ("own_n", "own_x", "own_y").alias("own"), (F.coalesce(F.col("a_n") > F.col("a_own_n"), F.lit(False)) | F.coalesce(F.col("b_n") > F.col("b_own_n"), F.lit(False))).alias("below")))
        own = level.where("own").select("folder")
        found = own if found is None else found.unionByName(own)
        frontier = level.where("below").select("folder")
        if frontier.isEmpty():
            return found
        depth += 1


def differences(spark: SparkSession, was: str, now: str) -> DataFrame:
    """(path, status) of all that isn't clean between two saved states: dirty, missing (gone since) or unknown (new)."""
    folders = written(changed_folders(spark, was, now))
    a, b = (_part(spark.read.schema("path string, hash string, folder string").parquet(f"{p}/files"), "folder", folders) for p in (was, now))
    both = a.select("path", F.col("hash").alias("was"), F.lit(1).alias("s")).join(b.select("path", F.col("hash").alias("now"), F.lit(1).alias("d")), "path", "full_outer")
    status = F.when(F.col("s").isNull(), "unknown").when(F.col("d").isNull(), "missing").when(~F.col("was").eqNullSafe(F.col("now")), "dirty")
    return both.select("path", status.alias("status")).where("status is not null")
