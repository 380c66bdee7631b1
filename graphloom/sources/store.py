"""Saved indexes: tables dealt into buckets of the file path, and a manifest that names the folder and the rows of each bucket.

A change of some files rewrites the buckets that hold their paths, in all tables, and takes over the others without reading or writing
them; the new manifest replaces the old one by a rename once everything is written. Readers see the old index or the new one, never a
mixture. One writer at a time is assumed. The folders of the manifest before stay, so that plans which still read them can end.

Tables without a path (ranks, overrides) are written whole. A row belongs to the bucket of the path in its table's key column; the number
of buckets is chosen when an index is saved first and stays. Rows whose path is null are in bucket 0."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema

SCHEMAS = {
    "symbols": schema.SYMBOLS, "refs": schema.REFERENCES, "imports": schema.IMPORTS, "literals": schema.LITERALS, "files": schema.FILES, "checksums": schema.CHECKSUMS,
    "ranks": schema.RANKS, "overrides": schema.OVERRIDES,
}
#: The path that deals a table into buckets.
KEYS = {"symbols": "file_path", "refs": "caller_file", "imports": "importer", "literals": "file_path", "files": "path", "checksums": "path"}
#: Tables of which a part is read by itself: rows of a value stand together, so that others are skipped.
SORTED = {"symbols": ["language"]}
BUCKETS = 64
_PREFIX = "manifest-"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _files(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Names of the promoted manifests, oldest first."""
    return sorted(n for n in _names(spark, path) if n.startswith(_PREFIX) and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, name: str | None = None) -> dict:
    """{"buckets": number, "tables": {table: {bucket: {"folder", "rows", "bytes"}}}} of the newest manifest by default; empty if nothing was saved."""
    held = _manifests(spark, path)
    if not (name or held):
        return {}
    at, fs = _files(spark, f"{path}/{name or held[-1]}")
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def bucket_of(path: Column, buckets: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(F.when(path.isNotNull(), path)), F.lit(buckets)), F.lit(0)).cast("int") if buckets > 1 else F.lit(0)


def _read(spark: SparkSession, path: str, name: str, held: dict) -> DataFrame:
    """Some buckets of a table."""
    folders = [f"{path}/{b['folder']}" for b in held.values() if b["rows"]]
    return spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else spark.createDataFrame([], SCHEMAS[name])


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    found = manifest(spark, path)
    if not found:
        raise FileNotFoundError(f"no index at {path}")
    return {n: _read(spark, path, n, held) for n, held in found["tables"].items()}


def _write(spark: SparkSession, path: str, name: str, df: DataFrame, buckets: int) -> dict:
    """Write rows into a new folder, a folder a bucket; gives the entries of those buckets that have rows.

    Buckets are rebalanced, not dealt by path: a task holds about ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` however many rows a path has."""
    folder, parted = f"{name}-{uuid.uuid4().hex}", name in KEYS
    rows = df.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]))
    if not parted:
        rows.write.parquet(f"{path}/{folder}")
        return {"0": _entry(spark, path, folder, spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{folder}").count())}
    key = F.col(KEYS[name])
    dealt = rows.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", F.col("bucket"))
    dealt.sortWithinPartitions("bucket", *SORTED.get(name, []), KEYS[name]).write.partitionBy("bucket").parquet(f"{path}/{folder}")
    if not any(n.startswith("bucket=") for n in _names(spark, f"{path}/{folder}")):
        return {}
    counts = spark.read.parquet(f"{path}/{folder}").groupBy("bucket").count().collect()  # one row a bucket
    return {str(r.bucket): _entry(spark, path, f"{folder}/bucket={r.bucket}", r["count"]) for r in counts}


def _entry(spark: SparkSession, path: str, folder: str, rows: int) -> dict:
    at, fs = _files(spark, f"{path}/{folder}")
    return {"folder": folder, "rows": rows, "bytes": fs.getContentSummary(at).getLength()}


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], buckets: int = BUCKETS) -> None:
    """Write these tables whole and promote them beside those that are there already."""
    now = manifest(spark, path) or {"buckets": buckets, "tables": {}}
    with ThreadPoolExecutor(4) as pool:
        written = pool.map(lambda item: (item[0], _write(spark, path, *item, now["buckets"])), tables.items())
        now["tables"] |= dict(written)
    _promote(spark, path, now)


def update(spark: SparkSession, path: str, changed: DataFrame, fresh: dict[str, DataFrame], tables: tuple[str, ...] = tuple(KEYS), either_side: bool = False) -> dict[str, dict]:
    """Replace the rows of the paths in ``changed`` (path) by those of ``fresh``, whose rows are of these paths alone, in the named tables; a
    table that ``fresh`` doesn't name loses its rows of them. ``either_side`` drops references by both their files, as a deleted file's are.

    Rewrites the touched buckets and promotes all tables together. Gives, by table, the buckets, rows and bytes that were written."""
    now = manifest(spark, path)
    if not now:
        raise FileNotFoundError(f"no index at {path}")
    n = now["buckets"]
    paths = changed.select("path").distinct()
    gone = lambda c: paths.withColumnRenamed("path", c)
    touched = {r.b for r in paths.select(bucket_of(F.col("path"), n).alias("b")).distinct().collect()}  # n at most

    def one(name: str) -> tuple[str, dict, dict]:
        key, held, hit = KEYS[name], now["tables"].get(name, {}), set(touched)
        called = name == "refs" and either_side
        if called:
            other = _read(spark, path, name, held).select("callee_file", key).join(gone("callee_file"), "callee_file", "left_semi")
            hit |= {r.b for r in other.select(bucket_of(F.col(key), n).alias("b")).distinct().collect()}
        rows = _read(spark, path, name, {b: x for b, x in held.items() if int(b) in hit}).join(gone(key), key, "left_anti")
        rows = (rows.join(gone("callee_file"), "callee_file", "left_anti") if called else rows).select(*SCHEMAS[name].names)
        if name in fresh:
            rows = rows.unionByName(fresh[name].select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[name])))
        written = _write(spark, path, name, rows, n) if hit else {}
        report = {"buckets": len(hit), "rows": sum(x["rows"] for x in written.values()), "bytes": sum(x["bytes"] for x in written.values())}
        return name, {b: x for b, x in held.items() if int(b) not in hit} | written, report

    out = {}
    with ThreadPoolExecutor(len(KEYS)) as pool:  # small jobs side by side
        for name, entries, report in pool.map(one, [t for t in tables if t in now["tables"] or t in fresh]):
            now["tables"][name], out[name] = entries, report
    _promote(spark, path, now)
    return out


def upsert_checksums(spark: SparkSession, path: str, found: DataFrame) -> dict[str, dict]:
    """Set hash and size of files (path, hash, size) in both tables in one promotion: new files get a row in each; a known one keeps its text, its
    language and its counts of checks, and is in step again. Of several rows of a path the one of greatest hash counts."""
    tables = load(spark, path)
    files, sums = tables["files"], tables.get("checksums", spark.createDataFrame([], schema.CHECKSUMS))
    new = found.groupBy("path").agg(F.max(F.struct("hash", "size")).alias("x")).select("path", "x.*")
    counts = new.join(sums.select("path", "verify_count", "mismatch_count"), "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    fresh = {"files": new.join(files.select("path", "text", "language"), "path", "left"), "checksums": counts.select("path", "hash", zero("verify_count"), zero("mismatch_count"), F.lit("synced").alias("status"))}
    return update(spark, path, new, fresh, ("files", "checksums"))


def _promote(spark: SparkSession, path: str, now: dict) -> None:
    held = _manifests(spark, path)
    number = int(held[-1][len(_PREFIX) : -len(".json")]) + 1 if held else 1
    new = f"{_PREFIX}{number:09d}.json"
    target, fs = _files(spark, f"{path}/{new}")
    draft, _ = _files(spark, f"{path}/.{new}.draft")
    stream = fs.create(draft, True)
    stream.writeBytes(json.dumps(now))
    stream.close()
    if not fs.rename(draft, target):
        raise OSError(f"{path}: {new} was promoted by another writer")
    _clean(spark, path, [*held, new])


def folders(found: dict) -> set[str]:
    """The folders that a manifest names."""
    return {b["folder"] for held in found.get("tables", {}).values() for b in held.values()}


def _clean(spark: SparkSession, path: str, held: list[str]) -> None:
    """Delete what neither of the last two manifests names: manifests, folders of tables, and folders of buckets in those that are kept."""
    kept = set().union(*(folders(manifest(spark, path, name)) for name in held[-2:]))
    tops = {f.split("/")[0] for f in kept}

    def drop(name: str) -> None:
        at, fs = _files(spark, f"{path}/{name}")
        fs.delete(at, True)

    for name in _names(spark, path):
        if name in held:
            if name not in held[-2:]:
                drop(name)
        elif any(name.startswith(t + "-") for t in SCHEMAS):
            if name not in tops:
                drop(name)
            else:
                for part in _names(spark, f"{path}/{name}"):
                    if part.startswith("bucket=") and f"{name}/{part}" not in kept:
                        drop(f"{name}/{part}")
