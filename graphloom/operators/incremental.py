"""Keeping the index up to date: change sets, upserts, deletes, the dirty queue, recovery and the result cache."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row of greatest ``order`` a key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*").select(*df.columns)


def upsert(stored: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``changes`` replace rows of equal key, others are added."""
    return stored.join(changes.select(*key), key, "left_anti").unionByName(changes)


def integrity_status(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, status): clean, dirty, missing (gone from disk) or unknown (never stored). Both sides: path, hash."""
    both = stored.select("path", F.col("hash").alias("was"), F.lit(1).alias("s")).join(disk.select("path", F.col("hash").alias("now"), F.lit(1).alias("d")), "path", "full_outer")
    return both.select("path", F.when(F.col("s").isNull(), "unknown").when(F.col("d").isNull(), "missing").when(F.col("was").eqNullSafe(F.col("now")), "clean").otherwise("dirty").alias("status"))


def changed_files(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Files to index: new ones, and those whose hash differs."""
    return disk.join(stored.select("path", "hash"), ["path", "hash"], "left_anti")


def new_files(disk: DataFrame, stored: DataFrame) -> DataFrame:
    return disk.join(stored.select("path"), "path", "left_anti")


def stale_files(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Stored paths that the scan doesn't hold."""
    return stored.join(disk.select("path"), "path", "left_anti")


def delete_files(paths: DataFrame, symbols: DataFrame, refs: DataFrame, files: DataFrame, literals: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without these paths: references go with either of their files."""
    gone = lambda c: paths.select(F.col("path").alias(c))
    out = {
        "symbols": symbols.join(gone("file_path"), "file_path", "left_anti"),
        "refs": refs.join(gone("caller_file"), "caller_file", "left_anti").join(gone("callee_file"), "callee_file", "left_anti"),
        "files": files.join(paths.select("path"), "path", "left_anti"),
    }
    return out | ({"literals": literals.join(gone("file_path"), "file_path", "left_anti")} if literals is not None else {})


def clear_before_reindex(paths: DataFrame, symbols: DataFrame, refs: DataFrame, literals: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """The tables without what these files gave: references by their caller's file alone, and matches of dropped literals."""
    gone = lambda c: paths.select(F.col("path").alias(c))
    kept = literals.join(gone("file_path"), "file_path", "left_anti")
    return {
        "symbols": symbols.join(gone("file_path"), "file_path", "left_anti"),
        "refs": refs.join(gone("caller_file"), "caller_file", "left_anti"),
        "literals": kept,
        "matches": matches.join(kept.select(F.col("id").alias("literal_id")), "literal_id", "left_semi"),
    }


def resolved_refs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References by ids: caller by name and file, callee by name, the least id of each."""
    at = symbols.groupBy(F.col("name").alias("caller_symbol"), F.col("file_path").alias("caller_file")).agg(F.min("id").alias("caller_symbol_id"))
    to = symbols.groupBy(F.col("name").alias("callee_symbol")).agg(F.min("id").alias("callee_symbol_id"))
    return refs.join(at, ["caller_symbol", "caller_file"], "left").join(to, "callee_symbol", "left")


def checks(status: DataFrame) -> DataFrame:
    """Queue entries (path, reason, priority) for what isn't clean."""
    reason = F.when(F.col("status") == "dirty", "hash_mismatch").when(F.col("status") == "unknown", "no_checksum").when(F.col("status") == "missing", "file_missing")
    priority = F.when(F.col("status") == "dirty", 1).when(F.col("status") == "unknown", 0).when(F.col("status") == "missing", -1)
    return status.where("status != 'clean'").select("path", reason.alias("reason"), priority.alias("priority"))


def verify_counters(checksums: DataFrame, status: DataFrame) -> DataFrame:
    """Checksums with verify_count raised for clean files, mismatch_count and the status for dirty ones."""
    seen = checksums.drop("status").join(status.select("path", F.col("status").alias("seen")), "path", "left")
    return seen.withColumns({
        "verify_count": F.col("verify_count") + F.when(F.col("seen") == "clean", 1).otherwise(0),
        "mismatch_count": F.col("mismatch_count") + F.when(F.col("seen") == "dirty", 1).otherwise(0),
        "status": F.when(F.col("seen") == "dirty", "mismatch").otherwise("synced"),
    }).drop("seen")


def enqueue(queue: DataFrame) -> DataFrame:
    """One pending entry a path, the last one (by time, then id), in the order of processing: high priority and old ones first."""
    return latest(queue, ["path"], F.struct("enqueued_at", "id")).orderBy(F.desc("priority"), "enqueued_at", "path")


def drain(queue: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, action): remove what is gone from disk, reindex the rest."""
    there = disk.select("path", F.lit(True).alias("there"))
    return queue.select("path").distinct().join(there, "path", "left").select("path", F.when(F.col("there"), "reindex").otherwise("remove").alias("action"))


def clear_dirty(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue with all rows of the files in ``done`` marked processed."""
    hit = queue.join(done.select("path", F.lit(True).alias("hit")).distinct(), "path", "left")
    return hit.withColumn("status", F.when(F.col("hit"), "processed").otherwise(F.col("status"))).drop("hit")


def set_file_status(files: DataFrame, path: str, status: str) -> DataFrame:
    return files.withColumn("status", F.when(F.col("path") == path, status).otherwise(F.col("status")))


def recover(journal: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, action) for pending entries: skip what is missing or unchanged, reindex the rest."""
    pending = latest(journal.where("status = 'Pending'").select(F.col("file_path").alias("path"), "seq", "file_hash"), ["path"], F.col("seq"))
    seen = pending.join(disk.select("path", "hash"), "path", "left")
    return seen.select("path", F.when(F.col("hash").isNull(), "skip_missing").when(F.col("hash") == F.col("file_hash"), "skip_same").otherwise("reindex").alias("action"))


def cache_stats(cache: DataFrame, now: Column) -> DataFrame:
    """One row (total, active, expired); entries hold created_at and expires_at."""
    return cache.agg(F.count("*").alias("total"), F.count_if(F.col("expires_at") > now).alias("active"), F.count_if(F.col("expires_at") <= now).alias("expired"))


def purge(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def cache_listing(cache: DataFrame) -> DataFrame:
    return cache.orderBy(F.desc("hit_count"), "id")


def cache_key(method: str, params) -> str:
    """``method:{k=v,...}`` with keys sorted at every depth; lists keep their order."""

    def plain(v) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{k}={plain(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(plain, v)) + "]"
        return json.dumps(v, ensure_ascii=False)

    return f"{method}:{plain(params)}"


class ResultCache:
    """Answers kept on the driver until they expire. Times are milliseconds; ``clock`` can be replaced."""

    def __init__(self, ttl_ms: int = 300_000, clock=lambda: int(time.time() * 1000)) -> None:
        self.ttl_ms, self.clock, self.held = ttl_ms, clock, {}

    def get(self, method: str, params):
        entry = self.held.get(cache_key(method, params))
        if entry is None or entry["expires_at"] <= self.clock():
            return None
        entry["hit_count"] += 1
        return json.loads(entry["result_json"])

    def set(self, method: str, params, result, ttl_ms: int | None = None) -> None:
        now = self.clock()
        self.held[cache_key(method, params)] = {"result_json": json.dumps(result), "created_at": now, "expires_at": now + (self.ttl_ms if ttl_ms is None else ttl_ms), "hit_count": 0}

    def invalidate(self, method: str, params) -> bool:
        return self.held.pop(cache_key(method, params), None) is not None

    def invalidate_file(self, path: str) -> int:
        """Drop the answers that mention the path."""
        gone = [k for k, e in self.held.items() if path in e["result_json"]]
        for k in gone:
            del self.held[k]
        return len(gone)

    def purge(self) -> int:
        gone = [k for k, e in self.held.items() if e["expires_at"] <= self.clock()]
        for k in gone:
            del self.held[k]
        return len(gone)

    def stats(self) -> dict[str, int]:
        active = sum(e["expires_at"] > self.clock() for e in self.held.values())
        return {"total": len(self.held), "active": active, "expired": len(self.held) - active}

    def listing(self) -> list[tuple[str, int]]:
        return sorted(((k, e["hit_count"]) for k, e in self.held.items()), key=lambda x: (-x[1], x[0]))


def file_hash(files: DataFrame, path: str) -> DataFrame:
    """The stored hash of one file; no row if it isn't known."""
    return files.where(F.col("path") == path).select("path", "hash")


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select("path", "hash").orderBy("path")


def checksums_with_files(checksums: DataFrame, files: DataFrame) -> DataFrame:
    """Checksums of known files, by path."""
    return checksums.join(files.select("path", F.col("hash").alias("file_hash")), "path").orderBy("path")


def dirty_with_files(queue: DataFrame, files: DataFrame) -> DataFrame:
    """Pending queue entries of known files: high priority first, then old ones."""
    return queue.where("status = 'pending'").join(files.select("path"), "path", "left_semi").orderBy(F.desc("priority"), "enqueued_at", "id")


def schema_version(versions: DataFrame) -> DataFrame:
    return versions.agg(F.coalesce(F.max("schema_version"), F.lit(0)).alias("schema_version"))


def symbol_like_literals(literals: DataFrame) -> DataFrame:
    return literals.where("is_symbol_like")
