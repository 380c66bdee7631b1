"""The log of file operations as a Spark source and sink with two-phase commit.

A write's tasks each put their records into a draft file; only when all have ended, the driver's commit names the drafts in the next
commit file, written beside and renamed, and gives their records consecutive numbers. A task that is killed, run twice or aborted leaves
at most a file that no commit names, so readers never see half a write; the next commit removes what an ended writer left.

``token`` makes a write idempotent: a commit of a token that is in the log already does nothing, as when a stream's micro-batch is run
again. ``truncate`` starts the log anew after what has been read; numbers go on. One committing driver at a time is assumed.

Defined results: an empty write commits no file; records without a path or an operation fail the write; a missing log is empty.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from graphloom.sources import tree

SCHEMA = "seq long, timestamp long, file_path string, op string, status string, file_hash string"
_FIELDS = pa.schema([("timestamp", pa.int64()), ("file_path", pa.string()), ("op", pa.string()), ("status", pa.string()), ("file_hash", pa.string())])
#: Seconds after which a draft that no commit names belongs to a writer that has ended.
STALE = 24 * 3600


def _names(root: str, folder: str) -> list[str]:
    store, base = tree.opened(root)
    try:
        return sorted(e.name for e in store.entries(f"{base}/{folder}") if not e.name.endswith(".draft"))
    except (OSError, pa.ArrowException):
        return []


def commits(root: str) -> list[dict]:
    """Commits in order, from the last truncation on: {"number", "token", "begin", "files": [[name, rows]], "truncate"}."""
    store, base = tree.opened(root)
    out: list[dict] = []
    for name in _names(root, "commits"):
        held = json.loads(store.read(f"{base}/commits/{name}"))
        out = [held] if held["truncate"] else [*out, held]
    return out


def _commit(root: str, files: list[tuple[str, int]], token: str | None, truncate: bool = False) -> int:
    """Write the next commit; gives the number of its first record."""
    store, base = tree.opened(root)
    held = commits(root)
    if token is not None and any(c["token"] == token for c in held):
        return next(c["begin"] for c in held if c["token"] == token)
    last = held[-1] if held else {"number": 0, "begin": 1, "files": []}
    begin = last["begin"] + sum(n for _, n in last["files"])
    number = last["number"] + 1
    store.write(f"{base}/commits/{number:012d}.json", json.dumps({"number": number, "token": token, "begin": begin, "files": files, "truncate": truncate}).encode())
    return begin


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class OperationWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.root, self.token = options["path"], options.get("token")

    def write(self, iterator: Iterator) -> Written:
        rows, name = [], f"{uuid.uuid4().hex}.parquet"
        for r in iterator:
            if r["file_path"] is None or r["op"] is None:
                raise ValueError(f"an operation needs file_path and op: {r}")
            rows.append({"timestamp": r["timestamp"], "file_path": r["file_path"], "op": r["op"], "status": r["status"], "file_hash": r["file_hash"]})
        if rows:
            sink = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_pylist(rows, schema=_FIELDS), sink)
            store, base = tree.opened(self.root)
            store.write(f"{base}/files/{name}", sink.getvalue().to_pybytes())
        return Written(name, len(rows))

    def commit(self, messages: list) -> None:
        _commit(self.root, [(m.name, m.rows) for m in messages if m is not None and m.rows], self.token)

    def abort(self, messages: list) -> None:
        store, base = tree.opened(self.root)
        for m in messages:
            if m is not None and m.rows:
                store.remove(f"{base}/files/{m.name}")


@dataclass
class File(InputPartition):
    name: str
    begin: int

    def __post_init__(self) -> None:
        super().__init__(self.name)


class OperationReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]

    def partitions(self) -> list[File]:
        out = []
        for c in commits(self.root):
            at = c["begin"]
            for name, rows in c["files"]:
                out.append(File(name, at))
                at += rows
        return out or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.name:
            store, base = tree.opened(self.root)
            held = pq.read_table(pa.BufferReader(store.read(f"{base}/files/{partition.name}")), schema=_FIELDS)
            seq = pa.array(range(partition.begin, partition.begin + held.num_rows), pa.int64())
            yield from held.add_column(0, "seq", seq).combine_chunks().to_batches()


class OperationLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "operation_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OperationReader:
        return OperationReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> OperationWriter:
        return OperationWriter(dict(self.options))


def append(records: DataFrame, path: str, token: str | None = None) -> None:
    """Add records (file_path, op, and perhaps timestamp, status, file_hash) in one commit; without a status they are pending, without a time of now."""
    spark = records.sparkSession
    spark.dataSource.register(OperationLog)
    have = lambda c, other: F.coalesce(F.col(c), other) if c in records.columns else other
    rows = records.select(
        have("timestamp", F.lit(int(time.time() * 1000))).cast("long").alias("timestamp"), F.col("file_path").cast("string").alias("file_path"), F.col("op").cast("string").alias("op"),
        have("status", F.lit("Pending")).alias("status"), have("file_hash", F.lit(None)).cast("string").alias("file_hash"),
    )
    rows.write.format("operation_log").mode("append").options(**({"token": token} if token else {})).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(seq, timestamp, file_path, op, status, file_hash) of all committed records since the last truncation."""
    spark.dataSource.register(OperationLog)
    return spark.read.format("operation_log").load(path)


def truncate(path: str, stale_seconds: float = STALE) -> None:
    """Start the log anew and delete what no reader can see: files and commits from before, and drafts of writers that have ended."""
    old = commits(path)
    _commit(path, [], None, truncate=True)
    store, base = tree.opened(path)
    named = {name for c in old for name, _ in c["files"]}
    now = time.time() * 1e6
    try:
        there = list(store.entries(f"{base}/files"))
    except (OSError, pa.ArrowException):
        there = []
    for e in there:
        if e.name in named or now - e.modified >= stale_seconds * 1e6:
            store.remove(f"{base}/files/{e.name}")
    for name in _names(path, "commits")[:-1]:
        store.remove(f"{base}/commits/{name}")
