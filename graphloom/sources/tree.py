"""Source trees as Spark data sources: ``source_tree`` reads the files below a root, ``source_tree_changes`` streams what changes there.

Reading: the planner lists folders breadth first, only until it has enough partitions, and remembers no file name. A partition is a
folder's own files, or whole subtrees of it; folders of many entries are dealt to several partitions by a hash of the names.
Executors list their folders again, open what is wanted and give rows in batches of bounded size, so neither the number of files nor
that of folders meets a limit on the driver.

Defined results: names are taken as they are, whatever patterns or escapes they look like; names and contents that are no UTF-8 are read
with U+FFFD in place of what can't be read; a file that can't be opened, or is larger than ``largest``, is a row with an ``error`` and no
text, and the others are read; folders that can't be listed give such a row too. Links are followed, to files and to folders, so a file
has a row for each way to it; a link to a folder that encloses it is not entered again. An empty root gives no rows, a missing one fails.

Streaming: an offset names a stored listing (path, size, time of change) of the whole tree, dealt into buckets by a hash of the path. A
micro-batch is the difference of two listings, bucket by bucket on executors; buckets of the same digest aren't read. Listings are
written before their offset is used, so a batch that is run again after a failure or a restart gives the same rows. Listings before a
committed offset are deleted. The walk of a listing streams into the bucket files; only counts and digests stay in memory.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from graphloom.functions import language

SCHEMA = "path string, size long, modified timestamp, text string, error string"
CHANGES = "path string, ts timestamp, event_type string, size long"
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("text", pa.string()), ("error", pa.string())])
_CHANGES = pa.schema([("path", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("event_type", pa.string()), ("size", pa.int64())])
_LISTING = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64())])
#: Rows and bytes of a batch.
ROWS, BYTES = 1_000, 4_000_000


@dataclass
class Entry:
    """A name in a folder; ``modified`` in microseconds."""

    name: str
    folder: bool
    size: int = 0
    modified: int = 0
    error: str | None = None


class LocalFiles:
    """Files that the operating system opens."""

    def entries(self, folder: str) -> Iterator[Entry]:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    held = e.stat()
                    yield Entry(e.name, e.is_dir(), held.st_size, held.st_mtime_ns // 1000)
                except OSError as problem:  # a link to nothing, or gone since
                    yield Entry(e.name, False, error=_said(problem))

    def read(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    def write(self, path: str, content: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{os.getpid()}.draft"
        with open(draft, "wb") as f:
            f.write(content)
        os.replace(draft, path)

    def remove(self, path: str) -> None:
        os.remove(path)

    def real(self, path: str) -> str:
        return os.path.realpath(path)


class RemoteFiles:
    """Files of a store that the Arrow library opens; it has no links."""

    def __init__(self, store: fs.FileSystem) -> None:
        self.store = store

    def entries(self, folder: str) -> Iterator[Entry]:
        for info in self.store.get_file_info(fs.FileSelector(folder)):
            yield Entry(info.base_name, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1000)

    def read(self, path: str) -> bytes:
        with self.store.open_input_stream(path) as f:
            return f.read()

    def write(self, path: str, content: bytes) -> None:
        self.store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.store.open_output_stream(path) as f:
            f.write(content)

    def remove(self, path: str) -> None:
        self.store.delete_file(path)

    def real(self, path: str) -> str:
        return path


def opened(root: str) -> tuple[LocalFiles | RemoteFiles, str]:
    """The store of a path or URI, and the path in it."""
    if root.startswith("file:"):
        return LocalFiles(), "/" + root[5:].lstrip("/")
    if "://" in root:
        store, path = fs.FileSystem.from_uri(root)
        return (LocalFiles() if isinstance(store, fs.LocalFileSystem) else RemoteFiles(store)), path
    return LocalFiles(), os.path.abspath(root)


def _said(problem: Exception) -> str:
    return f"{type(problem).__name__}: {getattr(problem, 'strerror', None) or problem}"


def _shown(path: str) -> str:
    """A path as valid text: bytes that are no UTF-8 become U+FFFD."""
    return path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


@dataclass
class Part(InputPartition):
    """Of a folder: its own files, its subtrees or both; those whose name's hash leaves ``at`` of ``of``."""

    folder: str
    files: bool = True
    trees: bool = True
    at: int = 0
    of: int = 1

    def __post_init__(self) -> None:
        super().__init__(self.folder)

    def has(self, name: str) -> bool:
        return self.of == 1 or zlib.crc32(name.encode("utf-8", "surrogateescape")) % self.of == self.at


class Walk:
    """What the options of a scan leave of a tree. ``options``: path, skipped and extensions (JSON lists), largest, partitions, content."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.skipped = frozenset(json.loads(options.get("skipped", "null")) or language.SKIPPED)
        wanted = json.loads(options.get("extensions", "null"))
        self.extensions = frozenset(wanted) if wanted is not None else None
        self.largest = int(options.get("largest", 512_000_000))
        self.wanted = max(1, int(options.get("partitions", 64)))
        self.per_part = max(1, int(options.get("filespartition", 2_000)))
        self.content = options.get("content", "true").lower() == "true"

    def known(self, path: str) -> bool:
        return self.extensions is None or path.rsplit(".", 1)[-1] in self.extensions

    def plan(self) -> list[Part]:
        """Partitions that cover each file once."""
        store, base = opened(self.root)
        if not store.entries(base):
            return []
        out: list[Part] = []
        queue = deque([""])
        while queue:
            if len(out) + len(queue) >= self.wanted:
                return out + [Part(f) for f in queue]
            at, files, below, trees = queue.popleft(), 0, [], 0
            try:
                for e in store.entries(os.path.join(base, at)):
                    if e.name in self.skipped:
                        continue
                    if e.folder:
                        trees += 1
                        if trees <= self.wanted:
                            below.append(os.path.join(at, e.name))
                    else:
                        files += 1
            except OSError:
                if not at:
                    raise
                files = 1  # the reader says so in a row
            k = -(-files // self.per_part)
            out += [Part(at, True, False, i, k) for i in range(k)]
            if trees > self.wanted:
                out += [Part(at, False, True, i, self.wanted) for i in range(self.wanted)]
            else:
                queue.extend(f for f in below if self._enters(store, base, f))
        return out

    def _enters(self, store, base: str, folder: str) -> bool:
        """False for a link to a folder that encloses it."""
        path = os.path.join(base, folder)
        parts = folder.split("/")
        above = {store.real(os.path.join(base, *parts[:k])) for k in range(len(parts))}
        return store.real(path) not in above

    def files(self, part: Part) -> Iterator[tuple[str, str, Entry]]:
        """(path below the root, path in the store, entry) of the files of a partition, folder by folder in the order of names; folders and entries that can't be listed too."""
        store, base = opened(self.root)
        stack = [(part.folder, True)]
        while stack:
            at, top = stack.pop()
            below, held = [], []
            try:
                for e in store.entries(os.path.join(base, at)):
                    if e.name in self.skipped or (top and not part.has(e.name)):
                        continue
                    if not e.folder:
                        held.append(e) if part.files or not top else None
                    elif part.trees or not top:
                        below.append(os.path.join(at, e.name))
            except OSError as problem:
                if part.files:
                    yield at, os.path.join(base, at), Entry(os.path.basename(at), True, error=_said(problem))
                continue
            for e in sorted(held, key=lambda e: e.name):
                path = os.path.join(at, e.name)
                if self.known(path):
                    yield path, os.path.join(base, path), e
            stack += [(f, False) for f in sorted(below, reverse=True) if self._enters(store, base, f)]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Part]:
        return Walk(self.options).plan() or [Part("", False, False)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        walk = Walk(self.options)
        store, _ = opened(walk.root)
        rows: list[dict] = []
        held = 0
        for path, place, e in walk.files(partition):
            text, error = None, e.error
            if error is None and walk.content:
                try:
                    if e.size > walk.largest:
                        raise OSError(f"{e.size} bytes are more than {walk.largest}")
                    text = store.read(place).decode("utf-8", "replace")
                except (OSError, pa.ArrowException) as problem:
                    error = _said(problem)
            rows.append({"path": _shown(path), "size": e.size, "modified": e.modified, "text": text, "error": error})
            held += len(text or "")
            if len(rows) >= ROWS or held >= BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``; options: see ``Walk``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


@dataclass
class Bucket(InputPartition):
    """One bucket of two listings."""

    number: int
    start: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(self.number)


class TreeChanges(DataSourceStreamReader):
    """Options of ``Walk``, and ``listings``: a folder that the driver and all executors share, which only this query uses; ``buckets``."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.listings = _local(options["listings"])
        self.buckets = int(options.get("buckets", 64))

    def initialOffset(self) -> dict:
        """Before all listings: the first batch gives each file as created."""
        return {"listing": 0}

    def _meta(self, n: int) -> dict:
        if not n:
            return {"time": 0, "digests": [hashlib.sha256().hexdigest()] * self.buckets}
        with open(f"{self.listings}/{n:012d}/meta.json") as f:
            return json.load(f)

    def latestOffset(self) -> dict:
        """Lists the tree, and stores the listing if it differs from the newest one."""
        os.makedirs(self.listings, exist_ok=True)
        held = sorted(int(n) for n in os.listdir(self.listings) if n.isdigit())
        last = held[-1] if held else 0
        draft = f"{self.listings}/draft-{os.getpid()}-{time.time_ns()}"
        os.makedirs(draft)
        try:
            digests = self._write(draft)
            if digests == self._meta(last)["digests"]:
                return {"listing": last}
            with open(f"{draft}/meta.json", "w") as f:
                json.dump({"time": time.time_ns() // 1000, "digests": digests}, f)
            os.rename(draft, f"{self.listings}/{last + 1:012d}")
            return {"listing": last + 1}
        finally:
            shutil.rmtree(draft, ignore_errors=True)

    def _write(self, folder: str) -> list[str]:
        rows: list[list[dict]] = [[] for _ in range(self.buckets)]
        writers = [pq.ParquetWriter(f"{folder}/{b:05d}.parquet", _LISTING) for b in range(self.buckets)]
        digests = [hashlib.sha256() for _ in range(self.buckets)]

        def flush(b: int) -> None:
            writers[b].write_table(pa.Table.from_pylist(rows[b], schema=_LISTING))
            rows[b].clear()

        for path, _, e in Walk(self.options).files(Part("")):
            if e.error is None:
                row = {"path": _shown(path), "size": e.size, "modified": e.modified}
                b = zlib.crc32(row["path"].encode()) % self.buckets
                digests[b].update(json.dumps(row).encode())
                rows[b].append(row)
                if len(rows[b]) >= ROWS:
                    flush(b)
        for b, w in enumerate(writers):
            flush(b)
            w.close()
        return [d.hexdigest() for d in digests]

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        a, b = start["listing"], end["listing"]
        before, after = self._meta(a)["digests"], self._meta(b)["digests"]
        return [Bucket(k, a, b) for k in range(self.buckets) if a != b and before[k] != after[k]]

    def _bucket(self, n: int, k: int) -> dict[str, tuple[int, int]]:
        if not n:
            return {}
        held = pq.read_table(f"{self.listings}/{n:012d}/{k:05d}.parquet", schema=_LISTING)
        return dict(zip(held.column("path").to_pylist(), zip(held.column("size").to_pylist(), held.column("modified").to_pylist(), strict=True), strict=True))

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        was, now = self._bucket(partition.start, partition.number), self._bucket(partition.end, partition.number)
        at = self._meta(partition.end)["time"]
        rows = [(p, "modify_data" if p in was else "create", x[0]) for p, x in now.items() if was.get(p) != x]
        rows += [(p, "remove", x[0]) for p, x in was.items() if p not in now]
        for k in range(0, len(rows), 10_000):
            path, kind, size = zip(*rows[k : k + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array([at] * len(path), pa.timestamp("us", "UTC")), pa.array(kind), pa.array(size, pa.int64())], schema=_CHANGES)

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.listings):
            if name.isdigit() and int(name) < end["listing"]:
                shutil.rmtree(f"{self.listings}/{name}", ignore_errors=True)

    def stop(self) -> None:
        """Nothing is held open."""


def _local(path: str) -> str:
    """Listings need a folder that is mounted everywhere."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"listings must be a mounted folder, not {path}")
    return opened(path)[1]


class SourceTreeChanges(DataSource):
    """``spark.readStream.format("source_tree_changes").option("listings", folder).load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> TreeChanges:
        return TreeChanges(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(SourceTreeChanges)
