"""What the training-data operators share: folds, shared-folder tables, text batches, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters that the contracts lower-case; all others stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def agreed(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row a labelled id, of labels 0 and 1; ids without label, or labelled both ways, are left out."""
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    return some.groupBy(id_col).agg(F.min(label_col).alias(label_col), F.max(label_col).alias("__most")).where(F.col(label_col) == F.col("__most")).drop("__most")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. A temporary one is set only where a local session names none, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(paths: list[str]) -> None:
    """Through the file system that holds them, as the folder need not be a local one."""
    spark = SparkSession.getActiveSession()
    for path in paths:
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        elif spark is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for the last one. What is lazy beyond must read that one alone."""
    begin = len(_written)
    yield
    _delete(_written[begin:-1])
    del _written[begin:-1]


@atexit.register
def _sweep() -> None:
    """Leave nothing in the shared folder when the driver ends."""
    with contextlib.suppress(Exception):  # the session may be gone, and with it the way to a remote folder
        _delete(_written)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def map_text(df: DataFrame, text: Column, make: Callable[[], Callable[[list], list]], schema: str, keep: dict[str, Column], most: int = 2_000_000) -> DataFrame:
    """Add columns computed from each whole text, about ``most`` bytes of them at a time. ``make()`` runs once a task and gives a function from a list of
    UTF-8 texts (bytes or None) to one Arrow array a column of ``schema``. ``keep`` passes through untouched."""
    names = list(keep)
    source = df.select(*(c.alias(n) for n, c in keep.items()), text.cast("string").alias("__text"))
    kept = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in by_bytes(batch, most):
                out = fn(part.column(len(names)).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *out], names=[*names, *out_names])
        del fn
        release()

    out_names = [f.strip().split(" ")[0] for f in split_top(schema)]
    return source.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def release() -> None:
    """Give a worker's free memory back: idle workers stay, and each kind of task would leave its peak behind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def split_top(schema: str) -> list[str]:
    """Fields of a DDL schema, not split inside <>."""
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def by_bytes(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, by the bytes of its last column, so that a task's memory doesn't follow the text lengths."""
    column = batch.column(batch.num_columns - 1)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


#: Rows of one key that one task of a spread join gets, about; keys above it that may be broadcast.
HOT, MOST_HOT = 1_000, 1_000_000


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, by: str) -> DataFrame:
    """``left`` joined with ``right``, one row a key, whose column ``n`` is the key's rows on the left. Keys of more than ``HOT`` rows are
    dealt by ``by`` over as many tasks as they need; their list is broadcast if it is short, and else AQE splits skewed partitions."""
    parts = F.ceil(F.col(n) / HOT).cast("int")
    hot = materialize(right.where(F.col(n) > HOT).select(key, parts.alias("__parts")))
    if not 0 < hot.count() <= MOST_HOT:
        return left.join(right, key)
    salted = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    every = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return salted.join(every, [key, "__salt"]).drop("__salt")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long): the smallest node reachable.

    Alternating large-star and small-star steps, each written to the shared folder; only a count reaches the driver."""
    edges = materialize(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low, "a", "n", "b").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").where(F.col("a") != F.col("b")).distinct()
        small = materialize(small)
        # done when each node has one link, to its root, and no root has a link itself
        roots = small.select(F.col("b").alias("a")).distinct()
        open_ = small.join(roots, "a", "left_semi").limit(1).count() or small.groupBy("a").count().where("count > 1").limit(1).count()
        edges = small
        if not open_:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def most_frequent(counts: DataFrame, n: str, most: int, key: str) -> Column:
    """A condition that about ``most`` rows at most meet, those of largest ``n``: a size bound for what is collected or broadcast.

    Counts are binned on a log scale, so at most about a thousand rows reach the driver whatever the table's size. Whole bins are taken
    from the top; of the bin that the bound cuts, the rows whose key has the least hash."""
    bins = counts.where(F.col(n) > 0).groupBy(_bin(n).alias("bin")).agg(F.count("*").alias("k")).orderBy(F.desc("bin")).collect()
    return _condition([(r.bin, r.k) for r in bins], n, most, key)


def _bin(n: str) -> Column:
    return F.floor(F.log2(F.col(n)) * 16)


def _condition(bins: list[tuple[int, int]], n: str, most: int, key: str) -> Column:
    left, span = most, 1 << 30
    for bin_, k in bins:
        if k > left:
            at, some = _bin(n), F.pmod(F.xxhash64(key), F.lit(span)) < int(span * left / k)
            return F.coalesce((F.col(n) > 0) & ((at > bin_) | ((at == bin_) & some)), F.lit(False))
        left -= k
    return F.coalesce(F.col(n) > 0, F.lit(False))


def most_frequent_each(counts: DataFrame, n: str, most: int, key: str, group: str) -> Column:
    """``most_frequent`` within each value of ``group``, of which there are few."""
    bins: dict = {}
    for r in counts.where(F.col(n) > 0).groupBy(group, _bin(n).alias("bin")).agg(F.count("*").alias("k")).orderBy(F.desc("bin")).collect():
        bins.setdefault(r[group], []).append((r.bin, r.k))
    out = F.lit(False)
    for value, b in sorted(bins.items()):
        out = F.when(F.col(group) == value, _condition(b, n, most, key)).otherwise(out)
    return out


#: Plans of these nodes alone give each row the same number at every run: files and their splits are fixed.
_FIXED = {"LogicalRelation", "LocalRelation", "Project", "Filter", "SubqueryAlias", "View"}


def numbered(df: DataFrame, name: str = "uid") -> DataFrame:
    """Add a row number that separate plans agree on. Rows of a scan get theirs in place; any other plan is written first, as a shuffle may
    deal its rows otherwise when a task is run again."""
    plans, fixed = [df._jdf.queryExecution().analyzed()], True
    while plans:
        plan = plans.pop()
        fixed = fixed and plan.nodeName() in _FIXED
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    numbered_ = df.withColumn(name, F.monotonically_increasing_id())
    return numbered_ if fixed else materialize(numbered_)
