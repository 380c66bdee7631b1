"""Tables in the shared folder: they cut lineage in iterative jobs and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


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


def folder(spark: SparkSession) -> str:
    """A new place in the shared folder, which is deleted when the driver ends."""
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _written.append(at)
    return at


def written(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_tables: list[str] = []


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """The rows in ``buckets`` files by the hash of a column, sorted by it: a join on the column with another such table, or with rows hashed to as
    many partitions, moves none of them."""
    spark = df.sparkSession
    name, path = f"graphloom_{uuid.uuid4().hex}", folder(spark)
    df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", path).format("parquet").saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def drop_tables(spark: SparkSession) -> None:
    """Forget the bucketed tables; their files go when the driver ends, or with ``rounds``."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")


def delete(spark: SparkSession, path: str) -> None:
    """Through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def rounds(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for the last one, which is all that may be read beyond."""
    begin = len(_written)
    yield
    for path in _written[begin:-1]:
        delete(spark, path)
    del _written[begin:-1]


@atexit.register
def _sweep() -> None:
    """Leave nothing in the shared folder when the driver ends; the session may be gone by then, and with it the way to a remote folder."""
    spark = SparkSession.getActiveSession()
    for path in _written:
        with contextlib.suppress(Exception):
            if path.startswith(("file:", "/")):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            elif spark is not None:
                delete(spark, path)


#: Rows below which a side may be broadcast.
MOST_ROWS = 2_000_000
