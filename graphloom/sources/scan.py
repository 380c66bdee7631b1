"""File scans and the search of raw file text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import language
from graphloom.sources import tree


def _qualified(spark: SparkSession, root: str) -> str:
    """The root with its store; a plain path is one of the default store."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    return top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()


def loaded(spark: SparkSession, root: str, languages: tuple[str, ...] | None = None, skipped: tuple[str, ...] = language.SKIPPED, content: bool = True) -> DataFrame:
    """(path, size, modified, text, error): files of known languages below the root, outside skipped directories, listed and read by the executors."""
    tree.register(spark)
    at = _qualified(spark, root)
    wanted = [e for e, lang in language.extensions() if not languages or lang in languages]
    options = {"skipped": json.dumps(skipped), "extensions": json.dumps(wanted), "partitions": str(4 * spark.sparkContext.defaultParallelism), "content": str(content).lower()}
    return spark.read.format("source_tree").options(**options).load(at)


def scan(spark: SparkSession, root: str, languages: tuple[str, ...] | None = None, skipped: tuple[str, ...] = language.SKIPPED) -> DataFrame:
    """(path, text, language, size) of the files that could be read. Paths are relative to the root; what can't be read is in ``failed``."""
    held = loaded(spark, root, languages, skipped).where("error is null").withColumn("language", language.language_of(F.col("path"))).where("language is not null")
    return held.select("path", "text", "language", "size")


def read(spark: SparkSession, root: str, paths: DataFrame, skipped: tuple[str, ...] = language.SKIPPED) -> DataFrame:
    """(path, text, language, size) of those of these paths (path, below the root) that are there and can be read, without a listing."""
    at = _qualified(spark, root)

    def run(batches):
        for batch in batches:
            store, base = tree.opened(at)
            for path in batch.column(0).to_pylist():
                try:
                    data = store.read(f"{base}/{path}")
                except (OSError, pa.ArrowException):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data.decode("utf-8", "replace")]), pa.array([len(data)], pa.int64())], names=["path", "text", "size"])

    wanted = paths.select("path").distinct().where(~language.ignored(F.col("path"), names=skipped)).withColumn("language", language.language_of(F.col("path"))).where("language is not null")
    return wanted.select("path").mapInArrow(run, "path string, text string, size long").withColumn("language", language.language_of(F.col("path"))).select("path", "text", "language", "size")


def failed(spark: SparkSession, root: str, languages: tuple[str, ...] | None = None, skipped: tuple[str, ...] = language.SKIPPED) -> DataFrame:
    """(path, error) of files and folders that can't be read."""
    return loaded(spark, root, languages, skipped).where("error is not null").select("path", "error")


def write_files(files: DataFrame, root: str) -> int:
    """Write (path, content) rows as files below the root, from the executors; a file that is there is replaced. Gives their number."""

    def run(batches):
        for batch in batches:
            store, base = tree.opened(root)
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} is outside of the root")
                store.write(f"{base}/{path}", content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def changes(spark: SparkSession, root: str, listings: str, skipped: tuple[str, ...] = language.SKIPPED, buckets: int = 64) -> DataFrame:
    """A stream of (path, ts, event_type, size): what is created, changed and removed below the root from one listing to the next. ``listings`` is a
    shared folder of this stream alone. A change that keeps both size and time isn't seen."""
    tree.register(spark)
    options = {"skipped": json.dumps(skipped), "extensions": json.dumps([e for e, _ in language.extensions()]), "listings": listings, "buckets": str(buckets)}
    return spark.readStream.format("source_tree_changes").options(**options).load(root)


def scan_all(spark: SparkSession, root: str, tool_dirs: tuple[str, ...] = ()) -> DataFrame:
    """All supported languages; build output and the tool's own folders are left out too."""
    return scan(spark, root, skipped=(*language.SKIPPED, "target", *tool_dirs))


def grep(files: DataFrame, needle: str, most_files: int = 3, around: int = 2) -> DataFrame:
    """(path, line, text, context, tokens): the first line of each file that holds the string, in the first files by path."""
    lines = files.where(F.contains("text", F.lit(needle))).select("path", F.split("text", "\n").alias("lines"))
    first = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit(needle))), True).cast("int")
    hit = lines.withColumn("line", first).where("line > 0").orderBy("path").limit(most_files)
    begin = F.greatest(F.lit(1), F.col("line") - around)
    context = F.array_join(F.slice("lines", begin, F.col("line") + around - begin + 1), "\n")
    return hit.select("path", "line", F.get("lines", F.col("line") - 1).alias("text"), context.alias("context"), F.greatest(F.lit(1), F.floor(F.octet_length(context) / 4)).cast("long").alias("tokens"))


def grep_batch(files: DataFrame, needles: DataFrame, most_files: int = 3) -> DataFrame:
    """(word, path, line): for many words at once, the first line of each in the first files by path. Lines are cut into words and
    joined on them, so that no file meets every needle."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    words = lines.select("path", (F.col("line") + 1).alias("line"), F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}_]+"))).alias("word")).where("word != ''")
    hit = words.join(needles.select("word"), "word", "left_semi").groupBy("word", "path").agg(F.min("line").alias("line"))
    place = F.row_number().over(Window.partitionBy("word").orderBy("path"))
    return hit.withColumn("place", place).where(F.col("place") <= most_files).drop("place")
