"""The last commit of each file, from the version control of a source tree on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, last_commit string, message string"


def last_commits(spark: SparkSession, root: str) -> DataFrame:
    """(path, last_commit, message): one walk over the log, newest first; empty where there is no history."""
    try:
        said = subprocess.run(["git", "-C", root, "log", "--name-only", "--format=%x01%ai%x02%s"], capture_output=True, text=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return spark.createDataFrame([], SCHEMA)
    rows: dict[str, tuple[str, str]] = {}
    for entry in said.split("\x01")[1:]:
        head, _, names = entry.partition("\n")
        date, _, message = head.partition("\x02")
        for name in filter(None, names.split("\n")):
            rows.setdefault(name, (date, message))
    return spark.createDataFrame([(p, *v) for p, v in rows.items()], SCHEMA)
