"""The recovery journal: JSON lines of file operations, on the driver's side of the index."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphloom import schema


class Journal:
    """Appends are flushed to disk; readers skip broken lines. At ``rotate_bytes`` the file moves to an archive beside it."""

    def __init__(self, path: str, rotate_bytes: int = 10_000_000) -> None:
        self.path, self.rotate_bytes = Path(path), rotate_bytes
        self.seq = max((e["seq"] for e in self.entries()), default=0)

    def append(self, file_path: str, op: str, status: str = "Pending", file_hash: str | None = None) -> int:
        self.rotate()
        self.seq += 1
        entry = {"seq": self.seq, "timestamp": int(time.time() * 1000), "file_path": file_path, "op": op, "status": status, "file_hash": file_hash}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as f:
            f.write(json.dumps(entry, ensure_ascii=False) + "\n")
            f.flush()
            os.fsync(f.fileno())
        return self.seq

    def entries(self) -> list[dict]:
        if not self.path.exists():
            return []
        out = []
        for line in self.path.read_text(errors="replace").splitlines():
            try:
                entry = json.loads(line)
            except ValueError:
                continue
            if isinstance(entry, dict) and isinstance(entry.get("seq"), int):
                out.append(entry)
        return out

    def pending(self) -> list[dict]:
        return [e for e in self.entries() if e["status"] == "Pending"]

    def size(self) -> int:
        return self.path.stat().st_size if self.path.exists() else 0

    def truncate(self) -> None:
        if self.path.exists():
            self.path.write_text("")

    def rotate(self) -> Path | None:
        if self.size() < self.rotate_bytes:
            return None
        archive = self.path.with_suffix(f".{self.seq}.archive")
        self.path.rename(archive)
        return archive


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal as a DataFrame; lines that aren't entries fall away."""
    return spark.read.schema(schema.JOURNAL).json(path, mode="PERMISSIVE").where("seq is not null and file_path is not null")
