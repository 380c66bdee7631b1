"""Settings from a TOML file; a missing file gives the defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Config:
    """``max_workers`` becomes Spark's shuffle parallelism; the watcher's times are milliseconds."""

    languages: list[str] = field(default_factory=list)
    ignore_dirs: list[str] = field(default_factory=list)
    max_workers: int = 0
    debounce_ms: int = 200
    max_batch: int = 50
    poll_interval_s: int = 5
    cache_ttl_s: int = 300
    token_budget: int = 0
    damping: float = 0.85
    max_iter: int = 100
    tolerance: float = 1e-6
    page_rank_enabled: bool = True

    @classmethod
    def load(cls, path: str) -> Config:
        p = Path(path)
        if not p.exists():
            return cls()
        known = {f.name for f in fields(cls)}
        flat: dict = {}
        for k, v in tomllib.loads(p.read_text()).items():
            flat |= v if isinstance(v, dict) else {k: v}
        return cls(**{k: v for k, v in flat.items() if k in known})

    def spark_conf(self) -> dict[str, str]:
        out = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
        return out | ({"spark.sql.shuffle.partitions": str(self.max_workers)} if self.max_workers else {})
