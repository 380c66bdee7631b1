"""One class over an index: each method of the service surface, as DataFrames; ``call`` gives answers as JSON-ready values."""

from __future__ import annotations

import inspect
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import output, schema
from graphloom.functions import budget, scoring, text
from graphloom.functions.language import of_extension
from graphloom.operators import graph, incremental, matching, relational, trigrams
from graphloom.sources import scan, store
from graphloom.sources.extract import registry

#: Methods whose answers are cached.
CACHED = frozenset({"read", "neighbors", "impact", "search", "stats"})
STAGES = ("static_refs", "dynamic_refs", "string_refs", "git_history", "test_refs")


class CodeGraph:
    """``tables``: symbols, refs, files, literals and perhaps overrides; ranks are computed by ``rank``."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], ttl_ms: int = 300_000) -> None:
        self.spark, self.tables = spark, dict(tables)
        self.tables.setdefault("ranks", spark.createDataFrame([], schema.RANKS))
        self.tables.setdefault("overrides", spark.createDataFrame([], schema.OVERRIDES))
        self.cache = incremental.ResultCache(ttl_ms)
        self.language, self.form = None, "json"

    @classmethod
    def index(cls, spark: SparkSession, root: str) -> CodeGraph:
        return cls(spark, registry.index(scan.scan_all(spark, root)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeGraph:
        return cls(spark, store.load(spark, path))

    def save(self, path: str, *names: str) -> None:
        """Write the named tables, all by default, promote them, and go on from what was written: plans don't grow with each save."""
        store.save(self.spark, path, {n: self.tables[n] for n in names or store.SCHEMAS if n in self.tables})
        self.tables |= store.load(self.spark, path)

    def update(self, path: str, root: str, paths: DataFrame | None = None) -> dict[str, dict]:
        """Bring the index saved at ``path`` up to the tree, or to the state of the given paths in it alone: only buckets of files that are new,
        changed or gone are rewritten. Gives what was written, by table; nothing if nothing changed."""
        stored = store.load(self.spark, path)
        now = scan.scan_all(self.spark, root) if paths is None else scan.read(self.spark, root, paths)
        changed, fresh = registry.changes(stored, now, paths)
        out = store.update(self.spark, path, changed, fresh) if not changed.isEmpty() else {}
        self.tables |= store.load(self.spark, path)
        self.cache.held.clear()
        return out

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def reindex(self, root: str) -> None:
        self.tables |= registry.reindex(self.tables, scan.scan_all(self.spark, root))
        self.cache.held.clear()  # answers must not outlive the index they came from

    def rank(self, damping: float = 0.85, max_iter: int = 100, tolerance: float = 1e-6) -> DataFrame:
        found = graph.pagerank(graph.edge_list(self.refs), damping, max_iter, tolerance)
        self.tables["ranks"] = graph.combined_rank(self.symbols, self.refs, found)
        return relational.top_ranks(self.ranks)

    def call_ranks(self, n: int = 20) -> list:
        return relational.top_ranks(self.ranks, n).collect()

    def stats(self) -> DataFrame:
        return relational.stats(self.files, self.symbols, self.refs)

    def search(self, query: str, kind: str | None = None, limit: int = 20, use_like: bool = False, min_score: float = 0.3, compat: bool = True, language: str | None = None) -> DataFrame:
        symbols = self.symbols.where(F.col("language") == language) if language else self.symbols
        if use_like:
            return relational.search_ranked(symbols, self.ranks, query, limit)
        return relational.search_fuzzy(symbols, self.ranks, query, kind, min_score, limit, compat=compat)

    def neighbors(self, symbol: str) -> DataFrame:
        return relational.neighbors(self.refs, symbol)

    def impact(self, symbol: str) -> DataFrame:
        return relational.callers_ranked(self.symbols, self.refs, self.ranks, symbol)

    def impact_deep(self, symbol: str, depth: int = 3, include_tests: bool = False, include_dynamic: bool = True) -> dict:
        return graph.impact_deep(self.symbols, self.refs, symbol, depth, include_tests, include_dynamic)

    def read(self, symbol: str, level: str = "critical_branches", root: str = "") -> DataFrame:
        hit = relational.read_symbol(self.symbols, self.files, symbol, root)
        return text.compress(hit, F.col("text"), F.col("start_line"), F.col("end_line"), level).drop("text")

    def edit_plan(self, symbol: str, changes: list[dict]) -> DataFrame:
        return graph.edit_plan(self.symbols, self.refs, symbol, changes)

    def dead_code_verify(self, symbol: str, stages: tuple[str, ...] = STAGES, commits: DataFrame | None = None) -> DataFrame:
        """``commits`` comes from ``sources.commits``; without it the history stage gives nothing."""
        return graph.dead_code(self.symbols, self.refs, symbol, tuple(stages), commits)

    def cross_module_move(self, symbol: str, module: str, update_imports: bool = True) -> DataFrame:
        return graph.module_move(self.symbols, self.refs, symbol, module, self.language, update_imports)

    def signature_migration_check(self, symbol: str, new_signature: str) -> DataFrame:
        return graph.signature_check(self.symbols, self.refs, symbol, new_signature)

    def string_refs(self, symbol: str, least: float = 0.5) -> DataFrame:
        return matching.string_refs_of(matching.string_matches(self.literals, self.symbols), self.literals, self.symbols, symbol, least)

    def cross_language(self) -> DataFrame:
        return matching.cross_language(self.symbols)

    def verify(self, root: str) -> DataFrame:
        from graphloom.functions.blake3 import content_hash

        now = scan.scan_all(self.spark, root).withColumn("hash", content_hash(F.col("text")))
        return incremental.integrity_status(self.files, now)

    def grep(self, needle: str) -> DataFrame:
        """The raw text, for what the index doesn't know."""
        return scan.grep(self.files, needle)

    def search_many(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """(qid, place, id, ...) of many queries (qid, query) at once, misspelt ones too."""
        return relational.search_batch(self.symbols, self.ranks, queries, limit)

    def index_text(self, path: str) -> None:
        """Write an index of all files' texts below ``path``, for ``find``."""
        trigrams.save(self.files.select(F.col("path").alias("key"), "text"), path)

    def find(self, path: str, needles: DataFrame, fold: bool = False) -> DataFrame:
        """(nid, needle, key): the files that hold each of many strings (nid, needle), by the index at ``path``."""
        return trigrams.search(trigrams.load(self.spark, path), needles, fold)

    def dot(self, symbol: str | None = None) -> DataFrame:
        return output.ego_dot(self.neighbors(symbol), symbol) if symbol else output.full_dot(self.symbols, self.stats())

    def add_override(self, caller: str, callee: str, confidence: float = 0.9, reason: str | None = None, kind: str = "override") -> int:
        top = self.overrides.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
        row = self.spark.createDataFrame([(top, caller, callee, kind, confidence, reason)], schema.OVERRIDES)
        self.tables["overrides"] = self.overrides.unionByName(row)
        return top

    def remove_override(self, override_id: int) -> None:
        self.tables["overrides"] = self.overrides.where(F.col("id") != override_id)

    # -- answers

    METHODS = ("read", "neighbors", "impact", "search", "stats", "edit_plan", "verify", "impact_deep", "dead_code_verify", "cross_module_move", "signature_migration_check")

    def call(self, method: str, params: dict | None = None, token_budget: int | None = None) -> dict:
        """A method's answer; the budget holds for cached answers too."""
        if method not in self.METHODS:
            raise ValueError(f"unknown method {method!r}")
        params = params or {}
        value = self.cache.get(method, params) if method in CACHED else None
        if value is None:
            found = getattr(self, method)(**params)
            value = {k: _rows(v) for k, v in found.items()} if isinstance(found, dict) else {"results": _rows(found)}
            if "results" in value:
                value["count"] = len(value["results"])
            value = json.loads(json.dumps(value, default=str))
            if method in CACHED:
                self.cache.set(method, params, value)
        return budget.budgeted(value, token_budget) or value

    def tools(self) -> list[dict]:
        """Each method with the JSON schema of its parameters, from its signature."""
        kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}

        def one(method: str) -> dict:
            args = {n: p for n, p in inspect.signature(getattr(self, method)).parameters.items() if n != "commits"}
            shape = lambda p: {"type": kinds.get(str(p.annotation).removesuffix(" | None"), "array")}
            properties = {n: shape(p) for n, p in args.items()} | {"token_budget": {"type": "integer"}, "preferredFormat": {"type": "string"}}
            return {"name": method, "inputSchema": {"type": "object", "properties": properties, "required": [n for n, p in args.items() if p.default is p.empty]}}

        return [one(m) for m in self.METHODS]

    def serve(self, request: dict) -> dict | None:
        """A JSON-RPC request: initialize, ping, tools/list, tools/call, or a method by its name, with or without a dotted name space.

        Notifications have no answer. A client's preferred format holds for its later calls that name none."""
        rid, method, params = request.get("id"), str(request.get("method") or ""), request.get("params") or {}
        if method.startswith("notifications/") or method == "logging/message":
            return None
        try:
            if method == "initialize":
                self.form = (params.get("capabilities") or {}).get("preferredFormat", self.form)
                result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "graphloom"}, "formats": ["json", "toon", "text"]}
            elif method == "ping":
                result = {}
            elif method == "tools/list":
                result = {"tools": self.tools()}
            else:
                name, args = (params.get("name"), params.get("arguments") or {}) if method == "tools/call" else (method.rsplit(".", 1)[-1], params)
                if name not in self.METHODS:
                    return {"jsonrpc": "2.0", "id": rid, "error": {"code": -32601, "message": f"Method not found: {name}"}}
                args = dict(args)
                form, most = args.pop("preferredFormat", self.form), args.pop("token_budget", None)
                value = self.call(name, args, most)
                result = {"content": output.to_toon(value) if form == "toon" else value}
            return {"jsonrpc": "2.0", "id": rid, "result": result}
        except Exception as e:  # noqa: BLE001
            code = error_code(str(e))
            number, advice = scoring.ERRORS[code]
            return {"jsonrpc": "2.0", "id": rid, "error": {"code": number, "message": str(e), "data": {"kind": code, "action": advice}}}


def error_code(message: str) -> str:
    """The class of an error by its words."""
    for code, words in scoring.ERROR_WORDS:
        if any(w in message for w in words):
            return code
    return "DatabaseError"


def _rows(value):
    """Rows of a limited result, as dictionaries."""
    return [r.asDict(recursive=True) for r in value.collect()] if isinstance(value, DataFrame) else value


def language_of(path: str) -> str | None:
    return of_extension(path)
