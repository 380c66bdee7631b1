"""Relational and graph operators on small tables, against hand-made values and brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, incremental, matching, relational

SYMBOL = "id long, file_path string, name string, kind string, start_line int, end_line int, qualified_name string, signature string, language string"
REF = "id long, caller_file string, caller_symbol string, callee_symbol string, ref_kind string, line int, confidence double, is_dynamic boolean"


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [
        (1, "src/a.py", "load", "function", 1, 9, "a.load", "def load(path, mode=None) -> str", "python"),
        (2, "src/a.py", "Load", "class", 20, 30, "a.Load", None, "python"),
        (3, "src/b.js", "load", "function", 1, 5, "b.load", "function load(x)", "javascript"),
        (4, "src/b.js", "run", "function", 6, 9, "b.run", None, "javascript"),
        (5, "tests/test_a.py", "test_load", "function", 1, 4, "tests.test_a.test_load", None, "python"),
        (6, "src/c.py", "main", "function", 1, 4, "c.main", None, "python"),
        (7, "src/c.py", "pre_%_x", "function", 6, 8, "c.pre_%_x", None, "python"),
    ]
    return spark.createDataFrame(rows, SYMBOL)


@pytest.fixture(scope="module")
def refs(spark):
    rows = [
        (1, "src/b.js", "run", "load", "call", 7, 1.0, False),
        (2, "src/c.py", "main", "run", "call", 2, 1.0, False),
        (3, "tests/test_a.py", "test_load", "load", "call", 3, 1.0, False),
        (4, "src/c.py", None, "load", "import", 1, 1.0, False),
        (5, "src/c.py", None, "load", "import", 1, 1.0, False),
        (6, "src/c.py", "main", "load", "dynamic_dispatch", 3, 0.7, True),
        (7, "src/c.py", "main", "load", "dynamic_dispatch", 3, 0.7, True),
        (8, "src/a.py", "load", "open", "call", 2, 1.0, False),
        (9, "src/a.py", "load", "main", "call", 3, 1.0, False),
    ]
    return spark.createDataFrame(rows, REF)


@pytest.fixture(scope="module")
def ranks(spark):
    return spark.createDataFrame([("load", 0.9, 5, 1), ("run", 0.4, 1, 1)], "symbol_name string, page_rank double, in_degree long, out_degree long")


def ids(df):
    return [r.id for r in df.collect()]


def test_searches(symbols, ranks):
    assert ids(relational.search(symbols, "load")) == [2, 1, 3, 5]
    assert ids(relational.search(symbols, "_%_")) == [7, 5] or set(ids(relational.search(symbols, "_%_"))) >= {5, 7}
    assert ids(relational.search(symbols, "_%_", escape=True)) == [7]
    assert ids(relational.search_ranked(symbols, ranks, "o", limit=4)) == [1, 3, 2, 5]
    found = relational.search_fuzzy(symbols, ranks, "load", kind="class").collect()
    assert [r.id for r in found][:3] == [1, 3, 2] or {r.id for r in found} == {1, 2, 3, 5}
    assert relational.search_fuzzy(symbols, ranks, "laod").count() == 0
    assert relational.search_fuzzy(symbols, ranks, "laod", compat=False).first().name in ("load", "Load")
    queries = symbols.sparkSession.createDataFrame([(1, "test_load"), (2, "nothing")], "qid int, query string")
    best = relational.search_batch(symbols, ranks, queries).where("place = 1").collect()
    assert [(r.qid, r.name) for r in best] == [(1, "test_load")]


def test_lookups(symbols, refs, ranks):
    assert relational.resolve_name(symbols, "b.load").first().name == "load"
    assert relational.resolve_name(symbols, "nowhere").first().name == "nowhere"
    assert ids(relational.file_symbols(symbols, "src/a.py")) == [1, 2]
    assert ids(relational.neighbors(refs, "run")) == [2, 1]
    assert ids(relational.callers(symbols, refs, "a.load")) == [4, 5, 6]
    assert [(r.name, r.page_rank) for r in relational.callers_ranked(symbols, refs, ranks, "load").collect()] == [("run", 0.4), ("main", None), ("test_load", None)]
    split = relational.neighbor_split(refs, "load").first()
    assert split.callers == ["main", "run", "test_load"] and split.callees == ["main", "open"]
    assert [r.symbol_name for r in relational.top_ranks(ranks, 1).collect()] == ["load"]


def test_unique_references_keep_null_callers(refs):
    assert sorted(ids(relational.deduplicated(refs))) == [1, 2, 3, 4, 5, 6, 8, 9]


def test_stats(symbols, refs):
    row = relational.stats(symbols.select("file_path").distinct(), symbols, refs).first()
    assert (row.files, row.symbols, row.refs) == (4, 7, 9)
    assert [tuple(r) for r in relational.index_summary(symbols, refs).orderBy("language").collect()] == [("javascript", 1, 2, 1), ("python", 3, 5, 8)]


def test_overrides(spark, symbols):
    over = spark.createDataFrame([(1, "run", "load", "override", 0.9)], "id long, caller_symbol string, callee_symbol string, ref_kind string, confidence double")
    assert {r.name for r in relational.uncovered(symbols.select("name").distinct(), over).collect()} == {"Load", "test_load", "main", "pre_%_x"}
    assert ids(relational.overrides_of(over, "load")) == [1]
    assert relational.without_override(over, over.select("id")).count() == 0


EDGES = {
    "chain": [("a", "b"), ("b", "c")],
    "hub": [("a", "h"), ("b", "h"), ("c", "h")],
    "cycle": [("a", "b"), ("b", "c"), ("c", "a")],
    "loop": [("a", "a")],
    "parts": [("a", "b"), ("c", "d")],
    "fan": [("a", "b"), ("a", "c"), ("a", "d")],
    "star": [("h", "a"), ("a", "h"), ("h", "b"), ("b", "h")],
    "parallel": [("a", "b"), ("a", "b"), ("a", "c"), ("b", "a")],
}


def brute_rank(edges, damping=0.85, rounds=100, tolerance=1e-6):
    nodes = sorted({x for e in edges for x in e})
    out = defaultdict(list)
    for s, d in edges:
        out[s].append(d)
    rank = {v: 1 / len(nodes) for v in nodes}
    for _ in range(rounds):
        spare = sum(rank[v] for v in nodes if not out[v])
        new = {v: (1 - damping) / len(nodes) + damping * spare / len(nodes) for v in nodes}
        for s in nodes:
            for d in out[s]:
                new[d] += damping * rank[s] / len(out[s])
        delta = sum(abs(new[v] - rank[v]) for v in nodes)
        rank = new
        if delta <= tolerance:
            break
    return rank


@pytest.mark.parametrize("shape", ["chain", "cycle", "loop", "parallel"])
def test_pagerank(spark, shape):
    edges = EDGES[shape]
    got = {r.name: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string"), max_iter=8, tolerance=1e-9).collect()}
    assert got == pytest.approx(brute_rank(edges, rounds=8, tolerance=1e-9))
    assert sum(got.values()) == pytest.approx(1.0)
    if shape == "cycle":
        assert all(v == pytest.approx(1 / 3) for v in got.values())


def test_pagerank_of_nothing(spark):
    assert graph.pagerank(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_combined_rank(symbols, refs):
    ranks = symbols.sparkSession.createDataFrame([("load", 0.5), ("open", 1.0)], "name string, rank double")
    got = {r.symbol_name: r for r in graph.combined_rank(symbols, refs, ranks).collect()}
    assert got["load"].in_degree == 6 and got["load"].out_degree == 2
    assert got["load"].page_rank == pytest.approx(0.7 * 0.5 + 0.3 * 8 / 12)
    assert got["Load"].page_rank == 0.0


def test_impact_layers(symbols, refs):
    rows = lambda **k: {(r.depth, r.name) for r in graph.impact_layers(symbols, refs, "load", **k).collect()}
    assert rows() == {(1, "run"), (1, "main")}
    assert rows(include_tests=True) == {(1, "run"), (1, "main"), (1, "test_load")}
    assert rows(cap=None) == rows()
    deep = graph.impact_deep(symbols, refs, "open", depth=3)
    assert [(r.depth, r.symbols, r.risk) for r in deep["layers"].collect()] == [(1, ["load"], "low"), (2, ["run", "main"], "medium")]
    assert deep["critical_path"] == "→ open → load → run"
    assert {r.name for r in deep["test_gaps"].collect()} == {"run", "main"}
    assert deep["recommendation"] == "Proceed with care. 2 symbols lack test coverage."
    assert graph.impact_deep(symbols, refs, "pre_%_x")["recommendation"].startswith("No transitive")


def test_impact_layers_by_brute_force(spark):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(90)]
    symbols = spark.createDataFrame([(i, "src/x.py", n, "function", 1, 2, f"x.{n}", None, "python") for i, n in enumerate(names)], SYMBOL)
    refs = spark.createDataFrame([(i, "src/x.py", a, b, "call", i, 1.0, False) for i, (a, b) in enumerate(edges)], REF)
    got = {(r.depth, r.name) for r in graph.impact_layers(symbols, refs, "n0", depth=4, cap=None).collect()}
    seen, layer, want = {"n0"}, {"n0"}, set()
    for d in range(1, 5):
        layer = {a for a, b in edges if b in layer} - seen
        seen |= layer
        want |= {(d, x) for x in layer}
    assert got == want


def test_edit_plan(symbols, refs):
    plan = graph.edit_plan(symbols, refs, "load", [{"change_type": "rename", "details": {"from": "load", "to": "read"}}])
    rows = plan.collect()
    assert {r.name for r in rows if r.part == "affected"} == {"load", "run", "main", "test_load", "open"}
    assert {r.description for r in rows if r.part == "breaking"} == {"Update reference from 'load' to 'read'"}
    total = graph.edit_plan_summary(plan).first()
    assert (total.affected, total.files, total.breaking, total.safe_to_proceed, total.estimated_tokens) == (5, 3, 3, True, 250)
    assert not graph.edit_plan_summary(graph.edit_plan(symbols, refs, "load", [{"change_type": "add_param", "details": {"param": "x"}}])).first().safe_to_proceed
    assert graph.edit_plan(symbols, refs, "load", [{"change_type": "rename"}]).where("part = 'breaking'").count() == 0


def test_dead_code(spark, symbols, refs):
    commits = spark.createDataFrame([("src/a.py", "2024-01-01", "Deprecate load")], "path string, last_commit string, message string")
    stages = {r.stage: (r.status, r.found) for r in graph.dead_code(symbols, refs, "load", ("static_refs", "dynamic_refs", "string_refs", "git_history", "test_refs"), commits).collect()}
    assert stages["static_refs"] == ("fail", ["main", "run", "test_load"])
    assert stages["dynamic_refs"] == ("fail", ["src/c.py (confidence: 0.7)"] * 2)
    assert stages["string_refs"] == ("warn", ["Load in src/a.py", "test_load in tests/test_a.py"])
    assert stages["git_history"] == ("warn", ["2024-01-01", "Deprecate load"])
    assert stages["test_refs"] == ("warn", ["test_load"])
    assert not graph.safe_to_delete(graph.dead_code(symbols, refs, "load")).first().safe_to_delete
    assert graph.safe_to_delete(graph.dead_code(symbols, refs, "test_load")).first().safe_to_delete
    assert {r.name for r in graph.static_dead_code(symbols, refs).collect()} == {"Load", "test_load", "pre_%_x"}


def test_move_and_signature(symbols, refs):
    plan = graph.module_move(symbols, refs, "run", "core.util", "python")
    assert {(r.part, r.path, r.action) for r in plan.collect()} == {("modify", "src/b.js", "delete_symbol"), ("modify", "core/util/util.py", "insert_symbol"), ("modify", "src/c.py", "update_import")}
    assert graph.move_summary(plan).first().safe_to_execute
    open_ = graph.module_move(symbols, refs, "load", "m", update_imports=False)
    total = graph.move_summary(open_).first()
    assert (total.estimated_tokens, total.safe_to_execute) == (2 * 50 + 5 * 30, False)
    assert graph.module_move(symbols, refs, "nowhere", "m").count() == 0
    issues = lambda new: {r.issue for r in graph.signature_check(symbols, refs, "test_load", new).collect()}
    assert issues("f(a)") == set()
    for new, want in (("def run(a, b)", "New signature requires 2 params, old required 0 — caller may need update"), ("def run() -> int", "Return type changed — caller may need to adapt"), ("def run()", None)):
        assert {r.issue for r in graph.signature_check(symbols, refs, "run", new).collect()} == {want}


def brute_confidence(value, name, qualified, context):
    parts = value.split(".")
    base = 1.0 if value in (name, qualified) else 0.8 if parts[-1] == name else 0.7 if parts[-1] == qualified else 0.5 if name in parts else 0
    return min(1.0, base + {"function_arg": 0.1, "sequence_element": 0.05, "kwarg": 0.05}.get(context, 0)) if base else 0


def test_string_matches(spark, symbols):
    values = ["a.load", "load.x", "pkg.load", "Load", "x.Load.y", "v1.2", "no such", "b.run", "c.main", "load"]
    contexts = ["function_arg", "kwarg", "sequence_element", "unknown", None]
    rows = [(i, "src/z.py", i, v, contexts[i % 5]) for i, v in enumerate(values)]
    literals = spark.createDataFrame(rows, "id long, file_path string, line_number int, string_value string, context string")
    got = {(r.literal_id, r.symbol_id): r.confidence for r in matching.string_matches(literals, symbols).collect()}
    want = {}
    for i, v in enumerate(values):
        if v in ("v1.2", "no such", "load"):
            continue
        for s in symbols.collect():
            c = brute_confidence(v, s.name, s.qualified_name, contexts[i % 5])
            if c >= 0.5:
                want[i, s.id] = c
    assert got == pytest.approx(want)
    found = matching.string_matches(literals, symbols)
    assert matching.string_refs_of(found, literals, symbols, "load", 0.99).count() == sum(c >= 0.99 and s in (1, 3) for (_, s), c in want.items())
    assert matching.string_refs_of(found, literals, symbols, "load", 0.99, compat=True).count() >= 3
    assert matching.string_search(found, literals, symbols, "Load").first().name == "Load"


def test_cross_language(symbols):
    pairs = matching.cross_language(symbols).collect()
    assert [(r.name, r.id_a, r.id_b, r.language_a, r.language_b) for r in pairs] == [("load", 3, 1, "javascript", "python")]
    assert matching.cross_language_refs(matching.cross_language(symbols)).count() == 1


def test_incremental(spark):
    hashes = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    stored, disk = hashes([("a", "1"), ("b", "2"), ("c", "3")]), hashes([("a", "1"), ("b", "9"), ("d", "4")])
    status = incremental.integrity_status(stored, disk)
    assert {r.path: r.status for r in status.collect()} == {"a": "clean", "b": "dirty", "c": "missing", "d": "unknown"}
    assert {(r.path, r.reason, r.priority) for r in incremental.checks(status).collect()} == {("b", "hash_mismatch", 1), ("d", "no_checksum", 0), ("c", "file_missing", -1)}
    assert {r.path for r in incremental.changed_files(stored, disk).collect()} == {"b", "d"}
    assert {r.path for r in incremental.stale_files(stored, disk).collect()} == {"c"} and {r.path for r in incremental.new_files(disk, stored).collect()} == {"d"}
    assert {(r.path, r.hash) for r in incremental.upsert(stored, disk, ["path"]).collect()} == {("a", "1"), ("b", "9"), ("c", "3"), ("d", "4")}
    queue = spark.createDataFrame([(1, "a", "x", 5, 10), (2, "a", "y", 1, 20), (3, "b", "x", 7, 5), (4, "c", "x", 1, 1)], "id long, path string, reason string, priority int, enqueued_at long")
    assert [(r.path, r.id) for r in incremental.enqueue(queue).collect()] == [("b", 3), ("c", 4), ("a", 2)]
    assert {(r.path, r.action) for r in incremental.drain(queue, disk).collect()} == {("a", "reindex"), ("b", "reindex"), ("c", "remove")}
    counted = incremental.verify_counters(stored.select("path", F.lit(1).alias("verify_count"), F.lit(0).alias("mismatch_count"), F.lit("synced").alias("status")), status)
    assert {(r.path, r.verify_count, r.mismatch_count, r.status) for r in counted.collect()} == {("a", 2, 0, "synced"), ("b", 1, 1, "mismatch"), ("c", 1, 0, "synced")}
    cleared = incremental.clear_dirty(queue.withColumn("status", F.lit("pending")), stored.where("path = 'a'"))
    assert cleared.where("status = 'processed'").count() == 2


def test_deletes(spark, symbols, refs):
    gone = spark.createDataFrame([("src/b.js",)], "path string")
    both = refs.withColumn("callee_file", F.when(F.col("id") == 8, "src/b.js").otherwise(F.col("caller_file")))
    out = incremental.delete_files(gone, symbols, both, symbols.select(F.col("file_path").alias("path")).distinct())
    assert sorted(ids(out["symbols"])) == [1, 2, 5, 6, 7] and sorted(ids(out["refs"])) == [2, 3, 4, 5, 6, 7, 9] and out["files"].count() == 3
    resolved = {r.id: (r.caller_symbol_id, r.callee_symbol_id) for r in incremental.resolved_refs(refs, symbols).collect()}
    assert resolved[1] == (4, 1) and resolved[4] == (None, 1) and resolved[8] == (1, None)
