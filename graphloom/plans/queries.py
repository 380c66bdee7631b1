"""Every registered query of the engine, each beside the SQL that it is checked against."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import budget, language, scoring, text
from graphloom import schema
from graphloom.functions.blake3 import content_hash
from graphloom.operators import approximate, digests, graph, incremental, matching, relational, trigrams
from graphloom.plans.views import _NAME, _of, sql, view
from graphloom.plans.storage import folder
from graphloom.sources import operations, scan, store
from graphloom.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PATTERN, TYPO, ROUNDS = "ring", "smal_rnig", 3


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _target(spark: SparkSession, sf: str) -> str:
    """The name of symbol 0."""
    return view(spark, sf, "symbols").where("id = 0").select("name").first()[0]


TARGET = "(SELECT name FROM symbols WHERE id = 0)"


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks by degree: the rank table before PageRank has run."""
    d = graph.degrees(view(spark, sf, "symbols"), view(spark, sf, "refs"))
    return d.groupBy("name").agg((F.max(F.col("in_degree") + F.col("out_degree")) / 1000.0).alias("page_rank")).where("page_rank > 0.02").withColumnRenamed("name", "symbol_name")


RANKS = """ends AS (SELECT callee_symbol AS name FROM refs UNION ALL SELECT caller_symbol FROM refs WHERE caller_symbol IS NOT NULL),
ranks AS (SELECT name AS symbol_name, count(*) / 1000.0e0 AS page_rank FROM ends WHERE name IN (SELECT name FROM symbols) GROUP BY name HAVING count(*) / 1000.0e0 > 0.02e0)"""


def _with(extra: str, query: str, *names: str) -> str:
    return sql("", *names).rstrip() + ",\n" + extra + "\n" + query


# -- lookups and searches


@register("stats", sql("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM refs) AS refs", "files", "symbols", "refs"))
def stats(spark, sf):
    return relational.stats(view(spark, sf, "files"), view(spark, sf, "symbols"), view(spark, sf, "refs"))


_LIKE = f"(name ILIKE '%{PATTERN}%' OR qualified_name ILIKE '%{PATTERN}%')"


@register("search_like", sql(f"SELECT id, name, kind FROM symbols WHERE {_LIKE} ORDER BY kind, name, id LIMIT 50", "symbols"))
def search_like(spark, sf):
    return relational.search(view(spark, sf, "symbols"), PATTERN).select("id", "name", "kind")


@register("search_wildcard", sql("SELECT id, name, kind FROM symbols WHERE name ILIKE '%b_lt%' OR qualified_name ILIKE '%b_lt%' ORDER BY kind, name, id LIMIT 50", "symbols"))
def search_wildcard(spark, sf):
    return relational.search(view(spark, sf, "symbols"), "b_lt").select("id", "name", "kind")


@register("search_ranked", _with(RANKS, f"SELECT id, name, kind, round(page_rank, 6) AS page_rank FROM symbols LEFT JOIN ranks ON name = symbol_name WHERE {_LIKE} ORDER BY ranks.page_rank DESC NULLS LAST, kind, name, id LIMIT 50", "symbols", "refs"))
def search_ranked(spark, sf):
    return relational.search_ranked(view(spark, sf, "symbols"), _ranks(spark, sf), PATTERN).select("id", "name", "kind", F.round("page_rank", 6).alias("page_rank"))


def _fuzzy_sql(query: str) -> str:
    tokens = f"list_filter(string_split('{query}', '_'), lambda t: t <> '')"
    matched = f"len(list_filter({tokens}, lambda t: list_contains(string_split(lower(name), '_'), t)))"
    similar = f"(1 - levenshtein('{query}', lower(name)) / greatest({len(query)}, strlen(name))::DOUBLE)"
    return f"CASE WHEN lower(name) = '{query}' THEN 1.0e0 WHEN contains(lower(name), '{query}') THEN 0.9e0 + 0.1e0 * {len(query)} / strlen(name) WHEN {matched} > 0 THEN 0.9e0 * {matched} / len({tokens}) ELSE {similar} END"


_SCORED = f"""cand AS (SELECT s.*, page_rank FROM symbols s LEFT JOIN ranks ON name = symbol_name WHERE {_LIKE} ORDER BY page_rank DESC NULLS LAST, kind, name, id LIMIT 50),
scored AS (SELECT *, {_fuzzy_sql(PATTERN)} AS fuzzy FROM cand)"""


@register("search_fuzzy", _with(f"{RANKS},\n{_SCORED}", "SELECT id, name, kind, round(0.5e0 * fuzzy + CASE WHEN kind = 'function' THEN 0.2e0 ELSE 0 END + 0.3e0 * coalesce(page_rank, 0), 6) AS score FROM scored WHERE fuzzy >= 0.3 ORDER BY 0.5e0 * fuzzy + CASE WHEN kind = 'function' THEN 0.2e0 ELSE 0 END + 0.3e0 * coalesce(page_rank, 0) DESC, page_rank DESC NULLS LAST, kind, name, id LIMIT 20", "symbols", "refs"))
def search_fuzzy(spark, sf):
    found = relational.search_fuzzy(view(spark, sf, "symbols"), _ranks(spark, sf), PATTERN, kind="function")
    return found.select("id", "name", "kind", F.round("score", 6).alias("score"))


@register("search_typo", _with(f"{RANKS},\nscored AS (SELECT s.*, page_rank, {_fuzzy_sql(TYPO)} AS fuzzy FROM symbols s LEFT JOIN ranks ON name = symbol_name)", "SELECT id, name, round(0.5e0 * fuzzy + 0.2e0 + 0.3e0 * coalesce(page_rank, 0), 6) AS score FROM scored WHERE fuzzy >= 0.3 ORDER BY 0.5e0 * fuzzy + 0.2e0 + 0.3e0 * coalesce(page_rank, 0) DESC, page_rank DESC NULLS LAST, kind, name, id LIMIT 20", "symbols", "refs"))
def search_typo(spark, sf):
    found = relational.search_fuzzy(view(spark, sf, "symbols"), _ranks(spark, sf), TYPO, compat=False)
    return found.select("id", "name", F.round("score", 6).alias("score"))


@register("fuzzy_scores", sql(f"SELECT id, round({_fuzzy_sql('small_bolt')}, 6) AS score FROM symbols", "symbols"))
def fuzzy_scores(spark, sf):
    return view(spark, sf, "symbols").select("id", F.round(scoring.fuzzy_score(F.lit("small_bolt"), F.col("name")), 6).alias("score"))


@register("file_symbols", sql("SELECT id, name, start_line FROM symbols WHERE file_path = (SELECT file_path FROM symbols WHERE id = 0)", "symbols"))
def file_symbols(spark, sf):
    symbols = view(spark, sf, "symbols")
    return relational.file_symbols(symbols, symbols.where("id = 0").first().file_path).select("id", "name", "start_line")


@register("all_symbols", sql("SELECT id, name, kind FROM symbols", "symbols"))
def all_symbols(spark, sf):
    return view(spark, sf, "symbols").select("id", "name", "kind").orderBy("name", "kind", "id")


@register("resolve_name", sql("SELECT name FROM symbols WHERE qualified_name = (SELECT qualified_name FROM symbols WHERE id = 1) ORDER BY id LIMIT 1", "symbols"))
def resolve_name(spark, sf):
    symbols = view(spark, sf, "symbols")
    return relational.resolve_name(symbols, symbols.where("id = 1").first().qualified_name)


@register("top_ranks", _with(RANKS, "SELECT symbol_name, round(page_rank, 6) AS page_rank FROM ranks ORDER BY ranks.page_rank DESC, symbol_name LIMIT 20", "symbols", "refs"))
def top_ranks(spark, sf):
    return relational.top_ranks(_ranks(spark, sf)).select("symbol_name", F.round("page_rank", 6).alias("page_rank"))


@register("override_coverage", sql("SELECT DISTINCT name FROM symbols WHERE name NOT IN (SELECT caller_symbol FROM overrides UNION SELECT callee_symbol FROM overrides)", "symbols", "overrides"))
def override_coverage(spark, sf):
    return relational.uncovered(view(spark, sf, "symbols").select("name").distinct(), view(spark, sf, "overrides"))


@register("overrides_of_symbol", sql(f"SELECT id, caller_symbol, callee_symbol FROM overrides WHERE caller_symbol = {TARGET} OR callee_symbol = {TARGET}", "overrides", "symbols"))
def overrides_of_symbol(spark, sf):
    return relational.overrides_of(view(spark, sf, "overrides"), _target(spark, sf)).select("id", "caller_symbol", "callee_symbol")


_KEY = "caller_file, caller_symbol, callee_symbol, ref_kind, line"


@register("edge_dedup_null_distinct", sql(f"SELECT min(id) AS id, {_KEY} FROM refs WHERE caller_symbol IS NOT NULL GROUP BY {_KEY} UNION ALL SELECT id, {_KEY} FROM refs WHERE caller_symbol IS NULL", "refs"))
def edge_dedup(spark, sf):
    return relational.deduplicated(view(spark, sf, "refs")).select("id", "caller_file", "caller_symbol", "callee_symbol", "ref_kind", "line")


# -- languages and aggregates

_EXTS = ", ".join(f"('{e}', '{lang}')" for e, lang in language.extensions())
_LANG = f"ext(e, lang) AS (VALUES {_EXTS})"


def _files(spark, sf):
    return view(spark, sf, "files").withColumn("language", language.language_of(F.col("path")))


@register("language_of", _with(_LANG, "SELECT path, lang AS language FROM files LEFT JOIN ext ON e = string_split(path, '.')[-1]", "files"))
def language_of(spark, sf):
    return _files(spark, sf).select("path", "language")


def _variant_sql(variant: str) -> str:
    values = ", ".join(f"('{e}', '{lang}')" for e, lang in language.extensions(variant))
    return _with(f"ext(e, lang) AS (VALUES {values})", f"SELECT path, {'coalesce(lang, %s)' % repr('unknown') if variant == 'cross' else 'lang'} AS language FROM files LEFT JOIN ext ON e = string_split(path, '.')[-1]", "files")


@register("language_of_stored", _variant_sql("stored"))
def language_of_stored(spark, sf):
    return view(spark, sf, "files").select("path", language.language_of(F.col("path"), "stored").alias("language"))


@register("language_of_cross", _variant_sql("cross"))
def language_of_cross(spark, sf):
    return view(spark, sf, "files").select("path", language.language_of(F.col("path"), "cross").alias("language"))


@register("majority_language", _with(_LANG, "SELECT lang AS language, count(*) AS n FROM files JOIN ext ON e = string_split(path, '.')[-1] GROUP BY lang ORDER BY n DESC, lang LIMIT 1", "files"))
def majority_language(spark, sf):
    return relational.majority_language(_files(spark, sf))


@register("index_summary", sql("SELECT language, count(*) AS files, sum(n)::BIGINT AS symbols, sum(coalesce(r, 0))::BIGINT AS refs FROM (SELECT file_path, language, count(*) AS n FROM symbols GROUP BY ALL) LEFT JOIN (SELECT caller_file AS file_path, count(*) AS r FROM refs GROUP BY ALL) USING (file_path) GROUP BY language", "symbols", "refs"))
def index_summary(spark, sf):
    return relational.index_summary(view(spark, sf, "symbols"), view(spark, sf, "refs"))


# -- the reference graph


@register("neighbors", sql(f"SELECT id, caller_symbol, callee_symbol, ref_kind, line FROM refs WHERE caller_symbol = {TARGET} OR callee_symbol = {TARGET} ORDER BY ref_kind, line, id LIMIT 100", "symbols", "refs"))
def neighbors(spark, sf):
    return relational.neighbors(view(spark, sf, "refs"), _target(spark, sf)).select("id", "caller_symbol", "callee_symbol", "ref_kind", "line")


@register("neighbor_split", sql(f"SELECT (SELECT string_agg(DISTINCT caller_symbol, ',' ORDER BY caller_symbol) FROM refs WHERE callee_symbol = {TARGET}) AS callers, (SELECT string_agg(DISTINCT callee_symbol, ',' ORDER BY callee_symbol) FROM refs WHERE caller_symbol = {TARGET}) AS callees", "symbols", "refs"))
def neighbor_split(spark, sf):
    out = relational.neighbor_split(view(spark, sf, "refs"), _target(spark, sf))
    return out.select(*(F.array_join(c, ",").alias(c) for c in ("callers", "callees")))


_CALLERS = f"SELECT * FROM symbols WHERE name IN (SELECT caller_symbol FROM refs WHERE callee_symbol = {TARGET})"


@register("impact", sql(f"SELECT id, name, file_path FROM ({_CALLERS}) ORDER BY id LIMIT 50", "symbols", "refs"))
def impact(spark, sf):
    return relational.callers(view(spark, sf, "symbols"), view(spark, sf, "refs"), _target(spark, sf)).select("id", "name", "file_path")


@register("impact_ranked", _with(RANKS, f"SELECT id, name, round(page_rank, 6) AS page_rank FROM ({_CALLERS}) LEFT JOIN ranks ON name = symbol_name ORDER BY ranks.page_rank DESC NULLS LAST, name, id LIMIT 50", "symbols", "refs"))
def impact_ranked(spark, sf):
    return relational.callers_ranked(view(spark, sf, "symbols"), view(spark, sf, "refs"), _ranks(spark, sf), _target(spark, sf)).select("id", "name", F.round("page_rank", 6).alias("page_rank"))


@register("edge_list", sql("SELECT src, dst, count(*) AS n FROM (SELECT caller_symbol AS src, callee_symbol AS dst FROM refs WHERE caller_symbol <> '') GROUP BY ALL", "refs"))
def edge_list(spark, sf):
    return graph.edge_list(view(spark, sf, "refs")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@register("degrees", sql("SELECT id, name, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM symbols LEFT JOIN (SELECT callee_symbol AS name, count(*) AS i FROM refs GROUP BY ALL) USING (name) LEFT JOIN (SELECT caller_symbol AS name, count(*) AS o FROM refs GROUP BY ALL) USING (name)", "symbols", "refs"))
def degrees(spark, sf):
    return graph.degrees(view(spark, sf, "symbols"), view(spark, sf, "refs"))


def _pagerank_sql() -> str:
    steps = """edges AS (SELECT caller_symbol AS src, callee_symbol AS dst FROM refs WHERE caller_symbol IS NOT NULL),
nodes AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges), total AS (SELECT count(*)::DOUBLE AS n FROM nodes),
outs AS (SELECT src, count(*) AS o FROM edges GROUP BY src), w AS (SELECT src, dst, count(*)::DOUBLE / any_value(o) AS w FROM edges JOIN outs USING (src) GROUP BY src, dst),
r0 AS (SELECT name, 1 / n AS rank FROM nodes, total)"""
    for k in range(ROUNDS):
        steps += f""",
r{k + 1} AS (SELECT nodes.name, 0.15e0 / n + 0.85e0 * ((SELECT coalesce(sum(rank), 0) FROM r{k} WHERE name NOT IN (SELECT src FROM outs)) / n + coalesce(got, 0)) AS rank
FROM nodes CROSS JOIN total LEFT JOIN (SELECT dst AS name, sum(rank * w) AS got FROM w JOIN r{k} ON name = src GROUP BY dst) USING (name))"""
    return steps


@register("pagerank_k", _with(_pagerank_sql(), f"SELECT name, round(rank, 8) AS rank FROM r{ROUNDS}", "refs"))
def pagerank_k(spark, sf):
    ranks = graph.pagerank(graph.edge_list(view(spark, sf, "refs")), max_iter=ROUNDS, tolerance=0.0)
    return ranks.select("name", F.round("rank", 8).alias("rank"))


@register("combined_rank", _with(_pagerank_sql() + """,
deg AS (SELECT name, coalesce(any_value(i), 0) AS i, coalesce(any_value(o), 0) AS o FROM symbols LEFT JOIN (SELECT dst AS name, count(*) AS i FROM (SELECT callee_symbol AS dst FROM refs) GROUP BY ALL) USING (name) LEFT JOIN (SELECT src AS name, o FROM outs) USING (name) GROUP BY name)""", f"SELECT name AS symbol_name, round(0.7e0 * coalesce(rank, 0) / (SELECT greatest(max(rank), 1e-10) FROM r{ROUNDS}) + 0.3e0 * (i + o) / (2.0e0 * (SELECT greatest(max(greatest(i, o)), 1) FROM deg)), 6) AS page_rank, i AS in_degree, o AS out_degree FROM deg LEFT JOIN r{ROUNDS} USING (name)", "symbols", "refs"))
def combined_rank(spark, sf):
    symbols, refs = view(spark, sf, "symbols"), view(spark, sf, "refs")
    ranks = graph.pagerank(graph.edge_list(refs), max_iter=ROUNDS, tolerance=0.0)
    return graph.combined_rank(symbols, refs, ranks).select("symbol_name", F.round("page_rank", 6).alias("page_rank"), "in_degree", "out_degree")


_REACH = f"""e AS (SELECT DISTINCT callee_symbol AS dst, caller_symbol AS src FROM refs WHERE caller_symbol IN (SELECT name FROM symbols WHERE NOT contains(file_path, 'test') AND NOT contains(file_path, '_spec'))),
l0 AS (SELECT {TARGET} AS name), l1 AS (SELECT DISTINCT src AS name FROM e JOIN l0 ON dst = name WHERE src NOT IN (SELECT name FROM l0)),
l2 AS (SELECT DISTINCT src AS name FROM e JOIN l1 ON dst = name WHERE src NOT IN (SELECT name FROM l0 UNION SELECT name FROM l1)),
reach AS (SELECT 1 AS depth, name FROM l1 UNION ALL SELECT 2, name FROM l2)"""
_DEEP = _REACH + """,
l3 AS (SELECT DISTINCT src AS name FROM e JOIN l2 ON dst = name WHERE src NOT IN (SELECT name FROM l0 UNION SELECT name FROM l1 UNION SELECT name FROM l2)),
deep AS (SELECT depth, name FROM reach UNION ALL SELECT 3, name FROM l3)"""


@register("impact_deep", _with(_DEEP, "SELECT depth, name FROM deep", "symbols", "refs"))
def impact_deep(spark, sf):
    return graph.impact_layers(view(spark, sf, "symbols"), view(spark, sf, "refs"), _target(spark, sf), depth=3, cap=None).select("depth", "name")


@register("impact_deep_capped", None)
def impact_deep_capped(spark, sf):
    return graph.impact_layers(view(spark, sf, "symbols"), view(spark, sf, "refs"), _target(spark, sf), depth=3).select("depth", "name")


@register("test_gaps", _with(_REACH, "SELECT depth, name FROM reach WHERE depth = 2 AND name NOT IN (SELECT callee_symbol FROM refs WHERE caller_symbol IN (SELECT name FROM symbols WHERE contains(file_path, 'test') OR contains(file_path, '_spec')))", "symbols", "refs"))
def test_gaps(spark, sf):
    symbols, refs = view(spark, sf, "symbols"), view(spark, sf, "refs")
    names = graph.impact_layers(symbols, refs, _target(spark, sf), depth=2, cap=None)
    return graph.test_gaps(symbols, refs, names.where("depth >= 2"))


@register("dynamic_at_risk", _with(_REACH + f", seen AS (SELECT name FROM reach UNION SELECT {TARGET})", "SELECT caller_symbol || '.' || callee_symbol AS expr, confidence, caller_file AS file FROM refs WHERE is_dynamic AND caller_symbol IN (SELECT name FROM seen) AND callee_symbol NOT IN (SELECT name FROM seen)", "symbols", "refs"))
def dynamic_at_risk(spark, sf):
    symbols, refs, target = view(spark, sf, "symbols"), view(spark, sf, "refs"), _target(spark, sf)
    return graph.dynamic_at_risk(refs, graph.impact_layers(symbols, refs, target, depth=2, cap=None), target)


_USED = f"used AS (SELECT * FROM ({_CALLERS}) ORDER BY id LIMIT 50), near AS (SELECT * FROM refs WHERE caller_symbol = {TARGET} OR callee_symbol = {TARGET} ORDER BY ref_kind, line, id LIMIT 100)"


@register("edit_plan", _with(_USED, f"SELECT 'affected' AS part, name, NULL::VARCHAR AS file_path, NULL::VARCHAR AS change_type, NULL::VARCHAR AS description FROM (SELECT name FROM used UNION SELECT callee_symbol FROM near UNION SELECT {TARGET}) UNION ALL SELECT 'file', NULL, file_path, NULL, NULL FROM (SELECT DISTINCT file_path FROM used) UNION ALL SELECT 'breaking', name, file_path, 'add_param', 'Caller must add parameter ''x'' to call site' FROM used", "symbols", "refs"))
def edit_plan(spark, sf):
    return graph.edit_plan(view(spark, sf, "symbols"), view(spark, sf, "refs"), _target(spark, sf), [{"change_type": "add_param", "details": {"param": "x"}}])


@register("dead_code_static", sql("SELECT id, name FROM entities WHERE name NOT IN (SELECT callee_symbol FROM uses WHERE caller_symbol IN (SELECT name FROM entities))", "entities", "uses"))
def dead_code_static(spark, sf):
    return graph.static_dead_code(view(spark, sf, "entities"), view(spark, sf, "uses")).select("id", "name")


_STRINGS = "SELECT 'string_refs' AS stage, CASE WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status, coalesce(string_agg(name || ' in ' || file_path, ',' ORDER BY name || ' in ' || file_path), '') AS found FROM (SELECT name, file_path FROM (SELECT * FROM symbols WHERE name ILIKE '%' || {0} || '%' OR qualified_name ILIKE '%' || {0} || '%' ORDER BY kind, name, id LIMIT 50) WHERE name <> {0} ORDER BY kind, name, id LIMIT 10)"
_HISTORY = "SELECT 'git_history', CASE WHEN contains(lower(message), 'deprecat') THEN 'warn' ELSE 'info' END, last_commit || ',' || message FROM commits JOIN (SELECT file_path FROM symbols WHERE name ILIKE '%' || {0} || '%' OR qualified_name ILIKE '%' || {0} || '%' ORDER BY kind, name, id LIMIT 1) ON file_path = path"


@register("dead_code_verify", _with(_USED, f"""SELECT 'static_refs' AS stage, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status, coalesce(string_agg(name, ',' ORDER BY name), '') AS found FROM used
UNION ALL SELECT 'dynamic_refs', CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END, coalesce(string_agg(caller_file || ' (confidence: 0.7)', ',' ORDER BY caller_file), '') FROM near WHERE is_dynamic
UNION ALL ({_STRINGS.format(TARGET)}) UNION ALL {_HISTORY.format(TARGET)} UNION ALL SELECT 'test_refs', CASE WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END, coalesce(string_agg(name, ',' ORDER BY name), '') FROM used WHERE contains(file_path, 'test') OR contains(file_path, '_spec')""", "symbols", "refs", "commits"))
def dead_code_verify(spark, sf):
    return _dead_code(spark, sf, _target(spark, sf), ("static_refs", "dynamic_refs", "string_refs", "git_history", "test_refs"))


@register("dead_code_strings", sql(f"({_STRINGS.format(repr(PATTERN))}) UNION ALL {_HISTORY.format(repr(PATTERN))}", "symbols", "commits"))
def dead_code_strings(spark, sf):
    """The same for a word that many names hold: the warning stages."""
    return _dead_code(spark, sf, PATTERN, ("string_refs", "git_history"))


def _dead_code(spark, sf, symbol: str, stages: tuple[str, ...]) -> DataFrame:
    out = graph.dead_code(view(spark, sf, "symbols"), view(spark, sf, "refs"), symbol, stages, view(spark, sf, "commits"))
    return out.select("stage", "status", F.array_join("found", ",").alias("found"))


@register("module_move", _with(f"{_USED}, hit AS (SELECT name, file_path FROM symbols WHERE contains(name, {TARGET}) ORDER BY kind, name, id LIMIT 1)", f"""SELECT 'modify' AS part, file_path AS path, 'delete_symbol' AS action, {TARGET} AS symbol, NULL::VARCHAR AS moved_from, NULL::VARCHAR AS moved_to FROM hit
UNION ALL SELECT 'modify', 'core/util/util.py', 'insert_symbol', 'core.util.' || name, NULL, NULL FROM hit
UNION ALL SELECT 'modify', used.file_path, 'update_import', NULL, {TARGET}, 'core.util.' || hit.name FROM used, hit
UNION ALL SELECT 'unresolved', caller_file, 'dynamic_ref', 'Dynamic reference with confidence 0.7', NULL, NULL FROM near WHERE is_dynamic""", "symbols", "refs"))
def module_move(spark, sf):
    return graph.module_move(view(spark, sf, "symbols"), view(spark, sf, "refs"), _target(spark, sf), "core.util", "python")


@register("target_paths", sql("SELECT id, CASE language WHEN 'python' THEN 'core/util/util.py' WHEN 'javascript' THEN 'core/util/util.js' WHEN 'go' THEN 'core/util/util.go' WHEN 'rust' THEN 'src/core/util/mod.rs' ELSE 'core/util/util.java' END AS path FROM symbols", "symbols"))
def target_paths(spark, sf):
    """Where each symbol would go, by its language's conventions."""
    return view(spark, sf, "symbols").select("id", language.target_path(F.lit("core.util"), F.col("language")).alias("path"))


@register("signature_check", _with(f"{_USED}, hit AS (SELECT coalesce(signature, '') AS old FROM symbols WHERE contains(name, {TARGET}) ORDER BY kind, name, id LIMIT 1), had AS (SELECT CASE WHEN old = '' THEN 0 ELSE 1 END AS n FROM hit)", "SELECT name AS symbol, name || '()' AS call_site, 'New signature requires 3 params, old required ' || n || ' — caller may need update' AS issue FROM used, had", "symbols", "refs"))
def signature_check(spark, sf):
    return graph.signature_check(view(spark, sf, "symbols"), view(spark, sf, "refs"), _target(spark, sf), "def f(a, b, c)")


# -- matching


_BASE = "CASE WHEN string_value = name OR string_value = qualified_name THEN 1.0e0 WHEN string_split(string_value, '.')[-1] = name THEN 0.8e0 WHEN string_split(string_value, '.')[-1] = qualified_name THEN 0.7e0 WHEN list_contains(string_split(string_value, '.'), name) THEN 0.5e0 ELSE 0 END"
_MATCHES = f"""matches AS (SELECT literal_id, symbol_id, least(1.0e0, base + CASE context WHEN 'function_arg' THEN 0.1e0 WHEN 'kwarg' THEN 0.05e0 WHEN 'sequence_element' THEN 0.05e0 ELSE 0 END) AS confidence
FROM (SELECT l.id AS literal_id, s.id AS symbol_id, context, {_BASE} AS base FROM literals l JOIN symbols s ON list_contains(string_split(string_value, '.'), s.name) OR string_value = qualified_name
WHERE NOT regexp_matches(string_value, '[ /:-]') AND contains(string_value, '.')) WHERE base > 0)"""


def _matches(spark, sf):
    return matching.string_matches(view(spark, sf, "literals"), view(spark, sf, "symbols"))


@register("string_ref_match", _with(_MATCHES, "SELECT literal_id, symbol_id, round(confidence, 4) AS confidence, CASE WHEN confidence >= 0.8 THEN 'exact' ELSE 'partial' END AS match_type FROM matches", "literals", "symbols"))
def string_ref_match(spark, sf):
    return _matches(spark, sf).withColumn("confidence", F.round("confidence", 4))


@register("string_ref_lookup", _with(_MATCHES, f"SELECT literal_id, symbol_id, round(confidence, 4) AS confidence FROM matches JOIN symbols s ON s.id = symbol_id WHERE s.name = {TARGET} AND confidence >= 0.6", "literals", "symbols"))
def string_ref_lookup(spark, sf):
    target, literals, symbols = _target(spark, sf), view(spark, sf, "literals"), view(spark, sf, "symbols")
    asked = symbols.where((F.col("name") == target) | (F.col("qualified_name") == target))  # matches of other symbols would be dropped
    out = matching.string_refs_of(matching.string_matches(literals, asked), literals, symbols, target, 0.6)
    return out.select("literal_id", "symbol_id", F.round("confidence", 4).alias("confidence"))


@register("string_ref_search", _with(_MATCHES, f"SELECT literal_id, symbol_id, round(confidence, 4) AS confidence FROM matches JOIN symbols s ON s.id = symbol_id JOIN literals l ON l.id = literal_id WHERE contains(lower(name), '{PATTERN}') OR contains(lower(qualified_name), '{PATTERN}') OR contains(lower(string_value), '{PATTERN}') ORDER BY matches.confidence DESC, literal_id, symbol_id LIMIT 50", "literals", "symbols"))
def string_ref_search(spark, sf):
    out = matching.string_search_top(view(spark, sf, "literals"), view(spark, sf, "symbols"), PATTERN)
    return out.select("literal_id", "symbol_id", F.round("confidence", 4).alias("confidence"))


_COMPAT = "(a.kind IN ('class', 'interface', 'struct', 'type') AND b.kind IN ('class', 'interface', 'struct', 'type')) OR (a.kind IN ('function', 'method', 'fn') AND b.kind IN ('function', 'method', 'fn'))"


@register("cross_language", sql(f"SELECT a.name, a.id AS id_a, b.id AS id_b, a.language AS language_a, b.language AS language_b, CASE WHEN {_COMPAT} THEN 0.7e0 ELSE 0.4e0 END AS confidence, 'exact_name' || CASE WHEN {_COMPAT} THEN ',kind_compatible(' || a.kind || '↔' || b.kind || ')' ELSE '' END AS reasons FROM symbols a JOIN symbols b ON a.name = b.name AND a.language < b.language", "symbols"))
def cross_language(spark, sf):
    out = matching.cross_language(view(spark, sf, "symbols"))
    return out.select("name", "id_a", "id_b", "language_a", "language_b", F.round("confidence", 4).alias("confidence"), F.array_join("reasons", ",").alias("reasons"))


# -- scalar functions


@register("split_identifier", sql("SELECT id, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(kind || '_' || name || 'XmlParser', '([A-Z])', '_\\1', 'g'), '-', '_', 'g')), '_'), lambda t: t <> ''), ' ') AS tokens FROM symbols", "symbols"))
def split_identifier(spark, sf):
    name = F.concat("kind", F.lit("_"), "name", F.lit("XmlParser"))
    return view(spark, sf, "symbols").select("id", F.array_join(scoring.split_identifier(name), " ").alias("tokens"))


@register("param_counts", sql("SELECT id, CASE WHEN signature IS NULL THEN 0 ELSE len(string_split(regexp_extract(signature, '\\((.*)\\)', 1), ',')) END::INTEGER AS n, CASE WHEN signature IS NULL THEN 0 ELSE len(list_filter(string_split(regexp_extract(signature, '\\((.*)\\)', 1), ','), lambda p: NOT contains(p, '=') AND NOT contains(p, ': Optional'))) END::INTEGER AS required FROM symbols", "symbols"))
def param_counts(spark, sf):
    return view(spark, sf, "symbols").select("id", scoring.count_params(F.col("signature")).alias("n"), scoring.count_required_params(F.col("signature")).alias("required"))


@register("return_type", sql("SELECT id, trim(regexp_extract(signature, '->(.*)', 1)) AS return_type, trim(regexp_extract(signature, '->(.*)', 1)) <> 'T1' AS changed FROM symbols WHERE signature IS NOT NULL", "symbols"))
def return_type(spark, sf):
    s = view(spark, sf, "symbols").where("signature is not null")
    return s.select("id", scoring.return_type(F.col("signature")).alias("return_type"), scoring.return_type_changed(F.col("signature"), F.lit("def f() -> T1")).alias("changed"))


@register("symbol_like", sql("SELECT id, NOT regexp_matches(string_value, '[ /:-]') AND NOT regexp_matches(string_value, '^[0-9vV].*\\.') AND regexp_matches(string_value, '^([A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Z][A-Za-z0-9_]*)$') AS symbol_like FROM literals", "literals"))
def symbol_like(spark, sf):
    return view(spark, sf, "literals").select("id", scoring.is_symbol_like(F.col("string_value")).alias("symbol_like"))


@register("ref_confidence", sql("SELECT id, CASE WHEN ref_kind IN ('call', 'import') THEN 1.0e0 ELSE 0.7e0 END AS confidence, ref_kind = 'dynamic_dispatch' AS dynamic FROM refs", "refs"))
def ref_confidence(spark, sf):
    return view(spark, sf, "refs").select("id", scoring.reference_confidence(F.col("ref_kind")).alias("confidence"), scoring.is_dynamic_kind(F.col("ref_kind")).alias("dynamic"))


@register("qualified_names", sql("SELECT id, regexp_replace(regexp_replace(file_path, '^src/', ''), '\\.[^.]*$', '').replace('/', '.') || '.' || kind || '.' || name AS qualified FROM symbols", "symbols"))
def qualified_names(spark, sf):
    return view(spark, sf, "symbols").select("id", scoring.qualified_name(F.col("file_path"), F.col("kind"), F.col("name")).alias("qualified"))


@register("density_tokens", _with(_LANG, "SELECT path, ceil(length(text) / CASE lang WHEN 'python' THEN 3.8e0 WHEN 'javascript' THEN 3.4e0 WHEN 'c' THEN 3.1e0 ELSE 3.5e0 END)::INTEGER AS tokens FROM files LEFT JOIN ext ON e = string_split(path, '.')[-1]", "files"))
def density_tokens(spark, sf):
    return _files(spark, sf).select("path", scoring.density_tokens(F.col("text"), F.col("language")).alias("tokens"))


@register("error_class", sql("SELECT id, CASE WHEN contains(result_json, 'error') THEN 'DatabaseError' WHEN contains(result_json, 'click') THEN 'SymbolNotFound' WHEN contains(result_json, 'view') THEN 'IoError' ELSE 'DatabaseError' END AS code FROM cache", "cache"))
def error_class(spark, sf):
    said = F.when(F.col("result_json") == "click", "no such symbol").when(F.col("result_json") == "view", "permission denied").when(F.col("result_json") == "error", "SQL failed").otherwise("other")
    return view(spark, sf, "cache").select("id", scoring.classify_error(said).alias("code"))


# -- text reduction

_LINES = "list_transform(CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _simple(x: str) -> str:
    trim = lambda y: f"regexp_replace({y}, '^\\s+|\\s+$', '', 'g')"
    bare = trim(f"regexp_replace({trim(x)}, '^\\{{+|\\}}+$', '', 'g')")
    ends = trim(f"regexp_replace(regexp_replace({bare}, ';+$', ''), ',+$', '')")
    return f"regexp_replace({ends}, '\\s+', ' ', 'g')"


def _any(function: str, *words: str) -> str:
    """SQL: the line x begins with, or holds, one of the words. The words are written out here, apart from the engine's patterns."""
    return "(" + " OR ".join(f"{function}(x, {_quoted(w)})" for w in words) + ")"


def _listed(column: str) -> str:
    return f"array_to_string({column}, chr(10))"


# How a line of each sort begins, or what it holds.
_NO_SIGNATURE = ("//", "#", "/*", "*", "'''", '"""', "@")
_CONDITION = _any("starts_with", "if ", "if(", "elif ", "elif(", "else if ", "else if(", "else ", "match ", "switch ", "case ") + " OR x IN ('else', 'else:')"
_LOOPS = _any("starts_with", "for ", "for(", "while ", "while(", "loop ", "foreach ", "do ")
_ERRORS = _any("starts_with", "try ", "try{", "catch ", "catch(", "except ", "except(", "finally", "raise ", "panic!", "throw ", "err.") + " OR " + _any("contains", ".unwrap()", ".expect(", ".unwrap_or(", ".unwrap_or_else(")
_EFFECTS = _any(
    "contains", ".insert(", ".update(", ".delete(", ".save(", ".execute(", ".query(", ".commit(", ".rollback(", "db.", "DB.", ".add(",
    "http", "fetch(", "axios", "requests.", "reqwest", "HttpClient",
    "File::", "fs::", "open(", "read_to_string", "write_all", ".read(", ".write(",
    "log.", "println!", "print(", "eprint", "console.log", "console.error", "console.warn", "tracing::", "info!", "debug!", "warn!", "error!", "trace!",
    ".push(", ".extend(", ".remove(", ".clear()", ".sort(", "mut ",
    "std::process", "subprocess", "Command::", "spawn", "fork",
    ".lock()", ".unwrap().lock", "Atomic", "Mutex", "RwLock",
)


@register("signature_line", sql(f"SELECT path, coalesce(list_filter(ls, lambda x: x <> '' AND NOT {_any('starts_with', *_NO_SIGNATURE)})[1], ls[1], '') AS signature FROM (SELECT path, {_LINES} AS ls FROM files)", "files"))
def signature_line(spark, sf):
    return view(spark, sf, "files").select("path", text.extract_signature(F.col("text")).alias("signature"))


_BRANCH = f"list_filter(ls, lambda x: x <> '' AND NOT contains(x, '*/') AND NOT regexp_matches(x, '^(?://|#)') AND ({_CONDITION} OR {_LOOPS} OR {_ERRORS} OR (contains(x, ' =>') AND NOT regexp_matches(x, '^(?:fn |let )')) OR (starts_with(x, 'case ') AND ends_with(x, ':'))))"


@register("critical_branches", sql(f"SELECT path, {_listed(f'list_transform({_BRANCH}, lambda x: {_simple("x")})')} AS branches FROM (SELECT path, {_LINES.replace('text', 'bare')} AS ls FROM (SELECT path, regexp_replace(regexp_replace(text, {_quoted(text.BOTH)}, '*/', 'g'), {_quoted(text.BLOCK)}, '', 'g') AS bare FROM files))", "files"))
def critical_branches(spark, sf):
    return view(spark, sf, "files").select("path", F.array_join(text.extract_critical_branches(F.col("text")), "\n").alias("branches"))


_CODE = f"list_filter(ls, lambda x: x <> '' AND NOT regexp_matches(x, '^(?://|#)') AND %s)"


@register("side_effects", sql(f"SELECT path, {_listed(f'list_transform({_CODE % _EFFECTS}, lambda x: {_simple("x")})')} AS effects FROM (SELECT path, {_LINES} AS ls FROM files)", "files"))
def side_effects(spark, sf):
    return view(spark, sf, "files").select("path", F.array_join(text.extract_side_effects(F.col("text")), "\n").alias("effects"))


_ASSIGNED = f"({_any('starts_with', 'let ', 'const ', 'var ')} OR contains(x, ':=') OR (contains(x, '=') AND NOT {_any('starts_with', 'if ', 'for ', 'while ', 'def ', 'class ', 'fn ', 'pub ', '//', '#', 'return ', '}')}))"


@register("key_assignments", sql(f"SELECT path, {_listed(f'list_transform({_CODE % _ASSIGNED}, lambda x: {_simple("x")})')} AS assignments FROM (SELECT path, {_LINES} AS ls FROM files)", "files"))
def key_assignments(spark, sf):
    return view(spark, sf, "files").select("path", F.array_join(text.extract_key_assignments(F.col("text")), "\n").alias("assignments"))


_RETURNED = _any("starts_with", "return ", "return{", "yield ") + " OR x = 'return'"


@register("return_statement", sql(f"SELECT path, {_simple(f'list_filter(ls, lambda x: {_RETURNED})[-1]')} AS returned FROM (SELECT path, {_LINES} AS ls FROM files)", "files"))
def return_statement(spark, sf):
    return view(spark, sf, "files").select("path", text.extract_return_statement(F.col("text")).alias("returned"))


@register("token_estimate")
def token_estimate(spark, sf):
    return view(spark, sf, "files").select("path", text.token_count(F.col("text")).alias("tokens"))


@register("compress_budget")
def compress_budget(spark, sf):
    df = view(spark, sf, "files").select("path", "text")
    return text.compress(df, F.col("text"), F.lit(1), F.size(F.split("text", "\n")), "budget(300)").select("path", "compressed.signature", "compressed.estimated_tokens", "compressed.compression_used")


@register("content_hash")
def content_hashes(spark, sf):
    return view(spark, sf, "files").select("path", content_hash(F.col("text")).alias("hash"))


# -- incremental maintenance


def _hashed(spark, sf, name):
    return view(spark, sf, name).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))


_HASHED = "s AS (SELECT *, sha256(content) AS hash FROM stored), d AS (SELECT *, sha256(content) AS hash FROM disk)"


@register("integrity_status", _with(_HASHED, "SELECT path, CASE WHEN s.doc_id IS NULL THEN 'unknown' WHEN d.doc_id IS NULL THEN 'missing' WHEN s.hash IS NOT DISTINCT FROM d.hash THEN 'clean' ELSE 'dirty' END AS status FROM s FULL JOIN d USING (path)", "stored", "disk"))
def integrity_status(spark, sf):
    return incremental.integrity_status(_hashed(spark, sf, "stored"), _hashed(spark, sf, "disk"))


@register("stale_files", sql("SELECT path FROM stored WHERE path NOT IN (SELECT path FROM disk)", "stored", "disk"))
def stale_files(spark, sf):
    return incremental.stale_files(view(spark, sf, "stored"), view(spark, sf, "disk")).select("path")


@register("new_files", sql("SELECT path FROM disk WHERE path NOT IN (SELECT path FROM stored)", "stored", "disk"))
def new_files(spark, sf):
    return incremental.new_files(view(spark, sf, "disk"), view(spark, sf, "stored")).select("path")


@register("changed_files", _with(_HASHED, "SELECT path FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = d.path AND s.hash = d.hash)", "stored", "disk"))
def changed_files(spark, sf):
    return incremental.changed_files(_hashed(spark, sf, "stored"), _hashed(spark, sf, "disk")).select("path")


@register("hash_upsert", sql("SELECT path, doc_id, content IS NULL AS empty FROM disk UNION ALL SELECT path, doc_id, content IS NULL FROM stored WHERE path NOT IN (SELECT path FROM disk)", "stored", "disk"))
def hash_upsert(spark, sf):
    cols = ("path", "doc_id", F.col("content").isNull().alias("empty"))
    return incremental.upsert(view(spark, sf, "stored").select(*cols), view(spark, sf, "disk").select(*cols), ["path"])


@register("cascade_delete", sql("SELECT id FROM symbols WHERE file_path NOT LIKE '%tests/%'", "symbols"))
def cascade_delete(spark, sf):
    symbols, refs = view(spark, sf, "symbols"), view(spark, sf, "refs").withColumn("callee_file", F.col("caller_file"))
    gone = symbols.where(F.contains("file_path", F.lit("tests/"))).select(F.col("file_path").alias("path")).distinct()
    return incremental.delete_files(gone, symbols, refs, gone)["symbols"].select("id")


@register("resolved_refs", sql("SELECT r.id, c.id AS caller_symbol_id, t.id AS callee_symbol_id FROM refs r LEFT JOIN (SELECT name, file_path, min(id) AS id FROM symbols GROUP BY ALL) c ON c.name = caller_symbol AND c.file_path = caller_file LEFT JOIN (SELECT name, min(id) AS id FROM symbols GROUP BY ALL) t ON t.name = callee_symbol", "symbols", "refs"))
def resolved_refs(spark, sf):
    return incremental.resolved_refs(view(spark, sf, "refs"), view(spark, sf, "symbols")).select("id", "caller_symbol_id", "callee_symbol_id")


@register("integrity_checks", _with(_HASHED, "SELECT path, reason, priority FROM (SELECT path, CASE WHEN s.doc_id IS NULL THEN 'no_checksum' WHEN d.doc_id IS NULL THEN 'file_missing' WHEN s.hash IS NOT DISTINCT FROM d.hash THEN NULL ELSE 'hash_mismatch' END AS reason, CASE WHEN s.doc_id IS NULL THEN 0 WHEN d.doc_id IS NULL THEN -1 ELSE 1 END AS priority FROM s FULL JOIN d USING (path)) WHERE reason IS NOT NULL", "stored", "disk"))
def integrity_checks(spark, sf):
    return incremental.checks(integrity_status(spark, sf))


@register("verify_counters", _with(_HASHED, "SELECT path, s.verify_count + CASE WHEN s.hash = d.hash THEN 1 ELSE 0 END AS verify_count, CASE WHEN s.hash <> d.hash THEN 1 ELSE 0 END AS mismatch_count, CASE WHEN s.hash <> d.hash THEN 'mismatch' ELSE 'synced' END AS status FROM s LEFT JOIN d USING (path)", "stored", "disk"))
def verify_counters(spark, sf):
    checksums = view(spark, sf, "stored").select("path", "verify_count", F.lit(0).alias("mismatch_count"), F.lit("synced").alias("status"))
    return incremental.verify_counters(checksums, integrity_status(spark, sf))


@register("dirty_queue", sql("SELECT path, id, reason, priority FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY enqueued_at DESC, id DESC) AS n FROM dirty) WHERE n = 1", "dirty"))
def dirty_queue(spark, sf):
    return incremental.enqueue(view(spark, sf, "dirty")).select("path", "id", "reason", "priority")


@register("cache_stats", sql("SELECT count(*) AS total, count(*) FILTER (ttl > 40) AS active, count(*) FILTER (ttl <= 40) AS expired FROM cache", "cache"))
def cache_stats(spark, sf):
    return incremental.cache_stats(view(spark, sf, "cache").withColumn("expires_at", F.col("ttl")), F.lit(40))


@register("cache_key", sql("SELECT id, 'search:{kind=\"' || kind || '\",limit=20,query=[\"' || name || '\",{a=null,z=true}]}' AS query_key FROM symbols", "symbols"))
def cache_key(spark, sf):
    """The key of one search a symbol; parameters are given out of order."""

    @F.pandas_udf("string")
    def key(name: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([incremental.cache_key("search", {"query": [n, {"z": True, "a": None}], "limit": 20, "kind": k}) for n, k in zip(name, kind, strict=True)])

    return view(spark, sf, "symbols").select("id", key("name", "kind").alias("query_key"))


@register("budget_strategies", sql("SELECT id, '{\"results\":[{\"name\":\"' || name || '\",\"kind\":\"' || kind || '\"}]}' AS reduced, 'RemoveDetails' AS strategy FROM symbols", "symbols"))
def budget_strategies(spark, sf):
    """An answer a symbol, reduced to what its names alone take: docstring, signature and details go, in this order."""

    @F.pandas_udf("reduced string, strategy string")
    def reduced(name: pd.Series, kind: pd.Series) -> pd.DataFrame:
        def one(n: str, k: str) -> tuple:
            bare = {"results": [{"name": n, "kind": k}]}
            full = {"results": [bare["results"][0] | {"docstring": n * 9, "signature": f"def {n}(a, b)", "path": "src/" + n, "notes": [n, n]}]}
            value, _, strategy = budget.enforce_budget(full, budget.tokens_of(bare))
            return json.dumps(value, separators=(",", ":")), strategy

        return pd.DataFrame([one(n, k) for n, k in zip(name, kind, strict=True)], columns=["reduced", "strategy"])

    return view(spark, sf, "symbols").select("id", reduced("name", "kind").alias("r")).select("id", "r.*")


@register("cache_purge", sql("SELECT id, query_key FROM cache WHERE ttl > 40", "cache"))
def cache_purge(spark, sf):
    return incremental.purge(view(spark, sf, "cache").withColumn("expires_at", F.col("ttl")), F.lit(40)).select("id", "query_key")


# -- streams, run over the whole table as one batch

_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_TYPED = "typed AS (SELECT path, ts, CASE WHEN event_type LIKE 'modify%' THEN 'Modified' WHEN event_type = 'create' THEN 'Created' ELSE 'Removed' END AS event_type FROM file_events WHERE event_type <> 'access' AND path LIKE '%.py')"
_BURSTS = _TYPED + """,
marked AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY path ORDER BY ts)) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM typed),
bursts AS (SELECT path, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS released, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM marked) GROUP BY path, burst)"""


@register("event_classes", sql("SELECT id, path, CASE WHEN event_type LIKE 'modify%' THEN 'Modified' WHEN event_type = 'create' THEN 'Created' ELSE 'Removed' END AS event_type FROM file_events WHERE event_type <> 'access' AND path LIKE '%.py'", "file_events"))
def event_classes(spark, sf):
    return stream.relevant(view(spark, sf, "file_events")).select("id", "path", "event_type")


def _bursts(spark, sf):
    return stream.debounced(stream.relevant(view(spark, sf, "file_events")), "6 hours")


@register("debounce_batches", _with(_BURSTS, "SELECT path, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(released, '%Y-%m-%d %H:%M:%S.%f') AS released, n FROM bursts", "file_events"))
def debounce_batches(spark, sf):
    return _bursts(spark, sf).select("path", *(F.date_format(c, _MICROS).alias(c) for c in ("started", "released")), "n")


@register("event_batches", _with(_BURSTS, "SELECT tick, batch, path FROM (SELECT tick, path, ((row_number() OVER (PARTITION BY tick ORDER BY path) - 1) // 20)::INTEGER AS batch FROM (SELECT DISTINCT strftime(date_trunc('day', released), '%Y-%m-%d %H:%M:%S.%f') AS tick, path FROM bursts))", "file_events"))
def event_batches(spark, sf):
    return stream.batches(_bursts(spark, sf), 86_400, 20).select(F.date_format("tick", _MICROS).alias("tick"), "batch", "path")


@register("event_actions", _with(_TYPED, "SELECT path, CASE WHEN last = 'Removed' THEN 'delete' WHEN path IN (SELECT 'src/u' || (doc_id % 100) || '.py' FROM disk) THEN 'index' ELSE 'skip' END AS action FROM (SELECT path, arg_max(event_type, (ts, event_type)) AS last FROM typed GROUP BY path)", "file_events", "disk"))
def event_actions(spark, sf):
    disk = view(spark, sf, "disk").select(F.concat(F.lit("src/u"), F.col("doc_id") % 100, F.lit(".py")).alias("path")).distinct()
    return stream.actions(stream.relevant(view(spark, sf, "file_events")), disk)


@register("grep_context", sql("SELECT path, line, ls[line] AS text, array_to_string(ls[greatest(1, line - 2) : line + 2], chr(10)) AS context, greatest(1, strlen(array_to_string(ls[greatest(1, line - 2) : line + 2], chr(10))) // 4)::BIGINT AS tokens FROM (SELECT path, ls, list_position(list_transform(ls, lambda x: contains(x, 'License')), true)::INTEGER AS line FROM (SELECT path, string_split(text, chr(10)) AS ls FROM files WHERE contains(text, 'License'))) ORDER BY path LIMIT 3", "files"))
def grep_context(spark, sf):
    return scan.grep(view(spark, sf, "files"), "License")


# -- further lookups, plans and maintenance


@register("file_hash_lookup", _with(_HASHED, "SELECT path, hash FROM s WHERE path = 'f5'", "stored", "disk"))
def file_hash_lookup(spark, sf):
    return incremental.file_hash(_hashed(spark, sf, "stored"), "f5")


@register("file_hashes", _with(_HASHED, "SELECT path, hash FROM s", "stored", "disk"))
def file_hashes(spark, sf):
    return incremental.file_hashes(_hashed(spark, sf, "stored"))


@register("checksum_join", _with(_HASHED, "SELECT path, s.hash = d.hash AS same FROM s JOIN d USING (path)", "stored", "disk"))
def checksum_join(spark, sf):
    joined = incremental.checksums_with_files(_hashed(spark, sf, "stored"), _hashed(spark, sf, "disk"))
    return joined.select("path", (F.col("hash") == F.col("file_hash")).alias("same"))


@register("dirty_join", sql("SELECT id, path, priority FROM dirty WHERE id % 3 <> 0 AND path IN (SELECT DISTINCT path FROM file_events)", "dirty", "file_events"))
def dirty_join(spark, sf):
    queue = view(spark, sf, "dirty").withColumn("status", F.when(F.col("id") % 3 == 0, "processed").otherwise("pending"))
    return incremental.dirty_with_files(queue, view(spark, sf, "file_events")).select("id", "path", "priority")


@register("schema_version", "SELECT max(r_regionkey) AS schema_version FROM region")
def schema_version(spark, sf):
    versions = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("schema_version"))
    return incremental.schema_version(versions)


@register("symbol_like_literals", sql("SELECT id FROM literals WHERE NOT regexp_matches(string_value, '[ /:-]') AND NOT regexp_matches(string_value, '^[0-9vV].*\\.') AND regexp_matches(string_value, '^([A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Z][A-Za-z0-9_]*)$')", "literals"))
def symbol_like_literals(spark, sf):
    literals = view(spark, sf, "literals").withColumn("is_symbol_like", scoring.is_symbol_like(F.col("string_value")))
    return incremental.symbol_like_literals(literals).select("id")


@register("cross_language_refs", sql(f"SELECT a.name, a.id AS id_a, b.id AS id_b FROM symbols a JOIN symbols b ON a.name = b.name AND a.language < b.language ORDER BY CASE WHEN {_COMPAT} THEN 0.7e0 ELSE 0.4e0 END DESC, a.name, a.id, b.id LIMIT 20", "symbols"))
def cross_language_refs(spark, sf):
    return matching.cross_language_top(view(spark, sf, "symbols"), 20).select("name", "id_a", "id_b")


@register("edit_plan_summary", _with(_USED, f"SELECT (SELECT count(*) FROM (SELECT name FROM used UNION SELECT callee_symbol FROM near UNION SELECT {TARGET})) AS affected, (SELECT count(DISTINCT file_path) FROM used) AS files, (SELECT count(*) FROM used) AS breaking, (SELECT count(*) FROM used) = 0 AS safe_to_proceed, 50 * (SELECT count(*) FROM (SELECT name FROM used UNION SELECT callee_symbol FROM near UNION SELECT {TARGET})) AS estimated_tokens", "symbols", "refs"))
def edit_plan_summary(spark, sf):
    return graph.edit_plan_summary(edit_plan(spark, sf))


@register("safe_to_delete", _with(_USED, "SELECT count(*) = 0 AS safe_to_delete, CASE WHEN count(*) > 0 THEN 'Do not delete. Mark as deprecated and monitor for 1 release cycle.' ELSE 'Safe to delete. No references found.' END AS suggestion FROM used", "symbols", "refs"))
def safe_to_delete(spark, sf):
    return graph.safe_to_delete(graph.dead_code(view(spark, sf, "symbols"), view(spark, sf, "refs"), _target(spark, sf)))


@register("move_summary", _with(f"{_USED}, t AS (SELECT (SELECT count(*) FROM used) + 2 AS files, (SELECT count(*) FROM near WHERE is_dynamic) AS open_)", "SELECT 50 * files + 30 * open_ AS estimated_tokens, open_ = 0 AS safe_to_execute, CASE WHEN open_ = 0 THEN 'All references can be automatically updated.' ELSE open_ || ' unresolved references require manual review' END AS reason FROM t", "symbols", "refs"))
def move_summary(spark, sf):
    return graph.move_summary(module_move(spark, sf))


@register("queue_drain", sql("SELECT DISTINCT path, CASE WHEN path IN (SELECT path FROM file_events) THEN 'reindex' ELSE 'remove' END AS action FROM dirty", "dirty", "file_events"))
def queue_drain(spark, sf):
    return incremental.drain(view(spark, sf, "dirty"), view(spark, sf, "file_events").select("path").distinct())


@register("clear_dirty", sql("SELECT id, CASE WHEN path IN (SELECT path FROM dirty WHERE reason = 'error' AND id % 50 = 0) THEN 'processed' ELSE 'pending' END AS status FROM dirty", "dirty"))
def clear_dirty(spark, sf):
    queue = view(spark, sf, "dirty").withColumn("status", F.lit("pending"))
    return incremental.clear_dirty(queue, queue.where("reason = 'error' and id % 50 = 0")).select("id", "status")


@register("recover", _with(_HASHED, "SELECT s.path, CASE WHEN d.hash IS NULL THEN 'skip_missing' WHEN d.hash = s.hash THEN 'skip_same' ELSE 'reindex' END AS action FROM s LEFT JOIN d USING (path)", "stored", "disk"))
def recover(spark, sf):
    journal = _hashed(spark, sf, "stored").select(F.col("path").alias("file_path"), F.col("doc_id").alias("seq"), F.col("hash").alias("file_hash"), F.lit("Pending").alias("status"))
    return incremental.recover(journal, _hashed(spark, sf, "disk"))


_BATCH = """asked AS (SELECT p_partkey AS qid, replace(p_name, ' ', '_') AS query FROM part),
q AS (SELECT DISTINCT query, list_filter(string_split(lower(query), '_'), lambda x: x <> '') AS w FROM asked), s AS (SELECT DISTINCT name, list_filter(string_split(lower(name), '_'), lambda x: x <> '') AS h FROM symbols),
pairs AS (SELECT query, name, CASE WHEN lower(query) = lower(name) THEN 1.0e0 WHEN contains(lower(name), lower(query)) THEN 0.9e0 + 0.1e0 * strlen(query) / strlen(name)
  WHEN len(w) > 0 AND list_has_any(w, h) THEN 0.9e0 * len(list_filter(w, lambda x: list_contains(h, x))) / len(w) ELSE (1 - levenshtein(lower(query), lower(name))::DOUBLE / greatest(strlen(query), strlen(name))) * CASE WHEN strlen(query) <= 2 THEN 0.5e0 ELSE 1 END END AS fuzzy
  FROM q JOIN s ON list_has_any(w, h) OR (abs(length(query) - length(name)) <= 2 AND levenshtein(lower(query), lower(name)) <= 2)),
scored AS (SELECT query, name, 0.5e0 * fuzzy + 0.2e0 + 0.3e0 * coalesce(page_rank, 0) AS score FROM pairs LEFT JOIN ranks ON symbol_name = name)"""


@register(
    "search_batch",
    _with(f"{RANKS},\n{_BATCH}", "SELECT qid, place, id FROM (SELECT qid, symbols.id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, name, symbols.id) AS INTEGER) AS place FROM asked JOIN scored USING (query) JOIN symbols USING (name)) WHERE place <= 10", "symbols", "refs"),
)
def search_batch(spark, sf):
    """A query a part: the ten best symbols for each of all part names."""
    queries = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("qid"), F.translate("p_name", " ", "_").alias("query"))
    return relational.search_batch(view(spark, sf, "symbols"), _ranks(spark, sf), queries).select("qid", "place", "id")


@register("extract_files")
def extract_files(spark, sf):
    """What the extractors of all languages give for the bound files."""
    from graphloom.sources.extract import registry

    found = registry.parsed(_files(spark, sf))
    return found.select("path", "language", *(F.size(c).alias(f"n_{c}") for c in ("symbols", "refs", "imports", "literals")))


_DOT_HEAD = "'digraph code {' || chr(10) || '  rankdir=LR;' || chr(10) || '  node [shape=box, style=filled, fillcolor=lightblue];' || chr(10) || chr(10)"
_DOT_NODE = """CASE WHEN {0} <> t THEN '  "' || replace({0}, ' ', '_') || '" [label="' || {0} || '"];' || chr(10) ELSE '' END"""
_EGO = f"""ends AS (SELECT n.*, coalesce(caller_symbol, '?') AS caller, {TARGET} AS t FROM near n),
rows AS (SELECT ref_kind, line, id, {_DOT_NODE.format("caller")} || {_DOT_NODE.format("callee_symbol")} AS n,
  '  "' || replace(caller, ' ', '_') || '" -> "' || replace(callee_symbol, ' ', '_') || '" [label="' || ref_kind || '", ' || CASE ref_kind WHEN 'call' THEN 'color=green' WHEN 'import' THEN 'color=blue' WHEN 'inherit' THEN 'color=red, style=dashed' ELSE 'color=gray' END || '];' || chr(10) AS e FROM ends)"""


@register(
    "ego_dot",
    _with(f"{_USED},\n{_EGO}", f"""SELECT {_DOT_HEAD} || '  "' || replace({TARGET}, ' ', '_') || '" [fillcolor=gold, label="' || {TARGET} || '\\n(target)"];' || chr(10) || string_agg(n, '' ORDER BY ref_kind, line, id)
  || chr(10) || '  // Edges' || chr(10) || string_agg(e, '' ORDER BY ref_kind, line, id) || '}}' || chr(10) AS dot FROM rows""", "symbols", "refs"),
)
def ego_dot(spark, sf):
    from graphloom.output import ego_dot as dot

    target = _target(spark, sf)
    return dot(relational.neighbors(view(spark, sf, "refs"), target), target)


@register(
    "full_dot",
    sql(
        f"""SELECT 0 AS part, {_DOT_HEAD} || '  "project" [shape=ellipse, label="Project\\n' || (SELECT count(*) FROM files) || ' files, ' || (SELECT count(*) FROM symbols) || ' symbols, ' || (SELECT count(*) FROM refs) || ' refs", fillcolor=lightyellow];' AS line
UNION ALL SELECT 1, '  "' || replace(file_path, ' ', '_') || '::' || replace(name, ' ', '_') || '" [label="' || name || '\\n[' || kind || '] L' || start_line || '"];' FROM symbols UNION ALL SELECT 2, '}}'""",
        "symbols", "refs", "files",
    ),
)
def full_dot(spark, sf):
    from graphloom.output import full_dot as dot

    return dot(view(spark, sf, "symbols"), stats(spark, sf)).select("part", "line")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked, fuzzy symbol search."""
    return search_fuzzy(spark, sf)


# -- source trees

#: A tree of files made of the documents: names like patterns, hidden folders, blanks, skipped folders, unknown endings, bytes that are no UTF-8.
_TREE = """SELECT coalesce(lang, 'xx') || CASE doc_id % 7 WHEN 0 THEN '/[' || doc_id || '].tsx' WHEN 1 THEN '/b{' || doc_id || '}.py' WHEN 2 THEN '/node_modules/x' || doc_id || '.js'
    WHEN 3 THEN '/_p/.h/' || doc_id || '.md' WHEN 4 THEN '/t' || doc_id || '.txt' WHEN 5 THEN '/latin ' || doc_id || '.go' ELSE '/deep/' || doc_id % 10 || '/' || doc_id % 3 || '/m*' || doc_id || '.rs' END AS path,
  doc_id % 7 = 5 AS latin, coalesce(text, '') AS text FROM documents"""


@register(
    "tree_scan",
    f"""SELECT path, CASE regexp_extract(path, '[a-z]+$') WHEN 'tsx' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' WHEN 'go' THEN 'go' ELSE 'rust' END AS language,
  CAST(strlen(text) + CASE WHEN latin THEN 1 ELSE 0 END AS BIGINT) AS size, md5(CASE WHEN latin THEN '�' ELSE '' END || text) AS digest FROM ({_TREE}) t WHERE NOT contains(path, 'node_modules') AND NOT path LIKE '%.txt'""",
)
def tree_scan(spark, sf):
    """Every document is written as a file and the tree scanned."""
    files = spark.sql(_TREE.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}"), documents=spark.read.parquet(f"{sf}/documents.parquet"))
    root = folder(spark)
    content = F.concat(F.when(F.col("latin"), F.unhex(F.lit("E9"))).otherwise(F.lit(b"")), F.col("text").cast("binary"))
    scan.write_files(files.select("path", content.alias("content")), root)
    return scan.scan(spark, root).select("path", "language", "size", F.md5("text").alias("digest"))


# -- saved indexes


def _full(df: DataFrame, name: str) -> DataFrame:
    """A view as an index table: columns that it lacks are null, 0 or false."""
    empty = {"string": F.lit(None), "boolean": F.lit(False)}
    of = store.SCHEMAS[name]
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit("") if not f.nullable and f.dataType.simpleString() == "string" else empty.get(f.dataType.simpleString(), F.lit(0))).cast(f.dataType).alias(f.name) for f in of))


def _saved(spark: SparkSession, sf: str) -> str:
    """Symbols, references, literals and files of the views, saved in buckets. A reference's callee is in the first file that defines the name."""
    symbols = view(spark, sf, "symbols")
    at = symbols.groupBy(F.col("name").alias("callee_symbol")).agg(F.min("file_path").alias("callee_file"))
    refs = view(spark, sf, "refs").join(at, "callee_symbol", "left").withColumn("callee_file", F.coalesce("callee_file", F.lit("")))
    files = symbols.select(F.col("file_path").alias("path")).distinct()
    path = folder(spark)
    store.save(spark, path, {"symbols": _full(symbols, "symbols"), "refs": _full(refs, "refs"), "literals": _full(view(spark, sf, "literals"), "literals"), "files": _full(files, "files")}, buckets=16)
    return path


def _rows_of(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    out = None
    for name, key in keys.items():
        rows = tables[name].select(F.lit(name).alias("tab"), F.col(key).cast("string").alias("item"))
        out = rows if out is None else out.unionByName(rows)
    return out


_GONE = "path IN (SELECT file_path FROM symbols WHERE id % 9 = 4)"
_CALLED = "(SELECT r.*, coalesce(m.f, '') AS callee_file FROM refs r LEFT JOIN (SELECT name, min(file_path) AS f FROM symbols GROUP BY name) m ON m.name = r.callee_symbol)"


@register(
    "delete_files_saved",
    sql(
        f"""SELECT 'symbols' AS tab, CAST(id AS VARCHAR) AS item FROM symbols WHERE file_path NOT IN (SELECT file_path FROM symbols WHERE id % 9 = 4)
UNION ALL SELECT 'refs', CAST(id AS VARCHAR) FROM {_CALLED} r WHERE caller_file NOT IN (SELECT file_path FROM symbols WHERE id % 9 = 4) AND callee_file NOT IN (SELECT file_path FROM symbols WHERE id % 9 = 4)
UNION ALL SELECT 'literals', CAST(id AS VARCHAR) FROM literals WHERE file_path NOT IN (SELECT file_path FROM symbols WHERE id % 9 = 4)
UNION ALL SELECT DISTINCT 'files', file_path FROM symbols WHERE file_path NOT IN (SELECT file_path FROM symbols WHERE id % 9 = 4)""",
        "symbols", "refs", "literals",
    ),
)
def delete_files_saved(spark, sf):
    """All tables of a saved index after files are deleted, references by either side."""
    at = _saved(spark, sf)
    store.update(spark, at, view(spark, sf, "symbols").where("id % 9 = 4").select(F.col("file_path").alias("path")), {}, either_side=True)
    return _rows_of(store.load(spark, at), {"symbols": "id", "refs": "id", "literals": "id", "files": "path"})


@register(
    "reindex_files_saved",
    sql(
        """SELECT 'symbols' AS tab, CAST(CASE WHEN file_path IN (SELECT file_path FROM symbols WHERE id % 9 = 4) THEN -id ELSE id END AS VARCHAR) AS item FROM symbols
UNION ALL SELECT 'refs', CAST(id AS VARCHAR) FROM refs WHERE caller_file NOT IN (SELECT file_path FROM symbols WHERE id % 9 = 4)
UNION ALL SELECT 'literals', CAST(id AS VARCHAR) FROM literals WHERE file_path NOT IN (SELECT file_path FROM symbols WHERE id % 9 = 4)""",
        "symbols", "refs", "literals",
    ),
)
def reindex_files_saved(spark, sf):
    """All tables of a saved index after files are indexed again: new symbols, no literals, references by the caller's file alone."""
    at = _saved(spark, sf)
    gone = view(spark, sf, "symbols").where("id % 9 = 4").select("file_path").distinct()
    fresh = _full(view(spark, sf, "symbols").join(gone, "file_path", "left_semi").withColumn("id", -F.col("id")), "symbols")
    store.update(spark, at, gone.select(F.col("file_path").alias("path")), {"symbols": fresh})
    return _rows_of(store.load(spark, at), {"symbols": "id", "refs": "id", "literals": "id"})


@register(
    "checksum_upsert",
    sql(
        """SELECT coalesce(d.path, s.path) AS path, md5(CASE WHEN d.path IS NULL THEN s.content ELSE d.content END) AS hash, strlen(CASE WHEN d.path IS NULL THEN s.content ELSE d.content END) AS size,
  coalesce(s.verify_count, 0) AS verify_count, CASE WHEN d.path IS NULL THEN 'mismatch' ELSE 'synced' END AS status FROM stored s FULL JOIN disk d ON d.path = s.path""",
        "stored", "disk",
    ),
)
def checksum_upsert(spark, sf):
    """Hashes of all files on disk put into the files and the checksums of a saved index, which move together."""
    was = view(spark, sf, "stored").select("path", F.md5("content").alias("hash"), F.octet_length("content").alias("size"), "verify_count", F.lit("mismatch").alias("status"))
    at = folder(spark)
    store.save(spark, at, {"files": _full(was, "files"), "checksums": _full(was, "checksums")}, buckets=16)
    store.upsert_checksums(spark, at, view(spark, sf, "disk").select("path", F.md5("content").alias("hash"), F.octet_length("content").cast("long").alias("size")))
    held = store.load(spark, at)
    return held["files"].select("path", "hash", "size").join(held["checksums"].select("path", "hash", "verify_count", "status"), ["path", "hash"])


@register(
    "clear_before_reindex",
    sql(
        """SELECT 'symbols' AS tab, CAST(id AS VARCHAR) AS item FROM symbols WHERE file_path NOT IN (SELECT file_path FROM literals WHERE id % 7 = 3)
UNION ALL SELECT 'literals', CAST(id AS VARCHAR) FROM literals WHERE file_path NOT IN (SELECT file_path FROM literals WHERE id % 7 = 3)
UNION ALL SELECT 'matches', l.id || ':' || s.id FROM literals l JOIN symbols s ON s.name = l.string_value WHERE l.file_path NOT IN (SELECT file_path FROM literals WHERE id % 7 = 3)""",
        "symbols", "literals",
    ),
)
def clear_before_reindex(spark, sf):
    """What files gave is dropped from symbols, literals and the matches of dropped literals."""
    symbols, literals = view(spark, sf, "symbols"), view(spark, sf, "literals")
    matches = literals.select(F.col("id").alias("literal_id"), F.col("string_value").alias("name")).join(symbols.select("name", F.col("id").alias("symbol_id")), "name").select("literal_id", "symbol_id", F.concat_ws(":", "literal_id", "symbol_id").alias("pair"))
    gone = literals.where("id % 7 = 3").select(F.col("file_path").alias("path")).distinct()
    out = incremental.clear_before_reindex(gone, symbols, view(spark, sf, "refs"), literals, matches)
    return _rows_of(out, {"symbols": "id", "literals": "id", "matches": "pair"})


# -- approximate names

#: Each part's name with a typo: a character lost, two swapped, one replaced, or a long run of changes that nothing is near to.
_TYPOS = f"""SELECT p_partkey AS qid, CASE p_partkey % 4 WHEN 0 THEN substr(name, 1, 2) || substr(name, 4) WHEN 1 THEN substr(name, 1, 3) || substr(name, 5, 1) || substr(name, 4, 1) || substr(name, 6)
  WHEN 2 THEN upper(substr(name, 1, 5)) || 'z' || substr(name, 7) ELSE 'qq' || substr(name, 5) END AS query FROM (SELECT p_partkey, {_of(_NAME, "p")} AS name FROM part p) n"""


@register(
    "nearest_names",
    _with(f"typos AS ({_TYPOS})", """SELECT qid, id, distance, place FROM (SELECT qid, id, distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, name, id) AS INTEGER) AS place
  FROM (SELECT qid, id, name, levenshtein(lower(query), lower(name)) AS distance FROM typos JOIN symbols ON abs(length(query) - length(name)) <= 2) x WHERE distance <= 2) WHERE place <= 10""", "symbols"),
)
def nearest_names(spark, sf):
    """The ten nearest symbols of every part's misspelt name."""
    typos = spark.sql(_TYPOS.replace("FROM part p", "FROM {part} p"), part=spark.read.parquet(f"{sf}/part.parquet"))
    return approximate.nearest(typos, view(spark, sf, "symbols")).select("qid", "id", F.col("distance").cast("long").alias("distance"), "place")


# -- substrings

#: Pieces of texts of one to fourteen characters, whole and in upper case, and some that no text holds.
_NEEDLES = """SELECT doc_id AS nid, CASE doc_id % 60 WHEN 0 THEN substr(text, 3, 12) WHEN 20 THEN upper(substr(text, 7, 8)) ELSE substr(text, 2, 14) || 'qz' END AS needle FROM documents WHERE doc_id % 20 = 0
UNION ALL SELECT -1, 'th' UNION ALL SELECT -2, 'z' UNION ALL SELECT -3, '.'"""


@register("substring_search", f"SELECT nid, doc_id AS key FROM ({_NEEDLES}) n JOIN documents d ON contains(d.text, n.needle)")
def substring_search(spark, sf):
    """Many needles at once in all whole texts, by an index of trigrams."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = folder(spark)
    trigrams.save(docs.select(F.col("doc_id").alias("key"), "text"), at)
    needles = spark.sql(_NEEDLES.replace("FROM documents", "FROM {documents}"), documents=docs)
    return trigrams.search(trigrams.load(spark, at), needles).select("nid", "key")


@register("like_many", _with(f"asked AS (SELECT p_partkey AS nid, substr({_of(_NAME, 'p')}, 3, 6) AS needle FROM part p)", "SELECT nid, id AS key FROM asked JOIN symbols ON contains(lower(name), lower(needle))", "symbols"))
def like_many(spark, sf):
    """A LIKE search a part, all at once: the symbols whose names hold a piece of the part's name in any case."""
    symbols = view(spark, sf, "symbols")
    at = folder(spark)
    trigrams.save(symbols.select(F.col("id").alias("key"), F.col("name").alias("text")), at)
    needles = spark.sql(f"SELECT p_partkey AS nid, substr({_of(_NAME, 'p')}, 3, 6) AS needle FROM {{part}} p", part=spark.read.parquet(f"{sf}/part.parquet"))
    return trigrams.search(trigrams.load(spark, at), needles, fold=True).select("nid", "key")


@register(
    "cross_language_classes",
    sql(f"""SELECT a.name, a.language AS language_a, a.kind AS kind_a, b.language AS language_b, b.kind AS kind_b, count(*) AS pairs, any_value(CASE WHEN {_COMPAT} THEN 0.7e0 ELSE 0.4e0 END) AS confidence
FROM symbols a JOIN symbols b ON a.name = b.name AND a.language < b.language GROUP BY a.name, a.language, a.kind, b.language, b.kind""", "symbols"),
)
def cross_language_classes(spark, sf):
    """All pairs of equal names in two languages, as counts of classes."""
    out = matching.cross_language_classes(view(spark, sf, "symbols"))
    return out.select("name", "language_a", "kind_a", "language_b", "kind_b", "pairs", F.round("confidence", 6).alias("confidence"))


@register("pagerank_buckets", _with(_pagerank_sql(), f"SELECT name, round(rank, 8) AS rank FROM r{ROUNDS}", "refs"))
def pagerank_buckets(spark, sf):
    """The ranks with edges and ranks kept in buckets, as for graphs whose ranks can't be broadcast."""
    ranks = graph.pagerank(graph.edge_list(view(spark, sf, "refs")), max_iter=ROUNDS, tolerance=0.0, few_rows=0)
    return ranks.select("name", F.round("rank", 8).alias("rank"))


# -- digests

_DEEP_PATH = "'r' || {0} % 3 || '/' || CASE WHEN {0} % 4 = 0 THEN '' ELSE 'd' || {0} % 20 || '/e/' END || {1}"


@register(
    "tree_differences",
    sql(
        f"""SELECT path, status FROM (SELECT CASE WHEN s.path IS NULL THEN {_DEEP_PATH.format("d.doc_id", "d.path")} ELSE {_DEEP_PATH.format("s.doc_id", "s.path")} END AS path,
  CASE WHEN s.path IS NULL THEN 'unknown' WHEN d.path IS NULL THEN 'missing' WHEN s.content IS NOT DISTINCT FROM d.content THEN 'clean' ELSE 'dirty' END AS status FROM stored s FULL JOIN disk d ON d.path = s.path) WHERE status <> 'clean'""",
        "stored", "disk",
    ),
)
def tree_differences(spark, sf):
    """What differs between the stored state of all files and the one on disk, by digests of folders."""
    at = folder(spark)
    for name in ("stored", "disk"):
        digests.save(view(spark, sf, name).select(F.expr(_DEEP_PATH.format("doc_id", "path")).alias("path"), F.md5("content").alias("hash")), f"{at}/{name}")
    return digests.differences(spark, f"{at}/stored", f"{at}/disk")


@register("recover_log", _with(_HASHED, "SELECT s.path, CASE WHEN d.hash IS NULL THEN 'skip_missing' WHEN d.hash = s.hash THEN 'skip_same' ELSE 'reindex' END AS action FROM s LEFT JOIN d USING (path)", "stored", "disk"))
def recover_log(spark, sf):
    """Recovery from a log of operations that was written in two commits, the first of them twice under one token."""
    held = _hashed(spark, sf, "stored").select(F.col("path").alias("file_path"), F.lit("Enqueue").alias("op"), F.col("hash").alias("file_hash"), "doc_id")
    at = folder(spark)
    for part, token in (("doc_id % 2 = 0", "first"), ("doc_id % 2 = 0", "first"), ("doc_id % 2 = 1", None)):
        operations.append(held.where(part), at, token)
    operations.append(held.withColumn("status", F.lit("Committed")).where("doc_id % 5 = 0"), at)
    return incremental.recover(operations.read(spark, at), _hashed(spark, sf, "disk"))


# -- more lookups


@register(
    "edit_order",
    _with(_USED, f"""SELECT part, item, CAST(row_number() OVER (PARTITION BY part ORDER BY g, k, l, i) AS INTEGER) AS place FROM (
  SELECT part, item, g, k, l, i, row_number() OVER (PARTITION BY part, item ORDER BY g, k, l, i) AS n FROM (
    SELECT 'affected' AS part, {TARGET} AS item, 0 AS g, '' AS k, 0 AS l, 0 AS i UNION ALL SELECT 'affected', name, 1, '', 0, id FROM used
    UNION ALL SELECT 'affected', callee_symbol, 2, ref_kind, line, id FROM near UNION ALL SELECT 'file', file_path, 1, '', 0, id FROM used)) WHERE n = 1""", "symbols", "refs"),
)
def edit_order(spark, sf):
    """Affected symbols and files of an edit plan in the order of first sight."""
    return graph.edit_order(view(spark, sf, "symbols"), view(spark, sf, "refs"), _target(spark, sf))


@register("rank_of_symbol", _with(RANKS, f"SELECT symbol_name, round(page_rank, 6) AS page_rank FROM ranks WHERE symbol_name = {TARGET}", "symbols", "refs"))
def rank_of_symbol(spark, sf):
    return relational.rank_of(_ranks(spark, sf), _target(spark, sf)).select("symbol_name", F.round("page_rank", 6).alias("page_rank"))


@register("file_status", sql("SELECT path, CASE WHEN path = 'f8' THEN 'dirty' ELSE 'valid' END AS status FROM disk", "disk"))
def file_status(spark, sf):
    return incremental.set_file_status(view(spark, sf, "disk").select("path", F.lit("valid").alias("status")), "f8", "dirty")


@register("cache_listing", sql("SELECT id, hit_count, CAST(row_number() OVER (ORDER BY hit_count DESC, id) AS INTEGER) AS place FROM cache ORDER BY hit_count DESC, id LIMIT 100", "cache"))
def cache_listing(spark, sf):
    """The hundred most used answers, in order."""
    held = incremental.cache_listing(view(spark, sf, "cache")).limit(100)
    return held.select("id", "hit_count", F.row_number().over(Window.orderBy(F.desc("hit_count"), "id")).alias("place"))


#: A literal's form: what stands before and after the text.
_QUOTES = {0: ('"', '"'), 1: ('f"', '"'), 2: ("b'", "'"), 3: ("'", "'"), 4: ('"' * 3, '"' * 3), 5: ("'" * 3, "'" * 3), 6: ('"', "")}
_LITERAL_SQL = (
    "SELECT doc_id, part, form IN (1, 2) AS noise, CASE form WHEN 1 THEN 'f\"' || body || '\"' WHEN 2 THEN 'b''' || body || '''' WHEN 6 THEN '\"' || body ELSE body END AS value "
    "FROM (SELECT doc_id, part, form, substr(text, 1 + part * 7, 9) AS body FROM (SELECT doc_id, text, part, (doc_id + part) % 7 AS form FROM (SELECT doc_id, text, CAST(unnest([0, 1, 2, 3, 4, 5, 6]) AS INTEGER) AS part FROM documents))) "
    "WHERE body <> '' AND NOT contains(body, '\"') AND NOT contains(body, '''')"
)


@register("literal_text", _LITERAL_SQL)
def literal_text(spark, sf):
    """Pieces of texts as string literals of every form: which are noise, and what stands between the quotes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", F.explode(F.array(*(F.lit(i) for i in range(7)))).alias("part"))
    body = F.substring(F.col("text"), F.lit(1) + F.col("part") * 7, F.lit(9))
    rows = rows.select("doc_id", "part", F.pmod(F.col("doc_id") + F.col("part"), F.lit(7)).alias("form"), body.alias("body"))
    rows = rows.where((F.col("body") != "") & ~F.contains("body", F.lit('"')) & ~F.contains("body", F.lit("'")))
    literal = F.coalesce(*(F.when(F.col("form") == k, F.concat(F.lit(a), F.col("body"), F.lit(b))) for k, (a, b) in _QUOTES.items()))
    return rows.select("doc_id", "part", scoring.is_noise_string(literal).alias("noise"), scoring.strip_quotes(literal).alias("value"))
