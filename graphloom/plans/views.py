"""The index tables bound to the relational test tables.

Each view is one SQL text that Spark and DuckDB both run, so that a query and its SQL check read the same input; the operators
themselves are DataFrame code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAME = "replace({p}.p_name, ' ', '_') || '_' || ({p}.p_partkey % 300)"
_EXT = "CASE {p}.p_size % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'js' WHEN 2 THEN 'go' WHEN 3 THEN 'rs' ELSE 'java' END"
_MODULE = "lower(replace({p}.p_brand, '#', '_'))"


def _of(text: str, p: str) -> str:
    return text.replace("{p}", p)


_FILE = f"'src/' || CASE WHEN {{p}}.p_size % 7 = 0 THEN 'tests/test_' ELSE '' END || {_MODULE} || '.' || {_EXT}"

VIEWS = {
    "symbols": f"""
SELECT p.p_partkey AS id, {_of(_FILE, "p")} AS file_path, {_of(_NAME, "p")} AS name,
  CASE p.p_type WHEN 'ECONOMY' THEN 'function' WHEN 'MEDIUM' THEN 'class' WHEN 'PROMO' THEN 'method' WHEN 'LARGE' THEN 'variable' ELSE 'interface' END AS kind,
  p.p_size * 10 + 1 AS start_line, p.p_size * 10 + 10 AS end_line, {_of(_MODULE, "p")} || '.' || {_of(_NAME, "p")} AS qualified_name,
  CASE WHEN p.p_partkey % 4 = 3 THEN NULL ELSE 'def ' || {_of(_NAME, "p")} || '(a, b: Optional[int], c=' || p.p_size || ') -> T' || (p.p_partkey % 3) END AS signature,
  CASE p.p_size % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' ELSE 'java' END AS language
FROM part p""",
    "refs": f"""
SELECT l_orderkey * 1000 + rn AS id, coalesce({_of(_FILE, "a")}, 'src/main.py') AS caller_file, {_of(_NAME, "a")} AS caller_symbol, {_of(_NAME, "b")} AS callee_symbol,
  CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'import' ELSE 'dynamic_dispatch' END AS ref_kind, l_linenumber AS line,
  CASE l_returnflag WHEN 'R' THEN 0.7e0 ELSE 1.0e0 END AS confidence, l_returnflag = 'R' AS is_dynamic
FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn,
        lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS before
      FROM lineitem) l
JOIN part b ON b.p_partkey = l.l_partkey LEFT JOIN part a ON a.p_partkey = l.before""",
    "files": """
SELECT 'docs/' || coalesce(lang, 'xx') || '/' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.jsx' WHEN 2 THEN '.md' WHEN 3 THEN '.h' WHEN 4 THEN '.pyi' ELSE '.txt' END AS path, doc_id, text
FROM documents""",
    "literals": f"""
SELECT e.event_id AS id, 'src/u' || e.user_id || '.py' AS file_path, e.user_id AS line_number,
  CASE e.event_id % 5 WHEN 0 THEN {_of(_NAME, "p")} WHEN 1 THEN {_of(_MODULE, "p")} || '.' || {_of(_NAME, "p")} WHEN 2 THEN 'pkg.mod.' || {_of(_NAME, "p")} WHEN 3 THEN 'x.' || {_of(_NAME, "p")} || '.y' ELSE 'v1.2/' || e.user_id END AS string_value,
  CASE e.event_type WHEN 'click' THEN 'function_arg' WHEN 'view' THEN 'kwarg' WHEN 'error' THEN 'sequence_element' ELSE 'unknown' END AS context
FROM (SELECT event_id, user_id, event_type, CAST(floor(event_id / 5) AS BIGINT) % (SELECT count(*) FROM part) AS k FROM events) e JOIN part p ON p.p_partkey = e.k""",
    "file_events": """
SELECT event_id AS id, 'src/u' || user_id || CASE WHEN user_id % 9 = 0 THEN '.log' ELSE '.py' END AS path, ts,
  CASE event_type WHEN 'click' THEN 'modify_data' WHEN 'signup' THEN 'modify_name' WHEN 'purchase' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'access' END AS event_type
FROM events""",
    "overrides": f"""
SELECT s.s_suppkey AS id, {_of(_NAME, "a")} AS caller_symbol, {_of(_NAME, "b")} AS callee_symbol, 'override' AS ref_kind, 0.9e0 AS confidence
FROM supplier s JOIN part a ON a.p_partkey = s.s_suppkey JOIN part b ON b.p_partkey = s.s_suppkey + 1""",
    "entities": f"""
SELECT p.p_partkey AS id, {_of(_NAME, "p")} AS name FROM part p UNION ALL SELECT 1000000000 + s_suppkey, 'supplier_' || s_suppkey FROM supplier""",
    "uses": f"""
SELECT {_of(_NAME, "p")} AS caller_symbol, {_of(_NAME, "p")} AS callee_symbol FROM part p WHERE p.p_type <> 'PROMO'
UNION ALL SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'supplier_' || c_nationkey ELSE 'outside' END, 'supplier_' || (c_nationkey + 1) FROM customer""",
    "commits": f"""
SELECT {_of(_FILE, "p")} AS path, '2024-01-0' || (count(*) % 9 + 1) AS last_commit, CASE WHEN count(*) % 2 = 0 THEN 'Deprecate the old form' ELSE 'Change it' END AS message FROM part p GROUP BY 1""",
    "stored": "SELECT 'f' || doc_id AS path, doc_id, text AS content, doc_id % 3 AS verify_count FROM documents WHERE doc_id % 10 <> 3",
    "disk": "SELECT 'f' || doc_id AS path, doc_id, CASE WHEN doc_id % 8 = 0 THEN text || ' changed' ELSE text END AS content FROM documents WHERE doc_id % 10 <> 7",
    "dirty": """
SELECT event_id AS id, 'src/u' || user_id || '.py' AS path, event_type AS reason, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 0 WHEN 'click' THEN -1 ELSE 5 END AS priority, ts AS enqueued_at
FROM events""",
    "cache": "SELECT event_id AS id, 'q:' || user_id AS query_key, event_type AS result_json, ts AS created_at, event_id % 11 AS hit_count, event_id % 97 AS ttl FROM events",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bound view; its tables are read with the columns it uses alone."""
    text, tables = VIEWS[name], {}
    for t in _TABLES:
        for before in ("FROM ", "JOIN "):
            if f"{before}{t}" in text:
                text = text.replace(f"{before}{t}", f"{before}{{{t}}}")
                tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(text, **tables)


def sql(query: str, *names: str) -> str:
    """The query after the views of these names as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + query
