"""Lookups, joins, counts and ordered limits over the index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import scoring
from graphloom.operators import approximate
from graphloom.plans.storage import written

LIMIT = 50
#: Distinct texts of a batch search whose lists of symbols may be broadcast; beyond it they meet their queries by a shuffle.
MOST_LISTS = 50_000
SYMBOL = ("id", "file_path", "name", "kind", "start_line", "end_line", "qualified_name")


def _like(column: Column, pattern: str, escape: bool) -> Column:
    """SQL LIKE %pattern%, case-blind for ASCII letters alone. Wildcards in the pattern count unless ``escape``."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = "".join(c.lower() if c.isascii() else c for c in pattern)
    if escape or not set(low) & set("%_\\"):
        return F.contains(fold(column), F.lit(low))
    return fold(column).like("%" + low.replace("\\", "\\\\") + "%")


def search(symbols: DataFrame, pattern: str, limit: int | None = LIMIT, escape: bool = False) -> DataFrame:
    """Symbols whose name or qualified name holds the pattern, by kind, name and id."""
    found = symbols.where(_like(F.col("name"), pattern, escape) | _like(F.col("qualified_name"), pattern, escape)).orderBy("kind", "name", "id")
    return found.limit(limit) if limit else found


def search_ranked(symbols: DataFrame, ranks: DataFrame, pattern: str, limit: int | None = LIMIT, escape: bool = False) -> DataFrame:
    """The same with page_rank, by falling rank, nulls last. The filter comes first; the rank table joins what is left."""
    found = symbols.where(_like(F.col("name"), pattern, escape) | _like(F.col("qualified_name"), pattern, escape))
    joined = found.join(ranks.select(F.col("symbol_name").alias("name"), "page_rank"), "name", "left").orderBy(F.desc_nulls_last("page_rank"), "kind", "name", "id")
    return joined.limit(limit) if limit else joined


def search_fuzzy(symbols: DataFrame, ranks: DataFrame, query: str, kind: str | None = None, min_score: float = 0.3, limit: int = 20, weights=(scoring.FUZZY, scoring.RANK, scoring.KIND), compat: bool = True) -> DataFrame:
    """Candidates scored by name, filtered, combined with kind and rank. ``compat`` takes the ranked search's candidates; otherwise
    every symbol is scored, so that misspelt queries find something."""
    held = search_ranked(symbols, ranks, query) if compat else symbols.join(ranks.select(F.col("symbol_name").alias("name"), "page_rank"), "name", "left")
    fuzzy = scoring.fuzzy_score(F.lit(query), F.col("name"))
    kinds = F.lit(True) if kind is None else F.lower("kind") == kind.lower()
    scored = held.withColumn("fuzzy", fuzzy).where(F.col("fuzzy") >= min_score).withColumn("score", scoring.combined_score(F.col("fuzzy"), kinds, F.col("page_rank"), weights))
    return scored.orderBy(F.desc("score"), F.desc_nulls_last("page_rank"), "kind", "name", "id").limit(limit)


def search_batch(symbols: DataFrame, ranks: DataFrame, queries: DataFrame, limit: int = 10, edits: int = approximate.EDITS) -> DataFrame:
    """Many queries (qid, query) at once, each as a text: the best of the symbols that share an identifier token with it or are within the edits of it.

    Equal names are scored once a query, and each of them gives its first symbols alone, so neither many equal names nor many equal queries
    multiply the pairs."""
    tokens = lambda c: F.explode(F.array_distinct(scoring.split_identifier(F.lower(c))))
    asked, names = queries.select("query").where("query is not null").distinct(), symbols.select("name").where("name is not null").distinct()
    shared = asked.select("query", tokens(F.col("query")).alias("token")).join(names.select("name", tokens(F.col("name")).alias("token")), "token").select("query", "name")
    low = approximate.within(asked.select(F.lower("query").alias("query")), names.select(F.lower("name").alias("name")), edits)
    near = asked.withColumn("__q", F.lower("query")).join(low.select(F.col("query").alias("__q"), F.col("name").alias("__n")), "__q").join(names.withColumn("__n", F.lower("name")), "__n").select("query", "name")
    pairs = shared.unionByName(near).distinct()
    by_name = ranks.groupBy(F.col("symbol_name").alias("name")).agg(F.max("page_rank").alias("page_rank"))
    scored = pairs.join(by_name, "name", "left").withColumn("score", scoring.combined_score(scoring.fuzzy_score(F.col("query"), F.col("name")), F.lit(True), F.col("page_rank")))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "name")
    few = scored.withColumn("__k", F.row_number().over(top)).where(F.col("__k") <= limit).drop("__k")
    first = Window.partitionBy("name").orderBy("id")
    held = symbols.select("id", "name", "kind").withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= limit).drop("__k")
    # a text is ranked once and its queries share the list, so that no task holds the candidates of all queries of a text
    once = Window.partitionBy("query").orderBy(F.desc("score"), "name", "id")
    ranked = few.join(held, "name").withColumn("__k", F.row_number().over(once)).where(F.col("__k") <= limit).drop("__k")
    rest = [c for c in ranked.columns if c not in ("name", "query")]
    lists = written(ranked.groupBy("query").agg(F.collect_list(F.struct("name", *rest)).alias("f")))
    lists = F.broadcast(lists) if lists.count() <= MOST_LISTS else lists
    # dealt by number before rows multiply: AQE would merge these short rows into few tasks, and the sort by qid needs no other shuffle
    dealt = queries.select("qid", "query").repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid")
    found = dealt.join(lists, "query").select("query", "qid", F.explode("f").alias("f")).select("f.name", "query", "qid", *(f"f.{c}" for c in rest))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "name", "id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)


def file_symbols(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == path).orderBy("start_line", "id")


def resolve_name(symbols: DataFrame, name: str) -> DataFrame:
    """One row ``name``: the name of the first symbol of that (qualified) name, or the input."""
    column = "qualified_name" if "." in name else "name"
    return symbols.where(F.col(column) == name).agg(F.coalesce(F.min_by("name", "id"), F.lit(name)).alias("name"))


def rank_of(ranks: DataFrame, name: str) -> DataFrame:
    return ranks.where(F.col("symbol_name") == name)


def top_ranks(ranks: DataFrame, n: int = 20) -> DataFrame:
    return ranks.orderBy(F.desc("page_rank"), "symbol_name").limit(n)


def overrides_of(overrides: DataFrame, symbol: str) -> DataFrame:
    return overrides.where((F.col("caller_symbol") == symbol) | (F.col("callee_symbol") == symbol)).orderBy("id")


def without_override(overrides: DataFrame, ids: DataFrame) -> DataFrame:
    return overrides.join(ids.select("id"), "id", "left_anti")


def uncovered(names: DataFrame, overrides: DataFrame) -> DataFrame:
    """Names (name) that no override mentions on either side."""
    held = overrides.select(F.col("caller_symbol").alias("name")).union(overrides.select(F.col("callee_symbol").alias("name")))
    return names.join(held, "name", "left_anti")


def deduplicated(refs: DataFrame) -> DataFrame:
    """References unique by their key; rows without a caller are all kept, as nulls are distinct in a unique key. The least id stays."""
    key = ["caller_file", "caller_symbol", "callee_symbol", "ref_kind", "line"]
    named = refs.where(F.col("caller_symbol").isNotNull())
    rest = [c for c in refs.columns if c not in key]
    one = named.groupBy(*key).agg(F.min_by(F.struct(*rest), "id").alias("r")).select(*key, "r.*").select(*refs.columns)
    return one.unionByName(refs.where(F.col("caller_symbol").isNull()))


def stats(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """One row (files, symbols, refs)."""
    one = lambda df, name: df.select(F.lit(name).alias("what"))
    return one(files, "files").union(one(symbols, "symbols")).union(one(refs, "refs")).agg(*(F.count_if(F.col("what") == w).alias(w) for w in ("files", "symbols", "refs")))


def majority_language(files: DataFrame) -> DataFrame:
    return files.where("language is not null").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(1)


def index_summary(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(language, files, symbols, refs): references count for the language of their caller's file."""
    by_file = symbols.groupBy("file_path", "language").agg(F.count("*").alias("symbols"))
    calls = refs.groupBy(F.col("caller_file").alias("file_path")).agg(F.count("*").alias("refs"))
    return by_file.join(calls, "file_path", "left").groupBy("language").agg(F.count("*").alias("files"), F.sum("symbols").alias("symbols"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"))


def neighbors(refs: DataFrame, symbol: str, limit: int | None = 100) -> DataFrame:
    found = refs.where((F.col("caller_symbol") == symbol) | (F.col("callee_symbol") == symbol)).orderBy("ref_kind", "line", "id")
    return found.limit(limit) if limit else found


def neighbor_split(refs: DataFrame, symbol: str) -> DataFrame:
    """One row (callers, callees): sorted distinct names on either side."""
    near = refs.where((F.col("caller_symbol") == symbol) | (F.col("callee_symbol") == symbol))
    return near.agg(F.array_sort(F.collect_set(F.when(F.col("callee_symbol") == symbol, F.col("caller_symbol")))).alias("callers"), F.array_sort(F.collect_set(F.when(F.col("caller_symbol") == symbol, F.col("callee_symbol")))).alias("callees"))


def callers(symbols: DataFrame, refs: DataFrame, symbol: str, limit: int | None = LIMIT) -> DataFrame:
    """Symbols that refer to the one that ``symbol`` resolves to: a semi-join on names."""
    target = F.broadcast(resolve_name(symbols, symbol))  # one row
    names = refs.join(target, F.col("callee_symbol") == F.col("name"), "left_semi").select(F.col("caller_symbol").alias("name"))
    found = symbols.join(names, "name", "left_semi").orderBy("id")
    return found.limit(limit) if limit else found


def callers_ranked(symbols: DataFrame, refs: DataFrame, ranks: DataFrame, symbol: str, limit: int | None = LIMIT) -> DataFrame:
    found = callers(symbols, refs, symbol, None).join(ranks.select(F.col("symbol_name").alias("name"), "page_rank"), "name", "left").orderBy(F.desc_nulls_last("page_rank"), "name", "id")
    return found.limit(limit) if limit else found


def read_symbol(symbols: DataFrame, files: DataFrame, name: str, root: str = "") -> DataFrame:
    """The best hit for a name, exact ones first, with its file's text; only below ``root``."""
    exact = F.when((F.col("name") == name) | (F.col("qualified_name") == name), 0).otherwise(1)
    hit = search(symbols, name).where(F.startswith("file_path", F.lit(root))).orderBy(exact, "kind", "name", "id").limit(1)
    return F.broadcast(hit).join(files.select(F.col("path").alias("file_path"), "text"), "file_path")
