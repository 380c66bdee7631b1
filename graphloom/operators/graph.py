"""Graph operators over references: degrees, PageRank, impact layers, and the edit checks built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import language, scoring
from graphloom.operators import relational
from graphloom.plans.storage import MOST_ROWS, bucketed, drop_tables, rounds, written


def edge_list(refs: DataFrame) -> DataFrame:
    """(src, dst), parallel edges kept; references without a caller are none."""
    return refs.where("caller_symbol is not null and caller_symbol != ''").select(F.col("caller_symbol").alias("src"), F.col("callee_symbol").alias("dst"))


def degrees(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, name, in_degree, out_degree) a symbol row: both counts come from one pass over the references."""
    ends = F.explode(F.array(F.struct(F.col("callee_symbol").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("caller_symbol").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    counted = refs.select(ends.alias("e")).select("e.*").where("name is not null").groupBy("name").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return symbols.select("id", "name").join(counted, "name", "left").select("id", "name", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tolerance: float = 1e-6, few_rows: int = MOST_ROWS) -> DataFrame:
    """(name, rank): ranks sum to one; the mass of nodes without out-edges is spread over all.

    Parallel edges are folded into weights once. Each round is written to the shared folder, which cuts the lineage, and one action
    brings its change and its dangling mass; the tables of the rounds before are deleted at the end. Ranks are joined by a broadcast only
    while they are few. Beyond that edges and ranks are kept in buckets of the node, as many as a shuffle has partitions, so that a round moves
    its contributions alone, once."""
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with rounds(spark):
        weights = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
        out = weights.groupBy("src").agg(F.sum("n").alias("of"))
        weights = written(weights.join(out, "src").select("src", "dst", (F.col("n") / F.col("of")).alias("w")))
        sources = out.select(F.col("src").alias("name"), F.lit(True).alias("sends"))
        nodes = written(weights.select(F.explode(F.array("src", "dst")).alias("name")).distinct().join(sources, "name", "left").select("name", F.coalesce("sends", F.lit(False)).alias("sends")))
        n = nodes.count()
        few = n <= few_rows
        if not few:
            weights = bucketed(weights, "src", buckets)
        ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
        ranks = ranks if few else bucketed(ranks, "name", buckets)
        dangling = nodes.where(~F.col("sends")).count() / max(n, 1)
        for _ in range(max_iter if n else 0):
            base = (1 - damping) / n + damping * dangling / n
            ranks = pagerank_round(weights, ranks, base, damping, few)
            ranks = written(ranks) if few else bucketed(ranks, "name", buckets)
            delta, dangling = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("was"))), F.coalesce(F.sum(F.when(~F.col("sends"), F.col("rank"))), F.lit(0.0))).first()
            if delta <= tolerance:
                break
        ranks = written(ranks.select("name", "rank"))
        drop_tables(spark)
    return ranks


def pagerank_round(weights: DataFrame, ranks: DataFrame, base: float, damping: float, few: bool) -> DataFrame:
    """(name, sends, was, rank) after one round."""
    held = ranks.select(F.col("name").alias("src"), "rank")
    sent = weights.join(F.broadcast(held) if few else held.hint("merge"), "src").select(F.col("dst").alias("name"), (F.col("rank") * F.col("w")).alias("part"))
    got = sent.groupBy("name").agg(F.sum("part").alias("got"))
    before = ranks.select("name", "sends", F.col("rank").alias("was"))
    return before.join(got if few else got.hint("merge"), "name", "left").select("name", "sends", "was", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))


def combined_rank(symbols: DataFrame, refs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(symbol_name, page_rank, in_degree, out_degree) a distinct symbol name: 0.7 of the relative rank, 0.3 of the relative degree."""
    by_name = degrees(symbols, refs).groupBy("name").agg(F.max("in_degree").alias("in_degree"), F.max("out_degree").alias("out_degree"))
    top = ranks.agg(F.greatest(F.max("rank"), F.lit(1e-10)).alias("top"))  # one row
    most = by_name.agg(F.greatest(F.max(F.greatest("in_degree", "out_degree")), F.lit(1)).alias("most"))  # one row
    one = F.broadcast(top.join(F.broadcast(most)))
    score = 0.7 * F.coalesce("rank", F.lit(0.0)) / F.coalesce("top", F.lit(1e-10)) + 0.3 * (F.col("in_degree") + F.col("out_degree")) / (2.0 * F.col("most"))
    return by_name.join(ranks, "name", "left").join(one).select(F.col("name").alias("symbol_name"), score.alias("page_rank"), "in_degree", "out_degree")


def impact_layers(symbols: DataFrame, refs: DataFrame, symbol: str, depth: int = 3, include_tests: bool = False, cap: int | None = 50) -> DataFrame:
    """(depth, name, pos): the names that reach ``symbol`` in that many calls, first seen at that depth.

    Distinct edges are written once and joined with the whole frontier a layer. Without a cap a name's place is the least of its callees' and its
    own least id, two aggregates; with one, no name has more than its ``cap`` least ids before callers are numbered. ``cap`` bounds the caller rows a name, in the order of their ids, as the single-node tool
    does; None lifts it."""
    spark = symbols.sparkSession
    by_qualified = symbols.groupBy(F.col("qualified_name").alias("asked")).agg(F.min_by("name", "id").alias("of"))
    edges = written(refs.where("caller_symbol is not null").select("callee_symbol", "caller_symbol").distinct())
    held = symbols.select("id", "name", "file_path")
    if cap:
        held = held.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("place") <= cap).drop("place")
    elif not include_tests:
        held = held.where(~scoring.is_test_path(F.col("file_path")))
    held = written(held if cap else held.groupBy("name").agg(F.min("id").alias("id")))
    # a name's place is the path of ids by which it was first seen: layers sort by it without being numbered in one task
    visited = spark.createDataFrame([(0, symbol, [])], "depth int, name string, pos array<bigint>")
    frontier = visited
    for d in range(1, depth + 1):
        asked = frontier.select(F.col("name").alias("asked"), "pos")
        dotted = asked.where(F.contains("asked", F.lit("."))).join(by_qualified, "asked", "left").select(F.coalesce("of", "asked").alias("callee_symbol"), "pos")
        plain = asked.where(~F.contains("asked", F.lit("."))).select(F.col("asked").alias("callee_symbol"), "pos")
        hit = edges.join(dotted.union(plain), "callee_symbol").select("callee_symbol", "pos", F.col("caller_symbol").alias("name"))
        if cap:
            rows = held.join(hit.distinct(), "name")
            rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("callee_symbol", "pos").orderBy("id"))).where(F.col("place") <= cap)
            if not include_tests:
                rows = rows.where(~scoring.is_test_path(F.col("file_path")))
        else:
            rows = held.join(hit.groupBy("name").agg(F.min("pos").alias("pos")), "name")
        found = rows.groupBy("name").agg(F.min(F.struct("pos", "id")).alias("at")).join(visited, "name", "left_anti")
        frontier = written(found.select(F.lit(d).alias("depth"), "name", F.concat("at.pos", F.array("at.id")).alias("pos")))
        if not frontier.limit(1).count():
            break
        visited = visited.unionByName(frontier)
    return visited.where("depth > 0")


def impact_deep(symbols: DataFrame, refs: DataFrame, symbol: str, depth: int = 3, include_tests: bool = False, include_dynamic: bool = True) -> dict:
    """The deep impact as DataFrames and the texts made of them: layers, test_gaps, dynamic_at_risk; critical_path, recommendation."""
    names = written(impact_layers(symbols, refs, symbol, depth, include_tests))
    layers = names.groupBy("depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("symbols"))
    layers = layers.select("depth", "symbols", F.when(F.col("depth") == 2, 0.82).otherwise(0.95).alias("confidence"), F.when(F.col("depth") == 1, "low").when(F.col("depth") == 2, "medium").otherwise("high").alias("risk")).orderBy("depth")
    gaps = test_gaps(symbols, refs, names.where("depth >= 2").select("depth", "name"))
    risky = dynamic_at_risk(refs, names, symbol)
    first = {r.depth: r.name for r in names.groupBy("depth").agg(F.min_by("name", F.struct("pos", "name")).alias("name")).collect()}
    path = " → ".join(["→ " + symbol, *(first[d] for d in sorted(first))]) if len(first) >= 2 else None
    n_gaps, n_risky = gaps.count(), risky.count() if include_dynamic else 0
    if not first:
        advice = "No transitive dependencies found. Safe to modify."
    elif max(first) >= 3:
        advice = "Modify with caution. Add tests for depth-3+ symbols before refactoring."
    elif n_gaps:
        advice = f"Proceed with care. {n_gaps} symbols lack test coverage."
    elif n_risky:
        advice = f"Watch for {n_risky} dynamic references that may break at runtime."
    else:
        advice = "Low risk. Direct dependencies are well-contained."
    return {"target": symbol, "layers": layers, "critical_path": path, "test_gaps": gaps, "dynamic_at_risk": risky, "recommendation": advice}


def test_gaps(symbols: DataFrame, refs: DataFrame, names: DataFrame) -> DataFrame:
    """Those of ``names`` (depth, name) that no symbol in a test file refers to."""
    tested = refs.select(F.col("caller_symbol").alias("caller"), F.col("callee_symbol").alias("name")).join(symbols.where(scoring.is_test_path(F.col("file_path"))).select(F.col("name").alias("caller")), "caller", "left_semi")
    return names.join(tested, "name", "left_anti").select("depth", "name")


test_gaps.__test__ = False


def dynamic_at_risk(refs: DataFrame, names: DataFrame, symbol: str) -> DataFrame:
    """(expr, confidence, file): dynamic references around the visited names whose callee isn't one of them."""
    visited = names.select("name").union(names.sparkSession.createDataFrame([(symbol,)], "name string")).distinct()
    dynamic = refs.where("is_dynamic")
    near = dynamic.join(visited.select(F.col("name").alias("caller_symbol")), "caller_symbol", "left_semi").join(visited.select(F.col("name").alias("callee_symbol")), "callee_symbol", "left_anti")
    return near.select(F.concat_ws(".", F.coalesce("caller_symbol", F.lit("?")), "callee_symbol").alias("expr"), "confidence", F.col("caller_file").alias("file"))


def edit_plan(symbols: DataFrame, refs: DataFrame, symbol: str, changes: list[dict]) -> DataFrame:
    """Rows (part, name, file_path, change_type, description): affected symbols, files to update and breaking changes."""
    used = relational.callers(symbols, refs, symbol).select("name", "file_path", "id")
    near = relational.neighbors(refs, symbol).select("callee_symbol", "id")
    affected = used.select("name").union(near.select("callee_symbol")).union(symbols.sparkSession.createDataFrame([(symbol,)], "name string")).distinct()
    none = F.lit(None).cast("string")
    out = affected.select(F.lit("affected").alias("part"), "name", none.alias("file_path"), none.alias("change_type"), none.alias("description"))
    out = out.union(used.select(F.lit("file"), none, "file_path", none, none).distinct())
    for c in changes:
        kind, d = c["change_type"], c.get("details", {})
        if kind == "rename" and not (d.get("from") and d.get("to")):
            continue
        text = {
            "rename": f"Update reference from '{d.get('from', '')}' to '{d.get('to', '')}'",
            "add_param": f"Caller must add parameter '{d.get('param', '')}' to call site",
            "remove_param": f"Caller must remove parameter '{d.get('param', '')}' from call site",
            "change_return": f"Return type changed — caller may need to adapt to '{d.get('new_return', '')}'",
        }[kind]
        out = out.union(used.select(F.lit("breaking"), "name", "file_path", F.lit(kind), F.lit(text)))
    return out


def edit_order(symbols: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """(part, item, place): an edit plan's affected symbols and its files, each in the order of first sight: the symbol itself, its callers, what is
    beside it; files by their callers. All lists are limited, so the order is one of few rows."""
    used = relational.callers(symbols, refs, symbol)
    near = relational.neighbors(refs, symbol)
    at = lambda g, k, line, i: F.struct(F.lit(g).alias("g"), k.alias("k"), line.cast("long").alias("l"), i.cast("long").alias("i")).alias("at")
    no, zero = F.lit(""), F.lit(0)
    itself = symbols.sparkSession.createDataFrame([(symbol,)], "item string").select(F.lit("affected").alias("part"), "item", at(0, no, zero, zero))
    seen = lambda df, part, item, *place: df.select(F.lit(part).alias("part"), F.col(item).alias("item"), at(*place, F.col("id")))
    every = itself.unionByName(seen(used, "affected", "name", 1, no, zero)).unionByName(seen(near, "affected", "callee_symbol", 2, F.col("ref_kind"), F.col("line"))).unionByName(seen(used, "file", "file_path", 1, no, zero))
    first = every.groupBy("part", "item").agg(F.min("at").alias("at"))
    return first.select("part", "item", F.row_number().over(Window.partitionBy("part").orderBy("at")).alias("place"))


def edit_plan_summary(plan: DataFrame) -> DataFrame:
    """One row: counts, safe_to_proceed (nothing breaks, or renames alone) and 50 tokens an affected symbol."""
    return plan.agg(
        F.count_if(F.col("part") == "affected").alias("affected"), F.count_if(F.col("part") == "file").alias("files"), F.count_if(F.col("part") == "breaking").alias("breaking"),
        (F.count_if((F.col("part") == "breaking") & (F.col("change_type") != "rename")) == 0).alias("safe_to_proceed"), (50 * F.count_if(F.col("part") == "affected")).alias("estimated_tokens"),
    )


def dead_code(symbols: DataFrame, refs: DataFrame, symbol: str, stages: tuple[str, ...] = (), commits: DataFrame | None = None) -> DataFrame:
    """Rows (stage, status, found): sorted names or places; no stages means the static one. ``commits`` (path, last_commit, message) is
    optional; without it the history stage has no row. Only ``fail`` blocks a deletion."""
    stages = stages or ("static_refs",)
    used = relational.callers(symbols, refs, symbol)
    listed = lambda df, c: df.agg(F.array_sort(F.collect_list(c)).alias("found"))
    row = lambda df, stage, bad: df.select(F.lit(stage).alias("stage"), F.when(F.size("found") > 0, bad).otherwise("pass").alias("status"), "found")
    out = []
    if "static_refs" in stages:
        out.append(row(listed(used, "name"), "static_refs", "fail"))
    if "dynamic_refs" in stages:
        place = F.concat(F.col("caller_file"), F.lit(" (confidence: "), F.format_number("confidence", 1), F.lit(")"))
        out.append(row(listed(relational.neighbors(refs, symbol).where("is_dynamic"), place), "dynamic_refs", "fail"))
    if "string_refs" in stages:
        like = relational.search(symbols, symbol).where(F.col("name") != symbol).orderBy("kind", "name", "id").limit(10)
        out.append(row(listed(like, F.concat(F.col("name"), F.lit(" in "), F.col("file_path"))), "string_refs", "warn"))
    if "git_history" in stages and commits is not None:
        first = relational.search(symbols, symbol, 1).select(F.col("file_path").alias("path"))
        held = commits.join(F.broadcast(first), "path")
        out.append(held.select(F.lit("git_history").alias("stage"), F.when(F.contains(F.lower("message"), F.lit("deprecat")), "warn").otherwise("info").alias("status"), F.array("last_commit", "message").alias("found")))
    if "test_refs" in stages:
        out.append(row(listed(used.where(scoring.is_test_path(F.col("file_path"))), "name"), "test_refs", "warn"))
    total = out[0]
    for df in out[1:]:
        total = total.union(df)
    return total


def safe_to_delete(stages: DataFrame) -> DataFrame:
    blocked = F.count_if(F.col("status") == "fail") > 0
    return stages.agg((~blocked).alias("safe_to_delete"), F.when(blocked, "Do not delete. Mark as deprecated and monitor for 1 release cycle.").otherwise("Safe to delete. No references found.").alias("suggestion"))


def static_dead_code(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Every symbol that nothing known refers to: the static stage for all symbols in one anti-join."""
    known = refs.where("caller_symbol is not null").join(symbols.select(F.col("name").alias("caller_symbol")), "caller_symbol", "left_semi")
    return symbols.join(known.select(F.col("callee_symbol").alias("name")), "name", "left_anti")


def module_move(symbols: DataFrame, refs: DataFrame, symbol: str, module: str, project_language: str | None = None, update_imports: bool = True) -> DataFrame:
    """Rows (part, path, action, symbol, moved_from, moved_to): files to modify, and unresolved references that need review.

    The first search hit is moved; no rows if there is none."""
    target = F.broadcast(relational.search(symbols, symbol, 1).select("name", "file_path"))
    new = F.concat(F.lit(module + "."), F.col("name"))
    none = F.lit(None).cast("string")
    lang = F.lit(project_language) if project_language else F.coalesce(language.language_of(F.col("file_path"), "stored"), F.lit("python"))
    out = target.select(F.lit("modify").alias("part"), F.col("file_path").alias("path"), F.lit("delete_symbol").alias("action"), F.lit(symbol).alias("symbol"), none.alias("moved_from"), none.alias("moved_to"))
    out = out.union(target.select(F.lit("modify"), language.target_path(F.lit(module), lang), F.lit("insert_symbol"), new, none, none))
    used = relational.callers(symbols, refs, symbol).select(F.col("file_path").alias("used_in"), F.col("name").alias("caller"))
    if update_imports:
        out = out.union(used.join(target).select(F.lit("modify"), "used_in", F.lit("update_import"), none, F.lit(symbol), new))
    else:
        out = out.union(used.select(F.lit("unresolved"), "used_in", F.lit("static_import"), F.concat(F.lit(f"import {symbol} from caller "), F.col("caller")), none, none))
    dynamic = relational.neighbors(refs, symbol).where("is_dynamic")
    return out.union(dynamic.select(F.lit("unresolved"), "caller_file", F.lit("dynamic_ref"), F.concat(F.lit("Dynamic reference with confidence "), F.format_number("confidence", 1)), none, none))


def move_summary(plan: DataFrame) -> DataFrame:
    files, open_ = F.count_if(F.col("part") == "modify"), F.count_if(F.col("part") == "unresolved")
    reason = F.when(open_ == 0, "All references can be automatically updated.").otherwise(F.concat(open_.cast("string"), F.lit(" unresolved references require manual review")))
    return plan.agg((50 * files + 30 * open_).alias("estimated_tokens"), (open_ == 0).alias("safe_to_execute"), reason.alias("reason"))


def signature_check(symbols: DataFrame, refs: DataFrame, symbol: str, new_signature: str) -> DataFrame:
    """Rows (symbol, call_site, issue) a caller; issue is null for callers that stay safe."""
    held = F.broadcast(relational.search(symbols, symbol, 1).select(F.coalesce("signature", F.lit("")).alias("old")))
    new = F.lit(new_signature)
    needed, had = scoring.count_required_params(new), scoring.count_required_params(F.col("old"))
    issue = F.when(needed > had, F.concat(F.lit("New signature requires "), needed, F.lit(" params, old required "), had, F.lit(" — caller may need update"))).when(scoring.return_type_changed(F.col("old"), new), "Return type changed — caller may need to adapt")
    used = relational.callers(symbols, refs, symbol).select(F.col("name").alias("symbol"), F.concat(F.col("name"), F.lit("()")).alias("call_site"))
    return used.join(held).select("symbol", "call_site", issue.alias("issue"))
