"""What deep impact and string matches leave out of their shuffles."""

from pyspark.sql import functions as F

from graphloom.operators import graph, matching


def test_readings_are_not_shuffled_to_drop_repeats(spark):
    literals = spark.createDataFrame([(1, "a.b.b", "kwarg"), (2, "Ring", None), (3, "b.a", "x")], "id long, string_value string, context string")
    symbols = spark.createDataFrame([(10, "b", "a.b"), (11, "Ring", "Ring"), (12, "a", "b.a")], "id long, name string, qualified_name string")
    found = matching.string_matches(literals, symbols)
    got = {(r.literal_id, r.symbol_id, round(r.confidence, 4)) for r in found.collect()}
    assert got == {(1, 10, 0.85), (1, 12, 0.55), (2, 11, 1.0), (3, 12, 1.0), (3, 10, 0.5)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_edges_of_all_layers_are_written_once_and_distinct(spark, monkeypatch):
    kept, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: kept.append((df.columns, df.count())) or written(df))
    symbols = spark.createDataFrame([(i, f"n{i % 4}", f"src/{'test_' if i == 7 else ''}f.py", f"m.n{i % 4}") for i in range(12)], "id long, name string, file_path string, qualified_name string")
    refs = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(3)] * 50, "callee_symbol string, caller_symbol string")
    for cap in (None, 2):
        kept.clear()
        got = sorted((r.depth, r.name, list(r.pos)) for r in graph.impact_layers(symbols, refs, "n0", 3, cap=cap).collect())
        assert got == [(1, "n1", [1]), (2, "n2", [1, 2]), (3, "n3", [1, 2, 3])]
        assert kept[0] == (["callee_symbol", "caller_symbol"], 3)


def _hot():
    """A name of many symbols and literals, names that are null, and a literal that meets by both names."""
    literals = [(i, ("m.hot", "x.hot.y", "hot.b", "Hot")[i % 4], (None, "kwarg", "function_arg")[i % 3], f"f{i % 5}") for i in range(60)]
    symbols = [(100 + i, "hot", ("m.hot", None, "hot")[i % 3]) for i in range(40)] + [(200, None, "m.hot"), (201, "Hot", "Hot"), (202, "b", "hot.b"), (203, "y", None), (204, "m.hot", "hot")]
    return literals, symbols


def _frames(spark):
    literals, symbols = _hot()
    return spark.createDataFrame(literals, "id long, string_value string, context string, file_path string"), spark.createDataFrame(symbols, "id long, name string, qualified_name string")


def _confidence(value, name, full, context):
    parts = value.split(".")
    base = 1.0 if value in (name, full) else 0.8 if parts[-1] == name else 0.7 if parts[-1] == full else 0.5 if name in parts else 0
    return min(1.0, base + {"function_arg": 0.1, "kwarg": 0.05}.get(context, 0)) if base else 0


def test_matched_pairs_are_not_shuffled_and_a_hot_name_is_dealt(spark, monkeypatch):
    for name, value in (("BLOCK", 10), ("PAIRS", 100)):
        monkeypatch.setattr(matching, name, value)
    found = matching.string_matches(*_frames(spark))
    literals, symbols = _hot()
    want = {(i, s): round(c, 4) for i, v, context, _ in literals for s, n, q in symbols if (c := _confidence(v, n, q, context))}
    rows = found.withColumn("p", F.spark_partition_id()).collect()
    assert len(rows) == len(want) and {(r.literal_id, r.symbol_id): round(r.confidence, 4) for r in rows} == want
    assert len({r.p for r in rows}) > 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_a_search_makes_no_pairs_of_equal_texts(spark, monkeypatch):
    literals, symbols = _frames(spark)
    for pattern, limit in (("hot", 7), ("hot", 500), ("m.h", 50), ("Y", 9), ("none", 5)):
        of = []
        monkeypatch.setattr(matching, "_string_pairs", lambda a, b, was=matching._string_pairs, of=of: of.append((a.count(), b.count())) or was(a, b))
        got = [(r.literal_id, r.symbol_id, round(r.confidence, 4)) for r in matching.string_search_top(literals, symbols, pattern, limit).collect()]
        monkeypatch.undo()
        assert of == [(12, 8)]
        every = matching.string_search(matching.string_matches(literals, symbols), literals, symbols, pattern, limit)
        assert got == [(r.literal_id, r.symbol_id, round(r.confidence, 4)) for r in every.collect()]
