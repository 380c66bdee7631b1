"""Output formats of answers: JSON, tabular text, DOT."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_json(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


def _scalar(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    text = str(v)
    plain = text and text == text.strip() and not re.search(r'[,:"\\\n\r\t\[\]{}]', text) and not re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|-.*", text)
    return text if plain else json.dumps(text, ensure_ascii=False)


def to_toon(value, indent: int = 0) -> str:
    """Token-oriented text: ``key: value`` lines; lists of uniform flat objects become a header and one row each."""
    pad = "  " * indent
    if isinstance(value, dict):
        return "\n".join(_entry(_scalar(k), v, indent) for k, v in value.items())
    if isinstance(value, list):
        return _entry("", value, indent)
    return pad + _scalar(value)


def _entry(key: str, v, indent: int) -> str:
    pad = "  " * indent
    flat = lambda x: not isinstance(x, (dict, list))
    if isinstance(v, dict):
        return f"{pad}{key}:" + ("\n" + to_toon(v, indent + 1) if v else "")
    if not isinstance(v, list):
        return f"{pad}{key}: {_scalar(v)}"
    head = f"{pad}{key}[{len(v)}]"
    if all(map(flat, v)):
        return f"{head}: {','.join(map(_scalar, v))}".rstrip()
    if all(isinstance(x, dict) and x and x.keys() == v[0].keys() and all(map(flat, x.values())) for x in v):
        rows = "".join(f"\n{pad}  {','.join(_scalar(x[k]) for k in v[0])}" for x in v)
        return f"{head}{{{','.join(map(_scalar, v[0]))}}}:{rows}"
    return f"{head}:" + "".join(f"\n{pad}  - {to_toon(x, indent + 2).strip()}" for x in v)


def dot_escape(name: Column) -> Column:
    return F.replace(F.replace(F.replace(name, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit(" "), F.lit("_"))


_HEAD = "digraph code {\n  rankdir=LR;\n  node [shape=box, style=filled, fillcolor=lightblue];\n\n"


def ego_dot(neighbors: DataFrame, symbol: str) -> DataFrame:
    """One row ``dot``: the symbol, its callers and callees, and edges coloured by kind. ``neighbors`` is limited, hence small."""
    caller, callee = F.coalesce("caller_symbol", F.lit("?")), F.col("callee_symbol")
    node = lambda c: F.when(c != symbol, F.concat(F.lit('  "'), dot_escape(c), F.lit('" [label="'), c, F.lit('"];\n'))).otherwise("")
    style = F.when(F.col("ref_kind") == "call", "color=green").when(F.col("ref_kind") == "import", "color=blue").when(F.col("ref_kind") == "inherit", "color=red, style=dashed").otherwise("color=gray")
    edge = F.concat(F.lit('  "'), dot_escape(caller), F.lit('" -> "'), dot_escape(callee), F.lit('" [label="'), F.col("ref_kind"), F.lit('", '), style, F.lit("];\n"))
    rows = neighbors.select(F.struct("ref_kind", "line", "id", F.concat(node(caller), node(callee)).alias("n"), edge.alias("e")).alias("r"))
    listed = rows.agg(F.array_sort(F.collect_list("r")).alias("r"))
    target = F.concat(F.lit('  "'), dot_escape(F.lit(symbol)), F.lit(f'" [fillcolor=gold, label="{symbol}\\n(target)"];\n'))
    return listed.select(F.concat(F.lit(_HEAD), target, F.array_join(F.col("r.n"), ""), F.lit("\n  // Edges\n"), F.array_join(F.col("r.e"), ""), F.lit("}\n")).alias("dot"))


def full_dot(symbols: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows (part, line): the lines of the whole graph's text, one a symbol, so that it is written without being gathered."""
    label = F.concat(F.col("name"), F.lit("\\n["), F.col("kind"), F.lit("] L"), F.col("start_line"))
    nodes = symbols.select(F.lit(1).alias("part"), F.col("file_path").alias("k1"), F.col("start_line").alias("k2"), F.concat(F.lit('  "'), dot_escape(F.col("file_path")), F.lit("::"), dot_escape(F.col("name")), F.lit('" [label="'), label, F.lit('"];')).alias("line"))
    head = stats.select(F.lit(0).alias("part"), F.lit("").alias("k1"), F.lit(0).alias("k2"), F.concat(F.lit(_HEAD + '  "project" [shape=ellipse, label="Project\\n'), F.col("files"), F.lit(" files, "), F.col("symbols"), F.lit(" symbols, "), F.col("refs"), F.lit(' refs", fillcolor=lightyellow];')).alias("line"))
    tail = stats.select(F.lit(2).alias("part"), F.lit("").alias("k1"), F.lit(0).alias("k2"), F.lit("}").alias("line"))
    return head.union(nodes).union(tail).orderBy("part", "k1", "k2").select("part", "line")
