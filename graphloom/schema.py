"""Schemas of the index tables."""

from pyspark.sql import types as T


def _table(*fields: str) -> T.StructType:
    """Fields as "name type", nullable where a question mark ends them."""
    kinds = {"long": T.LongType, "int": T.IntegerType, "string": T.StringType, "double": T.DoubleType, "bool": T.BooleanType, "timestamp": T.TimestampType}
    out = T.StructType()
    for f in fields:
        name, kind = f.rstrip("?").split()
        out.add(name, kinds[kind](), f.endswith("?"))
    return out


FILES = _table("path string", "text string?", "language string?", "hash string?", "size long?")
SYMBOLS = _table(
    "id long", "file_path string", "name string", "kind string", "start_line int", "end_line int", "start_col int", "end_col int", "signature string?",
    "docstring string?", "parent_symbol string?", "qualified_name string?", "token_count int?", "language string?",
)
REFERENCES = _table("id long", "caller_file string", "callee_file string", "caller_symbol string?", "callee_symbol string", "ref_kind string", "line int", "confidence double", "is_dynamic bool")
IMPORTS = _table("importer string", "module_name string", "imported_name string?", "import_kind string")
LITERALS = _table("id long", "file_path string", "line_number int", "col_start int", "string_value string", "is_symbol_like bool", "context string?", "parent_fn string?")
RANKS = _table("symbol_name string", "page_rank double", "in_degree long", "out_degree long")
CHECKSUMS = _table("path string", "hash string", "verify_count long", "mismatch_count long", "status string")
DIRTY = _table("path string", "reason string", "priority int", "enqueued_at timestamp", "status string")
OVERRIDES = _table("id long", "caller_symbol string", "callee_symbol string", "ref_kind string", "confidence double", "reason string?")
STRING_REFS = _table("literal_id long", "symbol_id long", "confidence double", "match_type string")
EVENTS = _table("path string", "ts timestamp", "event_type string")
JOURNAL = _table("seq long", "timestamp long", "file_path string", "op string", "status string", "file_hash string?")
SCHEMA_VERSION = 5

#: Symbol kinds that an extractor may give.
SYMBOL_KINDS = (
    "function", "class", "method", "variable", "import", "export", "decorator", "parameter", "module", "interface", "enum", "struct", "field",
    "type_alias", "section", "code_block", "link", "constant", "trait",
)
