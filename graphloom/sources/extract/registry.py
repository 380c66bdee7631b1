"""Extraction of a table of files: an extractor a language, run in Arrow batches, and the four index tables made of its output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scoring, text
from graphloom.functions.blake3 import content_hash
from graphloom.operators import incremental
from graphloom.sources.extract import documents, python, scanner
from graphloom.sources.extract.model import Result
from graphloom.sources.extract.rules import LANGUAGES

EXTRACTORS: dict[str, Callable[[str], Result]] = {name: (lambda s, n=name: scanner.extract(s, n)) for name in LANGUAGES}
EXTRACTORS |= {"python": python.extract, "markdown": documents.markdown, "sql": documents.sql, "graphql": documents.graphql, "vue": documents.vue, "css": documents.css, "bash": documents.bash}

_SYMBOL = "array<struct<name:string,kind:string,start_line:int,end_line:int,start_col:int,end_col:int,signature:string,docstring:string,parent:string,token_count:int>>"
_REFERENCE = "array<struct<callee:string,kind:string,line:int,caller:string>>"
_IMPORT = "array<struct<module:string,name:string,kind:string>>"
_LITERAL = "array<struct<value:string,line:int,col:int,context:string,parent_fn:string>>"
SCHEMA = f"path string, language string, symbols {_SYMBOL}, refs {_REFERENCE}, imports {_IMPORT}, literals {_LITERAL}, error string"


def register(language: str, extractor: Callable[[str], Result]) -> None:
    """Add or replace the extractor of a language."""
    EXTRACTORS[language] = extractor


def run(source: str, language: str) -> Result:
    """One text; an extractor that fails gives an empty result with the error, as a bad file must not end the job."""
    try:
        return EXTRACTORS[language](source)
    except Exception as e:  # noqa: BLE001
        return Result(error=f"{type(e).__name__}: {e}")


def parsed(files: DataFrame) -> DataFrame:
    """One row a file of a known language: its symbols, references, imports and literals as arrays."""

    def counted(source: str, symbols: list) -> list[dict]:
        """Symbols with the tokens of their lines: the text is cut once, here, where it is at hand."""
        lines = source.split("\n")
        return [vars(s) | {"token_count": text.estimate_tokens("\n".join(lines[s.start_line - 1 : s.end_line]))} for s in symbols]

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = lambda xs: [vars(x) for x in xs]
        for frame in frames:
            out = [(p, lang, t or "", run(t or "", lang)) for p, t, lang in zip(frame.path, frame.text, frame.language, strict=True)]
            yield pd.DataFrame([(p, lang, counted(t, r.symbols), rows(r.references), rows(r.imports), rows(r.literals), r.error) for p, lang, t, r in out], columns=["path", "language", "symbols", "refs", "imports", "literals", "error"])

    known = files.where(F.col("language").isin(*EXTRACTORS)).select("path", "text", "language")
    return known.mapInPandas(batch, SCHEMA)


def tables(parsed_: DataFrame) -> dict[str, DataFrame]:
    """The index tables of parsed files. Ids are hashes of natural keys, so a file that is indexed again keeps its ids."""
    symbols = parsed_.select("path", "language", F.posexplode("symbols").alias("pos", "s")).select(
        F.xxhash64("path", "s.kind", "s.name", "s.start_line", "s.start_col", "pos").alias("id"), F.col("path").alias("file_path"), "s.name", "s.kind", "s.start_line", "s.end_line", "s.start_col", "s.end_col", "s.signature",
        "s.docstring", F.col("s.parent").alias("parent_symbol"), scoring.qualified_name(F.col("path"), F.col("s.parent"), F.col("s.name")).alias("qualified_name"), "language", "s.token_count",
    )
    refs = parsed_.select("path", F.posexplode("refs").alias("pos", "r")).select(
        F.xxhash64("path", "r.caller", "r.callee", "r.kind", "r.line", "pos").alias("id"), F.col("path").alias("caller_file"), F.col("path").alias("callee_file"), F.col("r.caller").alias("caller_symbol"),
        F.col("r.callee").alias("callee_symbol"), F.col("r.kind").alias("ref_kind"), "r.line", scoring.reference_confidence(F.col("r.kind")).alias("confidence"), (scoring.reference_confidence(F.col("r.kind")) < 1).alias("is_dynamic"),
    )
    imports = parsed_.select(F.col("path").alias("importer"), F.explode("imports").alias("i")).select("importer", F.col("i.module").alias("module_name"), F.col("i.name").alias("imported_name"), F.col("i.kind").alias("import_kind")).distinct()
    literals = parsed_.select("path", F.posexplode("literals").alias("pos", "l")).select(
        F.xxhash64("path", "l.value", "l.line", "l.col", "pos").alias("id"), F.col("path").alias("file_path"), F.col("l.line").alias("line_number"), F.col("l.col").alias("col_start"), F.col("l.value").alias("string_value"),
        scoring.is_symbol_like(F.col("l.value")).alias("is_symbol_like"), "l.context", "l.parent_fn",
    )
    return {"symbols": symbols, "refs": refs, "imports": imports, "literals": literals}


def index(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of a scan (path, text, language), references unique by their key."""
    from graphloom.operators.relational import deduplicated
    from graphloom.plans.storage import written

    out = tables(written(parsed(files)))
    return out | {"refs": deduplicated(out["refs"]), "files": files.withColumn("hash", content_hash(F.col("text")))}


def reindex(stored: dict[str, DataFrame], scanned: DataFrame) -> dict[str, DataFrame]:
    """Stored tables brought up to a new scan: only new or changed files are parsed, stale ones are dropped."""
    now = scanned.withColumn("hash", content_hash(F.col("text")))
    changed = incremental.changed_files(stored["files"], now)
    gone = changed.select("path").union(incremental.stale_files(stored["files"], now).select("path"))
    fresh = index(changed.drop("hash"))
    keep = lambda name, column: stored[name].join(gone.select(F.col("path").alias(column)), column, "left_anti").select(*stored[name].columns)
    out = {name: keep(name, column).unionByName(fresh[name].select(*stored[name].columns)) for name, column in (("symbols", "file_path"), ("refs", "caller_file"), ("imports", "importer"), ("literals", "file_path"))}
    return out | {"files": now}


def changes(stored: dict[str, DataFrame], now: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(paths, fresh): the files that are new, changed or gone, and the index rows of the first two, for ``store.update``. ``now`` is the scan; with
    ``asked`` (path) it holds these paths alone, and others are left as they are."""
    from graphloom.plans.storage import written

    known = stored["files"].select("path", "hash")
    known = known.join(asked.select("path").distinct(), "path", "left_semi") if asked is not None else known
    changed = written(incremental.changed_files(known, now.withColumn("hash", content_hash(F.col("text")))))
    gone = known.select("path").join(now.select("path"), "path", "left_anti")
    fresh = index(changed.drop("hash")) | {"files": changed}
    fresh["checksums"] = changed.select("path", "hash", F.lit(0).alias("verify_count"), F.lit(0).alias("mismatch_count"), F.lit("synced").alias("status"))
    return written(changed.select("path").union(gone)), fresh


def register_udtf(spark: SparkSession) -> None:
    """SQL: SELECT * FROM extract_symbols(text, language)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="name string, kind string, start_line int, end_line int, signature string, parent string")
    class ExtractSymbols:
        def eval(self, source: str, language: str):
            if source is not None and language in EXTRACTORS:
                for s in run(source, language).symbols:
                    yield s.name, s.kind, s.start_line, s.end_line, s.signature, s.parent

    spark.udtf.register("extract_symbols", ExtractSymbols)
