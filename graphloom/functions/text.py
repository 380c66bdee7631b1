"""Token estimates and line-level reduction of source text. All but the token estimate are column expressions."""

from __future__ import annotations

import functools
import math
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters a token.
CODE, COMMENT, BLANK = 3.5, 4.0, 20.0
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
_TURN = re.compile(r"[\"']|//|/\*")


def estimate_tokens(source: str) -> int:
    """Tokens of a text, from its characters of code, comment and white space; it leaps from one turn of state to the next."""
    code = comment = blank = at = 0
    n = len(source)
    while at < n:
        turn = _TURN.search(source, at)
        stop = turn.start() if turn else n
        solid = len(_BLANKS.sub("", source[at:stop]))
        code, blank = code + solid, blank + stop - at - solid
        if not turn:
            break
        mark = turn.group()
        if mark == "//":  # the second slash counts as comment again
            end = source.find("\n", stop + 1)
            code += 2
            comment += (end if end >= 0 else n) - stop - 1
            blank += end >= 0
            at = end + 1 if end >= 0 else n
        elif mark == "/*":  # so does the star; the slash that closes is read again as code
            end = source.find("*/", stop + 1)
            code += 2 if end < 0 else 4
            comment += (end if end >= 0 else n) - stop - 1
            at = end + 1 if end >= 0 else n
        else:  # a string, to the next such quote; a backslash counts twice and escapes nothing
            end = source.find(mark, stop + 1)
            inner = source[stop + 1 : end if end >= 0 else n]
            code += 1 + len(inner) + inner.count("\\") + (end >= 0)
            at = end + 1 if end >= 0 else n
    return math.ceil(code / CODE) + math.ceil(comment / COMMENT) + math.ceil(blank / BLANK)


@F.pandas_udf(T.IntegerType())
def token_count(text: pd.Series) -> pd.Series:
    """Arrow-batched token estimate; null counts 0."""
    return text.map(lambda t: estimate_tokens(t) if t else 0).astype("int32")


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after the last end."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def body(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, from 1, inclusive, joined; null beyond the text."""
    held = lines(text)
    return F.when((start >= 1) & (start <= F.size(held)), F.array_join(F.slice(held, start, F.greatest(F.least(end, F.size(held)) - start + 1, F.lit(0))), "\n"))


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _starts(*words: str) -> str:
    return "^(?:" + "|".join(re.escape(w) for w in words) + ")"


def _holds(*words: str) -> str:
    return "|".join(re.escape(w) for w in words)


# How a line of each sort begins, or what it holds.
CONDITIONAL = _starts("if ", "if(", "elif ", "elif(", "else if ", "else if(", "else ", "match ", "switch ", "case ") + "|^else:?$"
LOOP = _starts("for ", "for(", "while ", "while(", "loop ", "foreach ", "do ")
ERROR = _starts("try ", "try{", "catch ", "catch(", "except ", "except(", "finally", "raise ", "panic!", "throw ", "err.") + "|" + _holds(".unwrap()", ".expect(", ".unwrap_or(", ".unwrap_or_else(")
SIDE_EFFECT = (
    # databases
    ".insert(", ".update(", ".delete(", ".save(", ".execute(", ".query(", ".commit(", ".rollback(", "db.", "DB.", ".add(",
    # network
    "http", "fetch(", "axios", "requests.", "reqwest", "HttpClient",
    # files
    "File::", "fs::", "open(", "read_to_string", "write_all", ".read(", ".write(",
    # logs
    "log.", "println!", "print(", "eprint", "console.log", "console.error", "console.warn", "tracing::", "info!", "debug!", "warn!", "error!", "trace!",
    # state
    ".push(", ".extend(", ".remove(", ".clear()", ".sort(", "mut ",
    # processes
    "std::process", "subprocess", "Command::", "spawn", "fork",
    # locks
    ".lock()", ".unwrap().lock", "Atomic", "Mutex", "RwLock",
)
ASSIGNMENT = _starts("let ", "const ", "var ") + "|:="
NO_ASSIGNMENT = _starts("if ", "for ", "while ", "def ", "class ", "fn ", "pub ", "//", "#", "return ", "}")
RETURN = _starts("return ", "return{", "yield ") + "|^return$"
NO_SIGNATURE = _starts("//", "#", "/*", "*", "'''", '"""', "@")
NOT_CODE = _starts("//", "#")


def trimmed_lines(text: Column) -> Column:
    return F.transform(lines(text), trimmed)


def extract_signature(text: Column) -> Column:
    """The first line that is no blank, comment, docstring or decorator; else the first line."""
    return _signature(trimmed_lines(text))


def _signature(held: Column) -> Column:
    found = F.filter(held, lambda x: (x != "") & ~x.rlike(NO_SIGNATURE))
    return F.coalesce(F.get(found, F.lit(0)), F.get(held, F.lit(0)), F.lit(""))


def is_match_arm(line: Column) -> Column:
    return (F.contains(line, F.lit(" =>")) & ~line.rlike(_starts("fn ", "let "))) | (F.startswith(line, F.lit("case ")) & F.endswith(line, F.lit(":")))


def simplify_line(line: Column) -> Column:
    """Without outer braces, final ; and , and repeated blanks."""
    bare = trimmed(F.regexp_replace(trimmed(line), r"^\{+|\}+$", ""))
    return F.regexp_replace(trimmed(F.regexp_replace(F.regexp_replace(bare, r";+$", ""), r",+$", "")), r"\s+", " ")


#: A line that opens and closes a block comment, or closes and opens one, counts as a close; then blocks fall away.
BOTH = r"(?m)^[^\n]*(?:/\*[^\n]*\*/|\*/[^\n]*/\*|/\*/)[^\n]*$"
BLOCK = r"(?m)^[^\n]*/\*(?:[^*]|\*+[^*/])*(?:\*+/[^\n]*$|\**\z)"


def extract_critical_branches(text: Column) -> Column:
    """Conditions, loops, error handling and match arms outside comments, simplified, in order."""
    return _branches(text, trimmed_lines(text))


def _branches(text: Column, held: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, BOTH, "*/"), BLOCK, "")
    marked = F.contains(text, F.lit("/*")) | F.contains(text, F.lit("*/"))  # without a mark both patterns match nothing
    held = F.filter(F.when(marked, trimmed_lines(bare)).otherwise(held), lambda x: (x != "") & ~F.contains(x, F.lit("*/")) & ~x.rlike(NOT_CODE))
    return F.transform(F.filter(held, lambda x: x.rlike(f"{CONDITIONAL}|{LOOP}|{ERROR}") | is_match_arm(x)), simplify_line)


def _code(held: Column) -> Column:
    return F.filter(held, lambda x: (x != "") & ~x.rlike(NOT_CODE))


def extract_side_effects(text: Column) -> Column:
    return _effects(_code(trimmed_lines(text)))


def _effects(code: Column) -> Column:
    holds = lambda x: functools.reduce(operator.or_, (F.contains(x, F.lit(w)) for w in SIDE_EFFECT))  # half the time of one pattern of all words
    return F.transform(F.filter(code, holds), simplify_line)


def extract_key_assignments(text: Column) -> Column:
    return _assignments(_code(trimmed_lines(text)))


def _assignments(code: Column) -> Column:
    plain = lambda x: F.contains(x, F.lit("=")) & ~x.rlike(NO_ASSIGNMENT)
    return F.transform(F.filter(code, lambda x: x.rlike(ASSIGNMENT) | plain(x)), simplify_line)


def extract_return_statement(text: Column) -> Column:
    """The last return or yield line, or null."""
    return _returned(trimmed_lines(text))


def _returned(held: Column) -> Column:
    return simplify_line(F.try_element_at(F.filter(held, lambda x: x.rlike(RETURN)), F.lit(-1)))


def critical_text(signature: Column, branches: Column, effects: Column, assignments: Column, returned: Column) -> Column:
    """The reduced symbol as text; its tokens are those of the critical level."""
    part = lambda label, rows: F.when(F.size(rows) > 0, F.concat_ws("\n", F.lit(label), F.transform(rows, lambda x: F.concat(F.lit("  - "), x))))
    return F.concat_ws("\n", signature, part("critical_branches:", branches), part("side_effects:", effects), part("key_assignments:", assignments), F.when(returned.isNotNull(), F.concat(F.lit("return: "), returned)))


def parse_level(text: str) -> tuple[str, int | None]:
    """A compression level's name and budget."""
    low = text.lower()
    for name, others in {"signature_only": ("signatureonly", "sig", "s"), "critical_branches": ("criticalbranches", "crit", "c"), "full_body": ("fullbody", "full", "f")}.items():
        if low == name or low in others:
            return name, None
    inner = re.fullmatch(r"(?:(?:token_budgeted|budget)\()?(\d+)\)?", low)
    if inner:
        return "token_budgeted", int(inner[1])
    raise ValueError(f"invalid compression level {text!r}; use signature_only, critical_branches, full_body, token_budgeted(N) or a number")


def compress(df, text: Column, start: Column, end: Column, level: str):
    """Add ``compressed``: the symbol in lines ``start`` to ``end``, reduced to the level or to what fits its budget."""
    name, budget = parse_level(level)
    b = F.col("__body")
    df = df.withColumn("__body", body(text, start, end))
    held, code = F.col("__lines"), F.col("__code")  # columns of their own, so that a text is split and trimmed once for all its parts
    df = df.withColumn("__lines", trimmed_lines(b)).withColumn("__code", _code(held))
    df = df.withColumns({"__signature": _signature(held), "__branches": _branches(b, held), "__effects": _effects(code), "__assignments": _assignments(code), "__return": _returned(held)})
    parts = [F.col(f"__{c}") for c in ("signature", "branches", "effects", "assignments", "return")]
    df = df.withColumns({"__full": token_count(b), "__critical": token_count(critical_text(*parts)), "__short": token_count(parts[0])})
    fits = lambda c: F.col(c) <= budget
    used = F.lit(name) if budget is None else F.when(fits("__full"), "full_body").when(fits("__critical"), "critical_branches").otherwise("signature_only")
    used = F.when(b.isNull(), "empty").otherwise(used)
    critical = used == "critical_branches"
    some = lambda c: F.when(critical & (F.size(c) > 0), c)
    tokens = F.when(used == "full_body", F.col("__full")).when(critical, F.col("__critical")).when(used == "signature_only", F.col("__short")).otherwise(0)
    made = F.struct(
        F.when(b.isNull(), "").otherwise(parts[0]).alias("signature"), some(parts[1]).alias("critical_branches"), some(parts[2]).alias("side_effects"),
        some(parts[3]).alias("key_assignments"), F.when(critical, parts[4]).alias("return_statement"), F.when(used == "full_body", b).alias("full_body"),
        tokens.alias("estimated_tokens"), used.alias("compression_used"),
    )
    return df.withColumn("compressed", made).drop(*(c for c in df.columns if c.startswith("__")))
