"""Name similarity, search scores and signatures, as column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the combined score: fuzzy match, rank, kind.
FUZZY, RANK, KIND = 0.5, 0.3, 0.2


def levenshtein_distance(a: Column, b: Column) -> Column:
    """Edit distance over characters."""
    return F.levenshtein(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer byte length; 1 for two empty strings."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def split_identifier(name: Column) -> Column:
    """Lower-cased tokens, cut at ``_`` and ``-`` and before each upper-case letter."""
    cut = F.split(F.regexp_replace(name, r"(\p{Lu})", "_$1"), "[_-]")
    return F.transform(F.filter(cut, lambda t: t != ""), F.lower)


def fuzzy_score(query: Column, name: Column) -> Column:
    """0 to 1: equal, contained, shared tokens of the query, or edit similarity (halved for queries of two bytes or fewer)."""
    q, s = F.lower(query), F.lower(name)
    wanted, held = split_identifier(q), split_identifier(s)
    matched = F.size(F.filter(wanted, lambda t: F.array_contains(held, t)))
    similar = levenshtein_similarity(q, s)
    return (
        F.when(q == s, 1.0)
        .when(F.contains(s, q), 0.9 + 0.1 * F.octet_length(q) / F.octet_length(s))
        .when((F.size(wanted) > 0) & (matched > 0), 0.9 * matched / F.size(wanted))
        .when(F.octet_length(q) <= 2, similar * 0.5)
        .otherwise(similar)
    )


def combined_score(fuzzy: Column, kind_matches: Column, rank: Column, weights: tuple[float, float, float] = (FUZZY, RANK, KIND)) -> Column:
    """Weighted sum of the fuzzy score, the rank (null: 0) and the kind bonus."""
    return F.lit(weights[0]) * fuzzy + F.lit(weights[2]) * F.when(kind_matches, 1.0).otherwise(0.0) + F.lit(weights[1]) * F.coalesce(rank, F.lit(0.0))


def _params(signature: Column) -> Column:
    """The text between the first ( and the last ), or null."""
    return F.when(signature.rlike(r"(?s)\(.*\)"), F.regexp_extract(signature, r"(?s)\((.*)\)", 1))


def count_params(signature: Column) -> Column:
    inner = F.coalesce(_params(signature), F.lit(""))
    return F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(inner, ",")))


def count_required_params(signature: Column) -> Column:
    """Parameters without a default or an optional type."""
    inner = F.coalesce(_params(signature), F.lit(""))
    optional = lambda p: F.contains(p, F.lit("=")) | F.contains(p, F.lit(": Optional")) | F.contains(p, F.lit(": Option<"))
    return F.when(F.trim(inner) == "", 0).otherwise(F.size(F.filter(F.split(inner, ","), lambda p: ~optional(p))))


def return_type(signature: Column) -> Column:
    """What follows the first arrow, trimmed; empty without one."""
    return F.trim(F.when(F.contains(signature, F.lit("->")), F.regexp_extract(signature, r"(?s)->(.*)", 1)).otherwise(F.regexp_extract(signature, r"(?s)→(.*)", 1)))


def return_type_changed(old: Column, new: Column) -> Column:
    a, b = return_type(old), return_type(new)
    return (a != b) & ~((a == "") & (b == ""))


def reference_confidence(kind: Column) -> Column:
    """How sure a reference of a kind is."""
    return F.when(kind.isin("call", "import", "inherit", "export", "use", "require", "include"), 1.0).when(kind.isin("dynamic_dispatch", "virtual_call"), 0.7).when(kind == "string_ref", 0.3).otherwise(0.5)


def is_dynamic_kind(kind: Column) -> Column:
    return kind.isin("dynamic_dispatch", "virtual_call", "string_ref")


def qualified_name(path: Column, parent: Column, name: Column) -> Column:
    """Dotted module of the path (without ``src``, ``lib`` and ``__init__``; ``root`` if nothing is left), the parent if any, the name."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    module = F.array_join(F.filter(parts, lambda x: ~x.isin("", ".", "src", "lib", "__init__")), ".")
    return F.concat_ws(".", F.when(module == "", "root").otherwise(module), F.when(parent != "", parent), name)


def is_test_path(path: Column) -> Column:
    return F.contains(path, F.lit("test")) | F.contains(path, F.lit("_spec"))


def is_symbol_like(value: Column) -> Column:
    """Dotted identifiers, or one capitalised identifier; no blanks, slashes, dashes, colons, versions."""
    word = r"[\p{L}_][\p{L}\p{N}_]*"
    version = value.rlike(r"^[\dvV].*\.")
    dotted = value.rlike(rf"^{word}(\.{word})+$")
    capital = value.rlike(r"^\p{Lu}[\p{L}\p{N}_]*$")
    return ~value.rlike(r"[ /:-]") & ~version & (dotted | capital) & (value != "")


def is_noise_string(literal: Column) -> Column:
    """Format and byte strings; raw ones are kept."""
    return literal.rlike("^[fFbB]")


def strip_quotes(literal: Column) -> Column:
    triple = F.regexp_extract(literal, r'(?s)^("""|\'\'\')(.*)\1$', 2)
    return F.when(literal.rlike(r'(?s)^("""|\'\'\').*\1$') & (F.length(literal) >= 6), triple).when(literal.rlike(r"""(?s)^(["']).*\1$""") & (F.length(literal) >= 2), literal.substr(F.lit(2), F.length(literal) - 2)).otherwise(literal)


# Kinds that may stand for each other across languages.
TYPES, CALLABLES = ("class", "interface", "struct", "type"), ("function", "method", "fn")


def kinds_compatible(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return (a.isin(*TYPES) & b.isin(*TYPES)) | (a.isin(*CALLABLES) & b.isin(*CALLABLES))


def mixed_case(name: Column) -> Column:
    return name.rlike(r"\p{Lu}") & name.rlike(r"\p{Ll}")


def cross_language_confidence(name: Column, kind_a: Column, kind_b: Column) -> Column:
    total = 0.4 + F.when(kinds_compatible(kind_a, kind_b), 0.3).otherwise(0.0) + F.when(mixed_case(name), 0.1).otherwise(0.0)
    return F.least(F.lit(0.9), F.greatest(F.lit(0.1), total))


def match_reasons(name: Column, kind_a: Column, kind_b: Column) -> Column:
    compatible = F.when(kinds_compatible(kind_a, kind_b), F.concat(F.lit("kind_compatible("), kind_a, F.lit("↔"), kind_b, F.lit(")")))
    return F.array_compact(F.array(F.lit("exact_name"), compatible, F.when(mixed_case(name), F.lit("camelcase_name"))))


def match_type(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "exact").when(confidence >= 0.5, "partial").otherwise("fuzzy")


#: Added to the confidence of a string reference by where the literal stands.
CONTEXT_BONUS = {"function_arg": 0.1, "kwarg": 0.05, "sequence_element": 0.05}

# Characters a token by language.
DENSITY = {"python": 3.8, "javascript": 3.4, "typescript": 3.4, "rust": 3.2, "go": 3.5, "java": 3.3, "ruby": 3.6, "c": 3.1, "cpp": 3.1}


def density_tokens(text: Column, language: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in DENSITY.items() for x in pair))
    return F.ceil(F.length(text) / F.coalesce(F.try_element_at(table, language), F.lit(3.5))).cast("int")


# Error codes, their numbers and what to do.
ERRORS = {
    "StaleIndex": (-32001, "Auto-retry 2x, then use filesystem fallback"),
    "SymbolNotFound": (-32002, "Try search() with similar names, then filesystem fallback"),
    "ParserError": (-32003, "Report to user, mark file as corrupted"),
    "TokenBudgetExceeded": (-32004, "Request higher compression level or increase budget"),
    "RefIntegrityViolation": (-32005, "Block edit, show impact analysis to user"),
    "CircularDependency": (-32006, "Warn user, truncate graph at cycle point"),
    "CrossLanguageGap": (-32007, "Return raw string reference with warning"),
    "DatabaseError": (-32008, "Check the index tables, retry the write"),
    "IoError": (-32009, "Check file permissions and disk space"),
    "ConfigError": (-32010, "Validate config file syntax and required fields"),
    "IndexNotInitialized": (-32011, "Build the index of the project first"),
}
# Substrings that tell an error's class, in order.
ERROR_WORDS = (
    ("DatabaseError", ("database", "sqlite", "SQL")),
    ("StaleIndex", ("hash mismatch", "stale")),
    ("ParserError", ("parse", "unparseable")),
    ("TokenBudgetExceeded", ("budget", "token limit")),
    ("SymbolNotFound", ("no such symbol", "not found")),
    ("IoError", ("io", "file", "permission")),
)


def classify_error(message: Column) -> Column:
    out = None
    for code, words in ERROR_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(message, F.lit(w))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("DatabaseError")


def error_number(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for name, (number, _) in ERRORS.items() for x in (name, number)))
    return F.try_element_at(table, code)
