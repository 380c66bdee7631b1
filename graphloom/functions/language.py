"""Languages by file extension, in the three variants that the engine's surfaces use, and names of target files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language.
CANONICAL = {
    "python": "py",
    "javascript": "js jsx mjs cjs",
    "rust": "rs",
    "typescript": "ts tsx mts cts",
    "go": "go",
    "ruby": "rb gemspec",
    "java": "java",
    "php": "php",
    "julia": "jl",
    "lua": "lua",
    "swift": "swift",
    "zig": "zig",
    "scala": "scala",
    "elixir": "ex exs",
    "dart": "dart",
    "haskell": "hs lhs",
    "c": "c h",
    "cpp": "cpp hpp cc cxx hxx hh",
    "markdown": "md markdown mdown mkd",
    "sql": "sql",
    "graphql": "graphql gql",
    "vue": "vue",
    "css": "css scss sass",
    "bash": "sh bash zsh",
    "kotlin": "kt kts",
    "csharp": "cs",
}
# The stored-file variant knows fewer extensions and takes h for C++.
STORED = {
    "python": "py", "javascript": "js", "typescript": "ts tsx", "rust": "rs", "go": "go", "ruby": "rb", "java": "java", "php": "php", "julia": "jl",
    "lua": "lua", "swift": "swift", "zig": "zig", "scala": "scala", "elixir": "ex exs", "dart": "dart", "haskell": "hs", "c": "c",
    "cpp": "cpp cc cxx h hpp hxx hh", "markdown": "md",
}
# The cross-language variant.
CROSS = {
    "python": "py pyi", "javascript": "js mjs", "typescript": "ts tsx mts", "rust": "rs", "go": "go", "ruby": "rb", "java": "java", "c": "c h",
    "cpp": "cpp cc cxx hpp hxx", "csharp": "cs", "php": "php", "swift": "swift", "kotlin": "kt kts", "scala": "scala", "lua": "lua", "r": "r R",
    "julia": "jl", "elixir": "ex exs", "erlang": "erl hrl", "haskell": "hs", "dart": "dart", "zig": "zig", "markdown": "md markdown",
}
VARIANTS = {"canonical": CANONICAL, "stored": STORED, "cross": CROSS}
# Language names that the command line takes besides those of the extensions above.
ALIASES = {"c++": "cpp", "cc": "cpp", "cxx": "cpp", "cpp": "cpp", "py": "python", "js": "javascript", "ts": "typescript", "rs": "rust", "rb": "ruby", "jl": "julia", "ex": "elixir", "exs": "elixir", "hs": "haskell", "md": "markdown"}
NAMED = "python javascript typescript rust go ruby java php julia lua swift zig scala elixir dart haskell c cpp markdown".split()

#: Directories that a scan leaves out.
SKIPPED = (".git", "__pycache__", ".venv", "venv", "node_modules", ".mypy_cache", ".tox", ".eggs", "dist", "build", ".next", ".nuxt")
#: Those that the watcher leaves out.
WATCH_SKIPPED = (*SKIPPED, "target", ".DS_Store", "out")


def extensions(variant: str = "canonical") -> list[tuple[str, str]]:
    """(extension, language) pairs."""
    return [(e, lang) for lang, es in VARIANTS[variant].items() for e in es.split()]


def of_extension(path: str, variant: str = "canonical") -> str | None:
    """Language of one path, on the driver."""
    return dict(extensions(variant)).get(path.rsplit(".", 1)[-1])


def language_of(path: Column, variant: str = "canonical") -> Column:
    """Language of a path by its last extension; null (``unknown`` in the cross-language variant) if none is known.

    The canonical variant takes a name without a dot for an extension; the others want a dot inside the name."""
    name = F.element_at(F.split(path, "/"), -1)
    last = F.element_at(F.split(path if variant == "canonical" else name, "\\."), -1)
    table = F.create_map(*(F.lit(x) for pair in extensions(variant) for x in pair))
    found = F.try_element_at(table, last)
    if variant != "canonical":
        found = F.when(name.rlike(r"[^.].*\."), found)
    return F.coalesce(found, F.lit("unknown")) if variant == "cross" else found


def parse_language(name: str) -> str | None:
    """The language of a command-line name; None for ``auto``."""
    low = name.lower()
    if low == "auto":
        return None
    if low in NAMED or low in ALIASES:
        return ALIASES.get(low, low)
    raise ValueError(f"unsupported language {name!r}; known: auto, {', '.join(NAMED)}")


def ignored(path: Column, extra: tuple[str, ...] = (), names: tuple[str, ...] = WATCH_SKIPPED) -> Column:
    """True if a component of the path is an ignored directory."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(n) for n in (*names, *extra))))


def target_path(module: Column, language: Column) -> Column:
    """Where a symbol moved to ``module`` (dotted) lives, by the language's conventions."""
    slashed = F.translate(module, ".", "/")
    named = F.concat(slashed, F.lit("/"), F.element_at(F.split(module, "\\."), -1), F.lit("."))
    ext = F.create_map(*(F.lit(x) for lang in NAMED for x in (lang, CANONICAL[lang].split()[0])))
    return (
        F.when(language == "rust", F.concat(F.lit("src/"), slashed, F.lit("/mod.rs")))
        .when(language == "c", F.concat(F.lit("include/"), slashed, F.lit(".h")))
        .when(language == "cpp", F.concat(F.lit("src/"), named, F.lit("cpp")))
        .otherwise(F.concat(named, F.coalesce(F.try_element_at(ext, language), F.lit("py"))))
    )
