"""Scalar functions: names, scores, signatures, tokens, line reduction, hashes, budgets, languages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import budget, language, scoring, text
from graphloom.functions.blake3 import blake3_hex, content_hash


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("a", "b", "d", "s"), [("", "", 0, 1.0), ("kitten", "sitting", 3, 1 - 3 / 7), ("abc", "abc", 0, 1.0), ("", "abc", 3, 0.0), ("é", "e", 1, 0.5)])
def test_levenshtein(spark, a, b, d, s):
    assert one(spark, scoring.levenshtein_distance(F.col("a"), F.col("b")), a=a, b=b) == d
    assert one(spark, scoring.levenshtein_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(s)


@pytest.mark.parametrize(("name", "tokens"), [("getUserName", ["get", "user", "name"]), ("XMLParser", ["x", "m", "l", "parser"]), ("snake_case-mix", ["snake", "case", "mix"]), ("", []), ("__a__", ["a"])])
def test_split_identifier(spark, name, tokens):
    assert one(spark, scoring.split_identifier(F.col("n")), n=name) == tokens


@pytest.mark.parametrize(
    ("query", "name", "score"),
    [("login", "Login", 1.0), ("user", "get_user", 0.9 + 0.1 * 4 / 8), ("user_del", "delete_user", 0.45), ("ab", "xyz", 0.0), ("logn", "login", 0.8), ("zz", "zy", 0.25)],
)
def test_fuzzy_score(spark, query, name, score):
    assert one(spark, scoring.fuzzy_score(F.col("q"), F.col("n")), q=query, n=name) == pytest.approx(score)


def test_combined_score(spark):
    score = lambda f, k, r, **w: one(spark, scoring.combined_score(F.col("f"), F.col("k"), F.col("r"), **w), f=f, k=k, r=r)
    assert score(1.0, True, 0.8) == pytest.approx(0.94)
    assert score(0.8, False, 0.0) == pytest.approx(0.40)
    assert score(0.5, True, 1.0, weights=(0.6, 0.2, 0.2)) == pytest.approx(0.70)


@pytest.mark.parametrize(
    ("signature", "n", "required", "returned"),
    [("def f(a, b=1, c: Optional[int])", 3, 1, ""), ("fn f(a: i32, b: Option<u8>) -> Result", 2, 1, "Result"), ("f()", 0, 0, ""), ("f", 0, 0, ""), ("def f( ) -> int", 0, 0, "int"), ("f(x) → str", 1, 1, "str"), ("def f((a, b))", 2, 2, "")],
)
def test_signatures(spark, signature, n, required, returned):
    s = F.col("s")
    assert one(spark, scoring.count_params(s), s=signature) == n
    assert one(spark, scoring.count_required_params(s), s=signature) == required
    assert one(spark, scoring.return_type(s), s=signature) == returned


def test_return_type_changed(spark):
    changed = lambda a, b: one(spark, scoring.return_type_changed(F.col("a"), F.col("b")), a=a, b=b)
    assert changed("f() -> a", "f() -> b") and changed("f()", "f() -> b") and not changed("f()", "g()") and not changed("f() -> a", "g(x) -> a")


@pytest.mark.parametrize(("value", "like"), [("User", True), ("user", False), ("app.models.User", True), ("v1.2", False), ("views.User", False), ("1.2.3", False), ("a b.c", False), ("a/b.c", False), ("a-b", False), ("a:b", False), ("a..b", False), ("", False), ("_x.y", True)])
def test_symbol_like(spark, value, like):
    assert one(spark, scoring.is_symbol_like(F.col("v")), v=value) is like


@pytest.mark.parametrize(("raw", "value"), [('"a"', "a"), ("'a'", "a"), ('"""a\nb"""', "a\nb"), ('r"a"', 'r"a"'), ("''", ""), ("a", "a")])
def test_strip_quotes(spark, raw, value):
    assert one(spark, scoring.strip_quotes(F.col("s")), s=raw) == value


@pytest.mark.parametrize(("path", "parent", "name", "full"), [("src/app/models.py", None, "User", "app.models.User"), ("lib/x/__init__.py", "A", "b", "x.A.b"), ("src/__init__.py", "", "f", "root.f"), ("a.tar.gz", None, "x", "a.tar.x")])
def test_qualified_name(spark, path, parent, name, full):
    assert one(spark, scoring.qualified_name(F.col("p"), F.col("q"), F.col("n")), p=path, q=parent, n=name) == full


def test_cross_language_scores(spark):
    conf = lambda n, a, b: one(spark, scoring.cross_language_confidence(F.col("n"), F.col("a"), F.col("b")), n=n, a=a, b=b)
    assert conf("User", "class", "Interface") == pytest.approx(0.8)
    assert conf("user", "class", "function") == pytest.approx(0.4)
    assert conf("run", "fn", "method") == pytest.approx(0.7)
    assert one(spark, scoring.match_reasons(F.col("n"), F.col("a"), F.col("b")), n="User", a="class", b="struct") == ["exact_name", "kind_compatible(class↔struct)", "camelcase_name"]


def test_errors(spark):
    code = lambda m: one(spark, scoring.classify_error(F.col("m")), m=m)
    assert [code(m) for m in ("sqlite broke", "hash mismatch", "cannot parse", "token limit", "no such symbol", "permission denied", "else")] == ["DatabaseError", "StaleIndex", "ParserError", "TokenBudgetExceeded", "SymbolNotFound", "IoError", "DatabaseError"]
    numbers = [n for n, _ in scoring.ERRORS.values()]
    assert len(set(numbers)) == 11 and min(numbers) == -32011 and max(numbers) == -32001
    assert one(spark, scoring.error_number(F.col("c")), c="ParserError") == -32003


def stepwise(source: str) -> int:
    """The token rules, one character at a time."""
    counts, state, i = {"code": 0, "comment": 0, "blank": 0}, "code", 0
    while i < len(source):
        c, pair = source[i], source[i : i + 2]
        if state == "code":
            if c.isspace():
                counts["blank"] += 1
            elif c in "\"'":
                state = c
                counts["code"] += 1
            elif pair in ("//", "/*"):
                state = pair
                counts["code"] += 2
            else:
                counts["code"] += 1
        elif state == "//":
            if c == "\n":
                state = "code"
                counts["blank"] += 1
            else:
                counts["comment"] += 1
        elif state == "/*":
            if pair == "*/":
                state = "code"
                counts["code"] += 2
            else:
                counts["comment"] += 1
        elif c == "\\":
            counts["code"] += 2
        else:
            counts["code"] += 1
            if c == state:
                state = "code"
        i += 1
    return math.ceil(counts["code"] / 3.5) + math.ceil(counts["comment"] / 4) + math.ceil(counts["blank"] / 20)


def test_token_estimate_matches_the_rules():
    rng = random.Random(5)
    for _ in range(3000):
        source = "".join(rng.choice("ab \n\t\"'\\/*x(") for _ in range(rng.randrange(0, 40)))
        assert text.estimate_tokens(source) == stepwise(source), repr(source)
    assert text.estimate_tokens("") == 0


def test_token_count_column(spark):
    df = spark.createDataFrame([("fn main() { }",), (None,), ("",)], "t string")
    assert [r.x for r in df.select(text.token_count(F.col("t")).alias("x")).collect()] == [text.estimate_tokens("fn main() { }"), 0, 0]


BODY = """@decorator
# a comment
def load(path):
    /* if hidden:
       for hidden */
    if path == "x" {
        db.insert(path);
    }
    for row in rows:
        total = total + row,
    x => y
    while   (true) { }
    value.unwrap()
    print(total)
    // return nothing
    return {total};
"""


def test_line_reduction(spark):
    df = spark.createDataFrame([(BODY,)], "t string")
    t = F.col("t")
    r = df.select(text.extract_signature(t).alias("s"), text.extract_critical_branches(t).alias("b"), text.extract_side_effects(t).alias("e"), text.extract_key_assignments(t).alias("a"), text.extract_return_statement(t).alias("r")).first()
    assert r.s == "def load(path):"
    assert r.b == ['if path == "x" {', "for row in rows:", "x => y", "while (true) {", "value.unwrap()"]
    assert r.e == ["db.insert(path)", "print(total)"]
    assert r.a == ["total = total + row", "x => y"]
    assert r.r == "return {total}"


def test_comment_blocks(spark):
    cases = {"if a:\n/* x\nif b:\n*/ if c:\nif d:": ["if a:", "if d:"], "/* one */ if a:\nif b:": ["if b:"], "if a:\n/* open\nif b:": ["if a:"], "*/ x /*\nif a:": ["if a:"], "/* a\nb */ x /* c\nif d:": ["if d:"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", text.extract_critical_branches(F.col("t")).alias("b")).collect():
        assert r.b == cases[r.t], r.t


@pytest.mark.parametrize(("level", "name", "n"), [("sig", "signature_only", None), ("S", "signature_only", None), ("crit", "critical_branches", None), ("full_body", "full_body", None), ("budget(40)", "token_budgeted", 40), ("token_budgeted(7)", "token_budgeted", 7), ("12", "token_budgeted", 12)])
def test_levels(level, name, n):
    assert text.parse_level(level) == (name, n)


def test_bad_level():
    with pytest.raises(ValueError, match="invalid compression level"):
        text.parse_level("huge")


def test_compress(spark):
    df = spark.createDataFrame([(BODY, 1, 99), (BODY, 3, 3), (BODY, 0, 2), (BODY, 99, 100)], "t string, a int, b int")
    run = lambda level: [r.compressed for r in text.compress(df, F.col("t"), F.col("a"), F.col("b"), level).collect()]
    full = run("full")
    assert full[0].full_body == BODY.rstrip("\n") and full[0].estimated_tokens == text.estimate_tokens(BODY.rstrip("\n"))
    assert [c.compression_used for c in full] == ["full_body", "full_body", "empty", "empty"] and full[2].signature == ""
    crit = run("crit")[0]
    assert crit.side_effects and crit.return_statement == "return {total}" and crit.full_body is None
    assert [run(f"budget({n})")[0].compression_used for n in (10_000, crit.estimated_tokens, 1)] == ["full_body", "full_body" if full[0].estimated_tokens <= crit.estimated_tokens else "critical_branches", "signature_only"]


def test_blake3(spark):
    data = bytes(i % 251 for i in range(8192))
    known = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"}
    assert all(blake3_hex(data[:n]) == h for n, h in known.items())
    assert len({blake3_hex(data[:n]) for n in range(0, 8192, 97)}) == len(range(0, 8192, 97))
    rows = spark.createDataFrame([("",), (None,)], "t string").select(content_hash(F.col("t")).alias("h")).collect()
    assert [r.h for r in rows] == [known[0], None]


def test_budget():
    symbols = [{"name": f"s{i}", "docstring": "d" * 200, "signature": "f" * 100, "context": "c" * 50} for i in range(30)]
    value = {"results": symbols, "count": 30}
    assert budget.budgeted(value, None) is None and budget.budgeted(value, 0) is None
    whole = budget.budgeted(value, 100_000)
    assert whole["result"] == value and not whole["truncated"] and whole["budget_remaining"] == 100_000 - whole["tokens_used"]
    _, cut, name = budget.enforce_budget(value, budget.tokens_of(budget.without(value, frozenset({"docstring"}))))
    assert cut and name == "StripDocstrings"
    least = budget.budgeted(value, 1)
    assert least["compression_applied"] == "TruncateResults" and least["result"]["count"] == 10 and len(least["result"]["results"]) == 10
    assert least["truncated"] and least["budget_remaining"] == 0
    assert budget.truncate_results({"symbols": [1, 2], "count": 2}) == {"symbols": [1, 2], "count": 2}


@pytest.mark.parametrize(("path", "canonical", "stored", "cross"), [("a/b.py", "python", "python", "python"), ("x.h", "c", "cpp", "c"), ("x.pyi", None, None, "python"), ("a.tar.jsx", "javascript", None, "unknown"), ("Makefile", None, None, "unknown"), ("py", "python", None, "unknown"), ("dir.py/file", None, None, "unknown")])
def test_languages(spark, path, canonical, stored, cross):
    got = [one(spark, language.language_of(F.col("p"), v), p=path) for v in ("canonical", "stored", "cross")]
    assert got == [canonical, stored, cross]


def test_language_names():
    assert language.parse_language("auto") is None and language.parse_language("C++") == "cpp" and language.parse_language("py") == "python"
    with pytest.raises(ValueError, match="unsupported"):
        language.parse_language("cobol")
    assert len(language.extensions()) >= 50 and language.of_extension("a/b.rs") == "rust"


@pytest.mark.parametrize(("module", "lang", "path"), [("a.b", "python", "a/b/b.py"), ("a.b", "rust", "src/a/b/mod.rs"), ("a.b", "go", "a/b/b.go"), ("a.b", "c", "include/a/b.h"), ("a.b", "cpp", "src/a/b/b.cpp"), ("m", "java", "m/m.java"), ("m", "auto", "m/m.py")])
def test_target_path(spark, module, lang, path):
    assert one(spark, language.target_path(F.col("m"), F.col("l")), m=module, l=lang) == path


def test_blake3_side_by_side():
    from graphloom.functions.blake3 import blake3_many

    data = bytes(i % 251 for i in range(20_000))
    texts = [data[:n] for n in (0, 1, 64, 65, 1023, 1024, 1025, 2048, 3073, 5 * 1024, 6 * 1024 + 1, 7 * 1024, 20_000)]
    assert blake3_many(texts) == [blake3_hex(t) for t in texts] and blake3_many([]) == []
    assert blake3_hex(data[:7168]) == "61da957ec2499a95d6b8023e2b0e604ec7f6b50e80a9678b89d2628e99ada77a"


def test_compress_splits_and_trims_a_text_once(spark):
    from graphloom.functions import text

    df = spark.createDataFrame([(1, "fn f() {\n/* a\nif x\n*/ b\n  db.add(1);\nlet z = 2;\nreturn z\n}\n"), (2, None), (3, "")], "id int, t string")
    out = text.compress(df, F.col("t"), F.lit(1), F.lit(99), "critical_branches").select("id", "compressed.*")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("^\\s+|\\s+$") <= 15
    got = {r.id: (r.signature, r.critical_branches, r.side_effects, r.key_assignments, r.return_statement, r.compression_used) for r in out.collect()}
    assert got == {1: ("fn f() {", None, ["db.add(1)"], ["let z = 2"], "return z", "critical_branches"), 2: ("", None, None, None, None, "empty"), 3: ("", None, None, None, None, "empty")}


def test_hashes_read_texts_from_the_arrow_batch(monkeypatch):
    import pyarrow as pa

    from graphloom.functions import blake3

    monkeypatch.setattr(blake3, "BATCH", 3000)
    texts = [None, "", "é" * 1500, "abc", None, "x" * 5000]
    got = blake3.content_hash.func(pa.array(["skipped", *texts]).slice(1))
    assert got.to_pylist() == [None if t is None else blake3_hex(t.encode()) for t in texts]
