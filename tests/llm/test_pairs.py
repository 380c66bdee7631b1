"""MinHash, the embedding join and decontamination against brute force, and edge cases."""

import random

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import decontaminate, egojoin, minhash  # noqa: E402
from tests.llm import edges  # noqa: E402
from tests.llm.test_common import roots  # noqa: E402

SF = "/root/testdata/sf0.01"


def shingles(text, k):
    w = text.encode().lower().split() if text else []
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs, k):
    sets = {i: shingles(t, k) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    up = roots(links)
    return {i: up.get(i, i) for i in sets}, {i: len(s) for i, s in sets.items()}


def near_copies(rng, n_base, copies, words=60):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, words]))]
        for _ in range(copies):
            edited = list(base)
            for _ in range(rng.randrange(0, 4)):
                edited[rng.randrange(len(edited))] += rng.choice("abcdefgh")
            out.append(" ".join(edited))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "bases", "copies"), [(2, 12, 12), (5, 12, 12), (2, 2, 150)])
def test_minhash_components(spark, k, bases, copies):
    docs = near_copies(random.Random(k + copies), bases, copies)
    want, sizes = brute(docs, k)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=k).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_blocks_of_large_buckets(spark, monkeypatch):
    """Small limits send the same input through the block path."""
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr("graphloom.llm.common.HOT", 20)
    docs = near_copies(random.Random(9), 2, 120)
    want, _ = brute(docs, 2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=2).collect()}
    assert got == want


def test_sequential_bounds():
    """The posterior bound against a numeric integral of the Beta density."""
    least = minhash.least_matches(80)
    x = np.linspace(0, 1, 200_001)
    for n, m in zip(range(minhash.BATCH, 200, minhash.BATCH), least, strict=False):
        for k, reached in ((m, True), (m - 1, False)):
            if k < 0:
                continue
            with np.errstate(divide="ignore"):
                log = k * np.log(x) + (n - k) * np.log(1 - x)
            density = np.exp(log - log[np.isfinite(log)].max())
            tail = density[x >= 0.8].sum() / density.sum()
            assert (tail >= minhash.MISS) == reached


def test_minhash_edges(spark, tmp_path):
    at = edges.sf_dir(spark, tmp_path, documents=edges.documents(spark))
    rows = minhash.query(spark, at).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == 0 and not by[6].kept and by[0].kept
    for i in (1, 2, 3, 9):
        assert (by[i].n_shingles, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[5].n_shingles == 1 and by[None].component_id is None and by[None].kept
    from pyspark.sql import functions as F

    first = minhash.near_duplicates(edges.documents(spark)).where(F.col("first")).collect()
    assert sorted(r.doc_id for r in first if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9] and len(first) == 10
    assert minhash.query(spark, edges.sf_dir(spark, tmp_path / "none")).count() == 0


def test_minhash_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*words[:-1], f"x{k}"])
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, near(0)), (7, near(1)), (5, near(2)), (None, near(0)), (None, other), (None, other + " u"), (9, "apart from all the others here")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    near_rows = [r for r in out if r.n_shingles == 56 and r.component_id is not None]
    assert len(near_rows) == 4 and {r.component_id for r in near_rows} == {5}
    assert [r.doc_id for r in near_rows if r.first] == [5] and [r.doc_id for r in near_rows if r.kept] == [5]
    rest = [r for r in out if r.component_id is None]
    assert len(rest) == 2 and all(r.kept for r in rest) and sum(r.first for r in rest) == 1
    repeats = [(6, near(0)), (6, other), (8, near(1)), (9, other + " u")]
    again = minhash.near_duplicates(spark.createDataFrame(repeats, "doc_id long, text string")).collect()
    assert {r.component_id for r in again} == {6} and sorted(r.doc_id for r in again if r.first) == [6, 6]
    assert [(r.component_id, r.kept, r.first) for r in out if r.doc_id == 9] == [(9, True, True)]


def vectors(rng, n, dim, groups):
    centers = rng.normal(size=(groups, dim))
    x = centers[rng.integers(0, groups, n)] + rng.choice([0.05, 0.12, 0.2], (n, 1)) * rng.normal(size=(n, dim))
    return x.astype("f4")


@pytest.mark.parametrize(("n", "dim", "groups", "block"), [(600, 16, 40, 4096), (600, 16, 3, 64), (300, 3, 20, 50), (50, 1, 2, 8)])
def test_ego_join(spark, monkeypatch, n, dim, groups, block):
    monkeypatch.setattr(egojoin, "BLOCK", block)
    monkeypatch.setattr(egojoin, "LEAF", 16)
    x = vectors(np.random.default_rng(n + dim), n, dim, groups)
    x[n // 2 : n // 2 + n // 5] = x[3]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in egojoin.near_duplicates(df).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    up = roots([(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)])
    assert [got[i].n_links for i in range(n)] == hit.sum(1).tolist()
    assert [got[i].component_id for i in range(n)] == [up.get(i, i) for i in range(n)]


def test_ego_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.01]), (9, [1.0, 0.01]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 5, 5) for i, v in rows], "vec_id long, embedding array<float>, label int, id int, n_links int")
    got = {r.vec_id: r for r in egojoin.query(spark, edges.sf_dir(spark, tmp_path, embeddings=df)).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items() if i is not None} == {0: (2, 0, True), 1: (2, 0, False), 9: (2, 0, False)} | {i: (0, i, True) for i in (2, 3, 4, 5, 6, 7, 8)}
    assert (got[None].n_links, got[None].component_id) == (0, None)
    assert egojoin.query(spark, edges.sf_dir(spark, tmp_path / "none")).count() == 0


def test_decontamination_finds_planted_passages(spark):
    import re

    plain = lambda x: " ".join(re.findall(r"\w+", x.lower()))
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {d: sorted(i for i, x in items.items() if x in t) for d, t in texts.items()}
    rows = decontaminate.query(spark, SF).collect()
    assert {r.doc_id: [int(x) for x in r.item_ids.split(",") if x] for r in rows} == want
    assert all(r.contaminated == bool(want[r.doc_id]) for r in rows) and any(want.values())


ITEM = "A shop near the river sold Tom exactly 12.5 kg of apples and later Tom gave Ann another 7 kg for free, so how much did Tom keep?"


@pytest.mark.parametrize(
    ("text", "found", "exact"),
    [
        (ITEM, True, True),
        (f"Some words first. {ITEM} And some words after it.", True, True),
        (ITEM.replace("12.5", "90,000").replace("7 kg", "3 kg"), True, False),
        (ITEM.replace("kg", "lb"), True, False),
        (ITEM.replace("Tom", "Bob").replace("Ann", "Eve"), True, False),
        (ITEM.replace("sold Tom", "sold Bob").replace("later Tom", "later Jim"), False, False),
        ("A shop near the river sold many apples and nobody asked how much anyone did keep in the end.", False, False),
        ("", False, False),
        (None, False, False),
        ("Tom Ann Bob 12 7 3 kg kg Eve Jim 9 8 7", False, False),
    ],
)
def test_reparameterised_items(spark, text, found, exact):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, ITEM), (6, None), (7, ""), (8, "short item of five words")], "item_id long, text string")
    row = decontaminate.scan(docs, bench, {"doc_id": F.col("doc_id")}).first()
    assert (row.contaminated, row.exact) == (found, exact)


PAID = "Ann Lee paid 3 dollars and Bob Ray paid 5 dollars for it in all"
CONVERT = "Convert 5 km 30 m and 7 km 80 m to cm"


@pytest.mark.parametrize(
    ("item", "text", "found", "exact"),
    [
        (PAID, PAID, True, True),
        (PAID, f"it was asked: {PAID}, and so on", True, True),
        (PAID, PAID.replace("3", "4").replace("5", "9").replace("Bob Ray", "Tom Fox"), True, False),
        (PAID, PAID.replace("for it in all", "for two of them"), False, False),
        (CONVERT, CONVERT, True, True),
        (CONVERT, CONVERT.replace("5", "6").replace("30", "40"), True, False),
        (CONVERT, CONVERT.replace("and", "or"), False, False),
        ("1 2 3 4 5 6 7 8 9 10", "count 1 2 3 4 5 6 7 8 9 10 and on", True, True),
        ("1 2 3 4 5 6 7 8 9 10", "count 1 2 3 4 5 6 7 8 9 11 and on", False, False),
    ],
)
def test_items_dense_in_slots(spark, item, text, found, exact):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = decontaminate.scan(docs, spark.createDataFrame([(5, item)], "item_id long, text string"), {"doc_id": F.col("doc_id")}).first()
    assert (row.contaminated, row.exact) == (found, exact)


WHO = "Who wrote the novel about the large white whale"


@pytest.mark.parametrize(
    ("item", "text", "exact"),
    [
        (ITEM, ITEM.replace(" Tom", "\nTom").replace(" Ann", "  Ann"), True),
        (ITEM, ITEM.replace(" kg", "\n kg").replace("Tom", "Bob").replace(" Bob", "\n\tBob").replace(" Ann", "\u00a0Eve"), False),
        (ITEM, ITEM.lower(), True),
        (ITEM, ITEM.upper(), True),
        (ITEM, ITEM.replace("Tom", '"Tom"'), True),
        ("The old man sold Tom a boat and a net so that he could fish in it", "the old man sold\nTom a boat and a net so that he could fish in it", True),
        (WHO, f"Question {WHO}", True),
        (WHO, WHO.lower(), True),
        ("Who gave the large white whale to Ann", "Question Who gave the large white whale to\nEve", False),
    ],
)
def test_rewrapped_items(spark, item, text, exact):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = decontaminate.scan(docs, spark.createDataFrame([(5, item)], "item_id long, text string"), {"doc_id": F.col("doc_id")}).first()
    assert (row.contaminated, row.exact) == (True, exact)


SLOTTED = "tell me what 5 times 7 plus one makes"


@pytest.mark.parametrize(
    ("item", "text", "found", "exact"),
    [
        (SLOTTED, SLOTTED, True, True),
        (SLOTTED, SLOTTED.replace("7", "9"), True, False),  # every slot is compared
        (SLOTTED, SLOTTED.replace("7", "5"), False, False),
        ("5 minus 5", "so 5 minus 5 it is", True, True),
        ("5 minus 5", "so 6 minus 9 it is", False, False),
        ("Anna has some apples and gives most of them to a friend", "Peter has some apples and gives most of them to a friend", True, False),
        ("Anna has some apples and gives them all", "Peter has some apples and gives them all", True, False),
        ("Anna had six pears. Ben had two more pears. Who had most?", "Eve had six pears. Tom had two more pears. Who had most?", True, False),
        ("Anna had six pears. Anna had two more pears. Who had most?", "Eve had six pears. Tom had two more pears. Who had most?", False, False),
        ("what is 12 plus 30 plus 45 plus 60 minus 7 times 8 kg", "what is 12 plus 30 plus 45 plus 60 minus 7 times 8 kg", True, True),
        ("If 3 kg cost 12 dollars and 5 kg cost 20 dollars, then 9 kg cost how many dollars?", "If 3 kg cost 12 dollars and 5 kg cost 20 dollars, then 9 kg cost how many dollars?", True, True),
    ],
)
def test_all_slots_and_sentence_starts(spark, item, text, found, exact):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = decontaminate.scan(docs, spark.createDataFrame([(5, item)], "item_id long, text string"), {"doc_id": F.col("doc_id")}).first()
    assert (row.contaminated, row.exact) == (found, exact)


def read_tokens(text):
    """(kind, plain word) of each token: 1 name, 2 number, 3 unit, 4 a capitalised word at a sentence's start, 0 another word."""
    import regex

    out = []
    for m in regex.finditer(r"(?<![\p{L}\d.,])\d+(?:[.,]\d+)*|[\p{L}\d]+", text):
        word, before = m.group(), text[: m.start()]
        kind = 0
        if word[0].isdigit():
            kind = 2
        elif word.lower() in decontaminate.UNITS and regex.search(r"\d\s*$", before):
            kind = 3
        elif regex.match(r"\p{Lu}\p{Ll}", word):
            kind = 1 if regex.search(r"[^.!?:\s]\s+$", before) else 4
        out.append((kind, word.lower()))
    return out


def brute_leaks(text, item):
    """None, or (windows, exact), by comparing every alignment token by token."""
    d, e = read_tokens(text), read_tokens(item)
    size, found = min(8, len(e)), None
    of = len(e) - size + 1
    as_words = lambda ts: [(0 if k == 4 else k, w) for k, w in ts]
    as_names = lambda ts: [(1 if k == 4 else k, w) for k, w in ts]
    for at in range(-len(e) + 1, len(d)):
        pad = lambda ts: [ts[at + i] if 0 <= at + i < len(ts) else None for i in range(len(e))]
        plain = [x is not None and x[1] == y[1] for x, y in zip(pad(d), e)]
        ok_plain = [all(plain[j : j + size]) for j in range(of)]
        proposed = any(ok_plain)
        judged = []
        for reading in (as_words, as_names):
            dd, ee = pad(reading(d)), reading(e)
            lit = [sum(k == 0 for k, _ in ee[j : j + size]) for j in range(of)]
            few = sum(2 * n >= size for n in lit) < min(7, of)
            pure = [x is not None and (x == y if y[0] == 0 else x[0] == y[0]) for x, y in zip(pad(as_words(d)), ee)]
            proposed |= any(all(pure[j : j + size]) and (lit[j] > 0 if few else 2 * lit[j] >= size) for j in range(of))
            match = [x is not None and (x[1] == y[1] or (x[0] > 0 and x[0] == y[0])) for x, y in zip(dd, ee)]
            ok = [all(match[j : j + size]) for j in range(of)]
            most, some = (sum(o and f(n) for o, n in zip(ok, lit)) for f in (lambda n: 2 * n >= size, lambda n: n > 0))
            whole = few and sum(k == 0 for k, _ in ee) >= 4 and some >= sum(n > 0 for n in lit)
            pairs = {(ee[i][1], dd[i][1]) for j in range(of) if ok[j] for i in range(j, j + size) if ee[i][0] or dd[i][0]}
            good = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
            judged.append(((most >= min(7, of) or whole) and good, some, all(a == b for a, b in pairs)))
        start = lambda i, k: any(t == 4 for t, _ in e[i : i + k])
        free = [i for i in range(len(e) - 3) if not start(i, 4)]
        if size >= 4 and free and all(start(j, size) for j in range(of)):  # looked up by four tokens without a sentence's start
            i = max(free, key=lambda i: (sum(k == 0 for k, _ in e[i : i + 4]), -i))
            proposed |= all(x is not None and (x == y if y[0] == 0 else x[0] == y[0]) for x, y in list(zip(pad(as_words(d)), as_words(e)))[i : i + 4])
        valued = sum(ok_plain) >= min(7, of)
        if proposed and (valued or any(x[0] for x in judged)):
            n = max([sum(ok_plain), *(x[1] for x in judged if x[0])])
            exact = any(x[0] and x[2] for x in judged) or (valued and sum(ok_plain) >= max(x[1] for x in judged))
            found = (n, exact) if found is None else (max(n, found[0]), exact or found[1])
    return found


def test_decontamination_by_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    pick = lambda xs: rng.choice(xs.split())

    def word(kind):
        return {"w": lambda: pick("the shop sold red some more than every day for"), "n": lambda: pick("Tom Ann Bob Eve"), "d": lambda: pick("3 5 7 12.5 900"), "u": lambda: rng.choice("357") + " " + pick("kg lb km")}[kind]()

    def spell(kinds):
        out, start = [], True
        for k in kinds:
            w = word(k)
            out.append(w.capitalize() if start and rng.random() < 0.7 else w)
            start = rng.random() < 0.12
            out[-1] += pick(". ? !") if start else ""
        return rng.choice([" ", " ", "\n"]).join(out)

    items = [spell(rng.choices("wnud", (6, 2, 1, 1), k=rng.choice([3, 6, 8, 9, 12, 20, 26]))) for _ in range(40)]
    docs = []
    for _ in range(400):
        text = rng.choice(items)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):  # other names and numbers, other words, another case
            a, b = rng.choice([("Tom", "Eve"), ("Ann", "Bob"), ("3", "5"), ("7", "900"), ("kg", "lb"), ("red", "blue"), ("The ", "Some "), ("shop", "Shop")])
            text = text.replace(a, b) if rng.random() < 0.6 else text.replace(a, b, 1)
        text = rng.choice([text, text.lower(), text[: len(text) * 3 // 4], f"{text} {text}"])
        docs.append(f"{spell('ww')} {text} {spell('wnw')}" if rng.random() < 0.5 else text)
    df = spark.createDataFrame(list(enumerate(docs)), "uid long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.uid, r.item_id): (r.n_windows, r.exact) for r in decontaminate.leaks(df, bench).collect()}
    want = {(i, j): f for i, t in enumerate(docs) for j, x in enumerate(items) if (f := brute_leaks(t, x))}
    assert {k: (docs[k[0]], items[k[1]], got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert len(want) > 200 and any(not x for _, x in want.values())
    monkey = pytest.MonkeyPatch()
    monkey.setattr(decontaminate, "PIECE", 37)  # texts in pieces give the same
    try:
        assert {(r.uid, r.item_id): (r.n_windows, r.exact) for r in decontaminate.leaks(df, bench).collect()} == got
    finally:
        monkey.undo()


def test_decontamination_edges(spark, tmp_path):
    bench = spark.createDataFrame([(1, "the small dog went over the hill and saw a large bird"), (2, "word")], "item_id long, text string")
    rows = decontaminate.query(spark, edges.sf_dir(spark, tmp_path / "a", documents=edges.documents(spark), benchmark=bench)).collect()
    assert len(rows) == 12 and sorted(r.doc_id for r in rows if r.contaminated and "1" in r.item_ids) == [0, 6, 6]
    assert {r.doc_id for r in rows if "2" in r.item_ids} == {5}
    rows = decontaminate.query(spark, edges.sf_dir(spark, tmp_path / "b", documents=edges.documents(spark))).collect()
    assert len(rows) == 12 and not any(r.contaminated for r in rows)
    assert decontaminate.query(spark, edges.sf_dir(spark, tmp_path / "c", benchmark=bench)).count() == 0


def test_decontamination_across_a_cut(spark):
    from pyspark.sql import functions as F

    for at in (decontaminate.PIECE - 60, decontaminate.PIECE, decontaminate.PIECE + 30):
        text = ("x " * (at // 2)) + ITEM + " y" * 60_000
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        bench = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
        assert decontaminate.scan(docs, bench, {"doc_id": F.col("doc_id")}).first().contaminated


def test_pair_sql(spark, tmp_path):
    """The SQL of the joins on planted links."""
    import duckdb

    docs = spark.createDataFrame(near_copies(random.Random(5), 6, 20), "doc_id long, text string").unionByName(edges.documents(spark).select("doc_id", "text").where("doc_id is null or doc_id > 1000"))
    x = vectors(np.random.default_rng(1), 200, 8, 15)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8)], "vec_id long, embedding array<float>")
    at = edges.sf_dir(spark, tmp_path, documents=docs, embeddings=df)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    for module, links in ((minhash, None), (egojoin, 1)):
        want = sorted(map(repr, con.execute(module.oracle()).fetchall()))
        rows = [tuple(r) for r in module.query(spark, at).collect()]
        assert sorted(map(repr, rows)) == want
        assert len({r[2] for r in rows}) < len(rows)
        assert links is None or any(r[1] for r in rows)
