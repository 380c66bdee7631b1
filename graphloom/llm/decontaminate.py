"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

Names, numbers and units become typed slots: capitalised words inside a sentence, digit runs, and unit words after a number, whatever
white space is before them. Other words are lower-cased; a capitalised word at a sentence's start is read both as a word and as a name.
Windows of eight tokens (of the whole item, if it has fewer), slots by type and words by themselves, are hashed and joined with those of
the benchmark, and so are windows of the plain words, slots by their values. Each window that an item and a text share proposes an
alignment of the two, and each alignment is then judged token by token:

* A token matches if the plain words are equal or both are slots of one type. A window matches if all its tokens do.
* The text leaks the item if seven windows match (all, if it has fewer) and all slots of the matching windows are consistent: an
  item's value always stands for the same value of the text and the other way round. Values may differ, which catches questions asked
  again with other numbers or names. Windows with fewer than half literal words don't count to the seven; an item that has too few
  others must match in all its windows that hold a literal word, and have four literal words.
* Or if seven windows (all, if there are fewer) are equal in their plain words.

Either reading of sentence starts may do. An item all of whose windows hold a sentence's start is looked up besides by four tokens without
one, those of most words.

Defined results: null and empty texts, of documents or items, match nothing; texts over ``PIECE`` characters are cut with an overlap
beyond four times the longest item, and an alignment that a cut runs through is left to the piece that holds it whole; repeated rows are
judged each on its own; empty tables give no leaks.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, numbered, table

WINDOW, RUN, PIECE = 8, 7, 100_000
#: Literal words of an item that is matched whole; tokens of the windows that longer ones are hashed from.
WORDS, HALF = 4, 4
#: Bytes of the benchmark's windows, and number of texts with an alignment, that may be broadcast.
MOST_BYTES, MOST_IDS = 32_000_000, 1_000_000
UNITS = (
    "kg g mg lb lbs oz ton tons km m cm mm mile miles ft feet foot inch inches yard yards hour hours hr hrs minute minutes min second "
    "seconds sec day days week weeks month months year years dollar dollars euro euros cent cents pound pounds percent liter liters litre "
    "litres ml degree degrees meter meters metre metres"
).split()
#: White space, of a character class.
BLANK = r"\s\p{Z}"
#: Marks put in front of names, numbers, units, and capitalised words at a sentence's start.
NAME, NUMBER, UNIT, START = "\u0001", "\u0002", "\u0003", "\u0004"


def tokenised(rows: DataFrame, text: str, starts: bool = False) -> DataFrame:
    """Replace the text column by tokens, lower-cased words and marked slots, and marked (there may be slots). Sentence starts are marked
    with ``starts`` alone, which changes no token's place.

    Each step is a column of its own, read by more than one other, so that none is computed twice; texts without digits skip the
    expressions for numbers and units."""
    others = [c for c in rows.columns if c != text]
    foreign = reduce(or_, (F.contains(F.col(text), F.lit(c)) for c in (NAME, NUMBER, UNIT, START)))
    plain = rows.select(*others, F.when(foreign, F.translate(text, NAME + NUMBER + UNIT + START, "    ")).otherwise(F.col(text)).alias("t"))
    named = F.regexp_replace("t", rf"([^.!?:{BLANK}])[{BLANK}]+(?=\p{{Lu}}\p{{Ll}})", "$1 " + NAME)
    if starts:
        named = F.regexp_replace(named, rf"(?<![\p{{L}}\d{NAME}])(?=\p{{Lu}}\p{{Ll}})", START)
    named = plain.select(*others, named.alias("t"), F.col("t").rlike("[0-9]").alias("digits"))
    numbered_ = F.regexp_replace("t", r"(?<![\p{L}\d.,])(?=\d)", NUMBER)
    spaced = F.regexp_replace(numbered_, rf"(?<=\d)[{BLANK}]+", " ")
    united = F.regexp_replace(spaced, rf"(?<=\d ?)(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\d]))", UNIT)
    low = named.select(*others, "digits", F.lower(F.when(F.col("digits"), united).otherwise(F.col("t"))).alias("t"))
    found = F.regexp_extract_all("t", F.lit(rf"{NUMBER}\d+(?:[.,]\d+)*|[{NAME}{UNIT}{START}]?[\p{{L}}\d]+"), F.lit(0))
    words = F.array_remove(F.split("t", rf"[^\p{{L}}{NAME}{START}]+"), "")
    return low.select(*others, F.when(F.col("digits"), found).otherwise(words).alias("tokens"), (F.col("digits") | F.contains("t", F.lit(NAME))).alias("marked"))


def _typed(t: Column) -> Column:
    """A slot's mark, or the word."""
    return F.when(F.ascii(t) <= 3, F.substring(t, 1, 1)).otherwise(t)


def _plain(t: Column) -> Column:
    """A slot's value, or the word."""
    return F.when(F.ascii(t) <= 4, F.substring(t, 2, 1 << 30)).otherwise(t)


def _as_words(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(F.ascii(t) == 4, _plain(t)).otherwise(t))


def _as_names(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(F.ascii(t) == 4, F.concat(F.lit(NAME), _plain(t))).otherwise(t))


def _hash(h: Column, halves: Column, i: Column, size: int) -> Column:
    """The hash of the window of ``size`` tokens at i, from the hashes of its tokens or of its first and last ``HALF`` tokens."""
    if size < HALF:
        return F.xxhash64(*(F.get(h, i + k) for k in range(size)), F.lit(size))
    return F.xxhash64(F.get(halves, i), F.get(halves, i + size - HALF), F.lit(size))


def _halves(h: Column) -> Column:
    return F.when(F.size(h) >= HALF, F.transform(F.sequence(F.lit(0), F.size(h) - HALF), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(HALF)))))


def windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(uid, piece, pos, hash): one row a window of each of the sizes, and another one of its plain words if it has slots. Texts without
    slots take shorter expressions to the same hashes. No filter reads the tokens, as it would be pushed below them and compute them again."""
    kept = [c for c in rows.columns if c not in ("tokens", "marked")]
    typed = F.transform("tokens", lambda t: F.xxhash64(_typed(t)))
    plain = F.transform("tokens", lambda t: F.xxhash64(_plain(t)))
    hashed = rows.withColumn("h", F.when(F.col("marked"), typed).otherwise(F.transform("tokens", lambda t: F.xxhash64(t))))
    hashed = hashed.withColumn("p", F.when(F.col("marked"), plain)).withColumn("m", F.when(F.col("marked"), F.transform("tokens", lambda t: F.ascii(t) <= 3)))
    hashed = hashed.withColumn("h4", _halves(F.col("h"))).withColumn("p4", F.when(F.col("marked"), _halves(F.col("p"))))

    def parts(size: int) -> tuple[Column, Column]:
        window = lambda h, i: F.struct(i.alias("pos"), _hash(F.col(h), F.col(h + "4"), i, size).alias("hash"))
        starts = F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size)).otherwise(F.array().cast("array<int>"))
        slotted = F.filter(starts, lambda i: reduce(or_, (F.get("m", i + k) for k in range(size))))
        valued = F.when(F.col("marked"), F.transform(slotted, lambda i: window("p", i)))
        return F.transform(starts, lambda i: window("h", i)), F.coalesce(valued, F.array().cast("array<struct<pos:int,hash:bigint>>"))

    return hashed.select(*kept, F.explode(F.concat(*(c for size in sizes for c in parts(size)))).alias("w")).select(*kept, "w.pos", "w.hash")


def _literals(tokens: Column, size: Column, of: Column) -> Column:
    """Words, not slots, in each window."""
    return F.transform(F.sequence(F.lit(0), of - 1), lambda i: F.size(F.filter(F.slice(tokens, i + 1, size), lambda t: F.ascii(t) > 3)))


def index_of(items: DataFrame) -> DataFrame:
    """items (row, tokens, size, of) -> (size, hash, row, item_pos): the windows that propose alignments."""
    read = lambda tokens, literal: items.select("row", "size", "of", tokens.alias("tokens"), F.lit(literal).alias("template"))
    plain = F.transform("tokens", _plain)
    every = read(_as_words(F.col("tokens")), True).union(read(_as_names(F.col("tokens")), True)).union(read(plain, False)).distinct()
    hashes = every.withColumn("h", F.transform("tokens", lambda t: F.xxhash64(_typed(t)))).withColumn("literals", _literals(F.col("tokens"), F.col("size"), F.col("of")))
    few = F.size(F.filter("literals", lambda n: 2 * n >= F.col("size"))) < F.least(F.lit(RUN), F.col("of"))
    place = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    placed = hashes.select("row", "size", "template", "h", "literals", few.alias("few"), place.alias("item_pos"))
    n = F.get("literals", F.col("item_pos"))
    kept = placed.where(~F.col("template") | F.when(F.col("few"), n > 0).otherwise(2 * n >= F.col("size")))
    # four tokens between sentence starts
    start = lambda i, k: F.exists(F.slice("tokens", i + 1, k), lambda t: F.ascii(t) == 4)
    places = lambda k: F.sequence(F.lit(0), F.size("tokens") - k)
    literal = lambda i: F.size(F.filter(F.slice("tokens", i + 1, HALF), lambda t: F.ascii(t) > 3))
    bound = items.where((F.size("tokens") >= HALF) & (F.col("size") >= HALF)).where(F.forall(places(F.col("size")), lambda i: start(i, F.col("size"))))
    best = F.array_max(F.transform(F.filter(places(F.lit(HALF)), lambda i: ~start(i, F.lit(HALF))), lambda i: F.struct(literal(i).alias("n"), (-i).alias("i"))))
    short = bound.select("row", "tokens", best.alias("best")).where("best is not null")
    short = short.select(F.lit(HALF).alias("size"), F.transform(F.slice("tokens", 1 - F.col("best.i"), F.lit(HALF)), lambda t: F.xxhash64(_typed(t))).alias("h"), "row", (-F.col("best.i")).alias("item_pos"))
    cut = kept.select("size", F.slice("h", F.col("item_pos") + 1, F.col("size")).alias("h"), "row", "item_pos").union(short)
    halved = cut.withColumn("h4", _halves(F.col("h")))
    hash_ = F.coalesce(*(F.when(F.col("size") == k, _hash(F.col("h"), F.col("h4"), F.lit(0), k)) for k in range(1, WINDOW + 1)))
    return halved.select("size", hash_.alias("hash"), "row", "item_pos").distinct()


def judged(aligned: DataFrame) -> DataFrame:
    """Rows with e and d, the item's tokens and the text's at the same places (null outside it), and size and of: add n_windows and exact
    where the text leaks the item; null otherwise."""
    places = aligned.withColumn("starts", F.sequence(F.lit(0), F.col("of") - 1)).withColumn("run", F.least(F.lit(RUN), F.col("of")))
    ok = lambda match: F.transform("starts", lambda j: F.forall(F.slice(match, j + 1, F.col("size")), lambda x: x))
    equal = F.zip_with("e", "d", lambda e, d: F.coalesce(_plain(e) == _plain(d), F.lit(False)))
    out = places.withColumn("equal", equal).withColumn("ok_plain", ok(F.col("equal"))).withColumn("n_plain", F.size(F.filter("ok_plain", lambda x: x)))
    for r, reading in (("w", _as_words), ("n", _as_names)):
        out = out.withColumn(f"e_{r}", reading(F.col("e"))).withColumn(f"d_{r}", reading(F.col("d")))
        slot = lambda t: F.coalesce(F.ascii(t) <= 3, F.lit(False))
        match = F.zip_with(f"e_{r}", f"d_{r}", lambda e, d: F.coalesce((_plain(e) == _plain(d)) | (slot(e) & slot(d) & (F.ascii(e) == F.ascii(d))), F.lit(False)))
        out = out.withColumn(f"match_{r}", match).withColumn(f"ok_{r}", ok(F.col(f"match_{r}"))).withColumn(f"literals_{r}", _literals(F.col(f"e_{r}"), F.col("size"), F.col("of")))
        out = out.withColumn(f"met_{r}", F.arrays_zip(F.col(f"ok_{r}").alias("ok"), F.col(f"literals_{r}").alias("n")))
        count = lambda c, f: F.size(F.filter(c, f))
        all_most = count(f"literals_{r}", lambda n: 2 * n >= F.col("size"))
        most, some = count(f"met_{r}", lambda x: x["ok"] & (2 * x["n"] >= F.col("size"))), count(f"met_{r}", lambda x: x["ok"] & (x["n"] > 0))
        whole = (all_most < F.col("run")) & (F.size(F.filter(f"e_{r}", lambda t: F.ascii(t) > 3)) >= WORDS) & (some >= count(f"literals_{r}", lambda n: n > 0))
        inside = lambda i, c=f"ok_{r}": F.exists(F.slice(c, F.greatest(i - F.col("size") + 2, F.lit(1)), F.least(i + 1, F.col("size"))), lambda x: x)
        every = F.arrays_zip(F.sequence(F.lit(0), F.size("e") - 1).alias("i"), F.col(f"e_{r}").alias("e"), F.col(f"d_{r}").alias("d"))
        held = F.filter(every, lambda x: inside(x["i"]) & (slot(x["e"]) | slot(x["d"])))
        out = out.withColumn(f"pairs_{r}", F.array_distinct(F.transform(held, lambda x: F.struct(_plain(x["e"]).alias("of_item"), _plain(x["d"]).alias("of_doc")))))
        side = lambda c, p=f"pairs_{r}": F.size(F.array_distinct(F.transform(p, lambda s: s[c])))
        consistent = (side("of_item") == F.size(f"pairs_{r}")) & (side("of_doc") == F.size(f"pairs_{r}"))
        out = out.withColumn(f"n_{r}", some).withColumn(f"leak_{r}", ((most >= F.col("run")) | whole) & consistent)
        out = out.withColumn(f"exact_{r}", F.col(f"leak_{r}") & F.forall(f"pairs_{r}", lambda s: s["of_item"] == s["of_doc"]))
    valued = F.col("n_plain") >= F.col("run")
    n = F.greatest(F.when(F.col("leak_w"), F.col("n_w")).otherwise(0), F.when(F.col("leak_n"), F.col("n_n")).otherwise(0), F.col("n_plain"))
    exact = F.col("exact_w") | F.col("exact_n") | (valued & (F.col("n_plain") >= F.greatest("n_w", "n_n")))
    return out.withColumn("n_windows", F.when(F.col("leak_w") | F.col("leak_n") | valued, n)).withColumn("exact", exact)


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(uid, item_id, n_windows, exact): each document (by its uid column) and item that it leaks."""
    named = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.monotonically_increasing_id().alias("row"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    read = tokenised(named.withColumn("chars", F.length("t")), "t", starts=True).drop("marked").withColumn("size", F.least(F.size("tokens"), F.lit(WINDOW)))
    items = materialize(read.withColumn("of", F.size("tokens") - F.col("size") + 1)).where("size > 0")
    overlap = 2_000 + 4 * (items.agg(F.max("chars")).first()[0] or 0)
    index = materialize(index_of(items))
    pieces = docs.select("uid", F.col(text_col).cast("string").alias("t")).where("t is not null and t != ''")
    long = F.length("t") > PIECE
    starts = F.when(long, F.sequence(F.lit(0), F.length("t") - 1, F.lit(PIECE))).otherwise(F.array(F.lit(0)))
    whole = pieces.select("uid", F.when(long, F.regexp_replace("t", rf"[{BLANK}]+", " ")).otherwise(F.col("t")).alias("t")).select("uid", "t", F.explode(starts).alias("piece"))
    end = F.col("piece") + PIECE + overlap >= F.length("t")
    text = F.when(long, F.substring(F.col("t"), F.col("piece") + 1, F.lit(PIECE + overlap))).otherwise(F.col("t"))
    cut = tokenised(whole.select("uid", "piece", text.alias("t")), "t")
    index_bytes = 32 * index.count()
    sizes = sorted(r.size for r in index.select("size").distinct().collect())  # of 1 to WINDOW
    if not sizes:
        return docs.sparkSession.createDataFrame([], "uid long, item_id long, n_windows long, exact boolean")
    places = index.select("hash", "row", "item_pos")
    held = windows(cut, sizes).join(F.broadcast(places) if index_bytes <= MOST_BYTES else places, "hash")
    proposed = materialize(held.select("uid", "piece", "row", (F.col("pos") - F.col("item_pos")).alias("at")).distinct())
    # only texts with an alignment are read again
    some = proposed.select("uid", "piece").distinct()
    again = whole.select("uid", "piece", text.alias("t"), end.alias("end")).join(F.broadcast(some) if some.count() <= MOST_IDS else some, ["uid", "piece"], "left_semi")
    known = items.select("row", "item_id", F.col("tokens").alias("e"), "size", "of")
    known = F.broadcast(known) if index_bytes <= MOST_BYTES else known
    both = proposed.join(tokenised(again, "t", starts=True), ["uid", "piece"]).join(known, "row")
    within = ((F.col("piece") == 0) | (F.col("at") >= 1)) & (F.col("end") | (F.col("at") + F.size("e") < F.size("tokens")))
    aligned = both.where(within).select("uid", "item_id", "e", "size", "of", F.transform(F.sequence(F.lit(0), F.size("e") - 1), lambda i: F.get("tokens", F.col("at") + i)).alias("d"))
    # a filter before the group-by would be pushed into the projection and judge twice
    return judged(aligned).groupBy("uid", "item_id").agg(F.max("n_windows").cast("long").alias("n_windows"), F.max("exact").alias("exact")).where("n_windows is not null")


def scan(docs: DataFrame, benchmark: DataFrame, keep: dict, text_col: str = "text") -> DataFrame:
    """``keep`` columns plus n_items, n_windows, item_ids (sorted), exact (all slots of some item equal) and contaminated."""
    rows = numbered(docs.select(*(c.alias(n) for n, c in keep.items()), F.col(text_col).cast("string").alias("__text")))
    found = leaks(rows, benchmark, "__text").groupBy("uid").agg(F.count("*").alias("n"), F.sum("n_windows").alias("w"), F.array_sort(F.collect_set("item_id")).alias("ids"), F.max("exact").alias("same"))
    return (
        rows.select(*keep, "uid")
        .join(found, "uid", "left")
        .select(*keep, F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("w", F.lit(0)).alias("n_windows"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("same", F.lit(False)).alias("exact"), F.col("n").isNotNull().alias("contaminated"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, table(spark, sf_dir, "benchmark"), {"doc_id": F.col("doc_id")})
    return out.withColumn("item_ids", F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ","))
