"""Approximate-string joins: which of many names are within a few edits of which of many queries, by equi-joins alone.

Two strings within ``edits`` edits (insert, delete, replace) share

* a string made by deleting at most ``edits`` characters from each: the key of short strings, which have few of those;
* one of the ``GRAM * edits + 1`` rarest of their positional character grams, at places at most ``edits`` apart: the key of longer ones.

A string of at most ``SHORT`` characters meets others by the first key, and strings up to ``edits`` longer have it too, so no pair is lost
between the two. Candidates are verified by the edit distance itself, so the result is that of comparing all pairs, whatever the keys.

Equal names are one name, and equal queries one query, before anything is joined. Grams are ordered by their frequency in all strings, so
those that many names share aren't keys of strings that have rarer ones; what stays frequent is split by AQE's skew joins.

Defined results: strings are compared in lower case; nulls match nothing; the empty string matches strings of at most ``edits``
characters; repeated queries and names each get their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.plans.storage import written

GRAM, EDITS = 3, 2
#: Gram kinds that may be broadcast with their frequencies; beyond it they meet by a shuffle.
MOST_GRAMS = 500_000


def short(edits: int) -> int:
    """The length up to which a string may share no gram with one that is within the edits."""
    return GRAM * (edits - 1) + 2


def deletions(text: Column, edits: int) -> Column:
    """All strings made by deleting at most ``edits`` characters."""
    out = last = F.array(text)
    for _ in range(edits):
        fewer = F.transform(last, lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>")))  # noqa: B023
        last = F.array_distinct(F.flatten(fewer))
        out = F.array_union(out, last)
    return out


def _grams(strings: DataFrame, column: str) -> DataFrame:
    """(column, gram, at): the grams of longer strings with their places, ends marked."""
    padded = F.concat(F.lit("\x01" * (GRAM - 1)), F.col(column), F.lit("\x02" * (GRAM - 1)))
    held = strings.select(column, padded.alias("__p"))
    places = F.sequence(F.lit(1), F.length("__p") - (GRAM - 1))
    return held.select(column, F.posexplode(F.transform(places, lambda i: F.substring(F.col("__p"), i, F.lit(GRAM)))).alias("at", "gram"))


def _rarest(grams: DataFrame, counts: DataFrame, column: str, most: int) -> DataFrame:
    order = Window.partitionBy(column).orderBy("n", "gram", "at")
    return grams.join(counts, "gram").withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).select(column, "gram", "at")


def within(queries: DataFrame, names: DataFrame, edits: int = EDITS) -> DataFrame:
    """(query, name, distance) of distinct strings: queries (query), names (name), both in lower case."""
    limit = short(edits)
    asked, held = queries.select("query").where("query is not null").distinct(), names.select("name").where("name is not null").distinct()
    by_deletion = (
        asked.where(F.length("query") <= limit + edits).select("query", F.explode(deletions(F.col("query"), edits)).alias("key"))
        .join(held.where(F.length("name") <= limit + edits).select("name", F.explode(deletions(F.col("name"), edits)).alias("key")), "key")
        .where((F.length("query") <= limit) | (F.length("name") <= limit))
        .select("query", "name")
    )
    long_asked, long_held = asked.where(F.length("query") > limit), held.where(F.length("name") > limit)
    asked_grams, held_grams = _grams(long_asked, "query"), _grams(long_held, "name")
    counts = written(asked_grams.select("gram").unionByName(held_grams.select("gram")).groupBy("gram").agg(F.count("*").alias("n")))
    counts = F.broadcast(counts) if counts.count() <= MOST_GRAMS else counts
    most = GRAM * edits + 1
    near = F.explode(F.sequence(F.col("at") - edits, F.col("at") + edits)).alias("at")
    by_gram = _rarest(asked_grams, counts, "query", most).select("query", "gram", near).join(_rarest(held_grams, counts, "name", most), ["gram", "at"]).select("query", "name")
    close = by_deletion.unionByName(by_gram).where(F.abs(F.length("query") - F.length("name")) <= edits)
    return close.withColumn("distance", F.levenshtein("query", "name", edits)).where("distance >= 0").distinct()


def nearest(queries: DataFrame, symbols: DataFrame, edits: int = EDITS, limit: int = 10) -> DataFrame:
    """(qid, id, name, distance, place): for each query (qid, query) the ``limit`` nearest symbols (id, name) within the edits, ties by name and id."""
    asked = queries.select("qid", F.lower("query").alias("query"))
    held = symbols.select("id", "name", F.lower("name").alias("low"))
    pairs = within(asked, held.select(F.col("low").alias("name")), edits)
    # a query takes no more than ``limit`` symbols of one name
    first = Window.partitionBy("low").orderBy("name", "id")
    few = held.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= limit).drop("__k")
    found = asked.join(pairs.withColumnRenamed("name", "low"), "query").join(few, "low").select("qid", "id", "name", "distance")
    best = Window.partitionBy("qid").orderBy("distance", "name", "id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
