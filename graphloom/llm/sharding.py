"""Sharding by best-fit-decreasing bin packing: indivisible groups of equal texts, sorted by size, enter the bin of tightest remaining
capacity, found in a balanced tree; the least capacity at which ``shards`` bins suffice is searched, so sizes come out near equal.

The packing itself sees a bounded number of items: a group of at least 1/(shards * grain) of all bytes is an item of its own, and
smaller groups are bundled by hash into items of about that size, whatever the input. No group is ever split.

Defined results: null texts are one group, of 8 bytes a row, and empty texts another; a group larger than its fair share fills a shard
beyond it, as it can't be split; repeated rows are members of their group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialize, table


class _Node:
    __slots__ = ("height", "key", "left", "right")

    def __init__(self, key):
        self.key, self.left, self.right, self.height = key, None, None, 1


def _height(n) -> int:
    return n.height if n else 0


def _rotate(n, left: bool):
    up = n.right if left else n.left
    if left:
        n.right, up.left = up.left, n
    else:
        n.left, up.right = up.right, n
    for x in (n, up):
        x.height = 1 + max(_height(x.left), _height(x.right))
    return up


def _balanced(n):
    n.height = 1 + max(_height(n.left), _height(n.right))
    lean = _height(n.left) - _height(n.right)
    if lean > 1:
        if _height(n.left.left) < _height(n.left.right):
            n.left = _rotate(n.left, True)
        return _rotate(n, False)
    if lean < -1:
        if _height(n.right.right) < _height(n.right.left):
            n.right = _rotate(n.right, False)
        return _rotate(n, True)
    return n


def insert(n, key):
    if n is None:
        return _Node(key)
    if key < n.key:
        n.left = insert(n.left, key)
    else:
        n.right = insert(n.right, key)
    return _balanced(n)


def remove(n, key):
    if key < n.key:
        n.left = remove(n.left, key)
    elif key > n.key:
        n.right = remove(n.right, key)
    elif n.left and n.right:
        least = n.right
        while least.left:
            least = least.left
        n.key = least.key
        n.right = remove(n.right, least.key)
    else:
        return n.left or n.right
    return _balanced(n)


def tightest(n, size: int):
    """The least (remaining, bin) with remaining >= size, or None."""
    found = None
    while n:
        if n.key[0] >= size:
            found, n = n.key, n.left
        else:
            n = n.right
    return found


def best_fit(sizes: list[int], capacity: int, most: int) -> list[int] | None:
    """The bin of each of the sizes, which fall; None if more than ``most`` bins are needed."""
    tree, used, out = None, 0, []
    for size in sizes:
        at = tightest(tree, size)
        if at is None:
            if used == most or size > capacity:
                return None
            at = (capacity, used)
            used += 1
        else:
            tree = remove(tree, at)
        out.append(at[1])
        tree = insert(tree, (at[0] - size, at[1]))
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """Bins 0 to shards - 1 for sizes in falling order, at about the least capacity that needs no more bins.

    A size above the mean of what is left has a bin of its own, so that it doesn't raise the capacity of the others."""
    if not sizes:
        return []
    left, own = sum(sizes), 0
    while own < shards - 1 and own < len(sizes) and sizes[own] * (shards - own) > left:
        left -= sizes[own]
        own += 1
    if own:
        return [*range(own), *(own + b for b in pack(sizes[own:], shards - own))]
    low = max(sizes[0], -(-sum(sizes) // shards))
    high = low + sizes[0]
    found = best_fit(sizes, high, shards)
    while found is None:
        low, high = high, high * 2
        found = best_fit(sizes, high, shards)
    while high - low > max(1, low // 5000):
        middle = (low + high) // 2
        held = best_fit(sizes, middle, shards)
        if held is None:
            low = middle
        else:
            high, found = middle, held
    return found


def shard(docs: DataFrame, keep: dict, shards: int = 24, grain: int = 400, chunk: int = 4096, text_col: str = "text") -> DataFrame:
    """``keep`` columns plus size, text_crc32, law, shard, slot and grown_shard; ``chunk`` rows about are numbered in one task."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = materialize(
        docs.select(
            F.struct(*(c.alias(n) for n, c in keep.items())).alias("kept"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
            F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("group"),
        )
    )
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(1, -(-total // (shards * grain)))
    large = [(r.group, r.bytes) for r in groups.where(F.col("bytes") >= least).collect()]  # shards * grain groups at most
    small = total - sum(b for _, b in large)
    bundles = max(1, -(-small // least))
    bundle = lambda c: F.pmod(F.xxhash64(c), F.lit(bundles))
    bundled = groups.where(F.col("bytes") < least).groupBy(bundle(F.col("group")).alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()  # as many at most
    items = sorted([(-b, bytes(g), -1) for g, b in large] + [(-r.bytes, b"", r.bundle) for r in bundled])
    bins = pack([-i[0] for i in items], shards)
    of_group = spark.createDataFrame([(bytearray(g), s) for (_, g, k), s in zip(items, bins, strict=True) if k < 0], "group binary, own int")
    of_bundle = spark.createDataFrame([(k, s) for (_, _, k), s in zip(items, bins, strict=True) if k >= 0], "bundle long, shared int")
    salts = max(1, -(-n_rows // (shards * chunk)))
    placed = materialize(
        rows.withColumn("bundle", bundle(F.col("group")))
        .join(F.broadcast(of_group), "group", "left")
        .join(F.broadcast(of_bundle), "bundle", "left")
        .select("kept", "size", "crc", F.coalesce("own", "shared").alias("shard"), F.pmod(F.xxhash64("kept", "crc"), F.lit(salts)).alias("salt"))
    )
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "salt").agg(F.count("*").alias("n")).select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "salt").orderBy("kept", "crc")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(offsets, ["shard", "salt"])
        .select("kept.*", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), {"doc_id": F.col("doc_id")})
