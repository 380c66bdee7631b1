"""MinHash near-duplicates with sequential Bayesian verification.

Each text becomes its set of k-word shingles, 64-bit hashes; equal sets are folded into one representative first. Signatures of
``BANDS * ROWS`` minima are cut into bands. Candidates of a bucket are compared batch by batch of the signature: after each batch a pair
is dropped if the posterior probability that its similarity reaches the threshold, under a uniform prior, is below ``MISS``. What
survives is verified exactly on the full sets.

No bucket emits all its pairs. Each member meets its bucket's least member first. Buckets that still span several components are
finished exactly: small ones by their remaining pairs across components, large ones block against block inside tasks of bounded size
that hand on a spanning forest of the verified links only.

Defined results: null, empty and blank texts have the empty set, link with nothing and are their own component; rows that repeat a
doc_id are one document; rows without doc_id are compared like all others, take the component of the rows they are linked with, which is named
by the least doc_id, and have none and are kept if no such row has a doc_id;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import components, map_text, materialize, numbered, spread_join, table

BANDS, ROWS, BATCH, MISS = 26, 5, 26, 1e-5
#: Members of a bucket whose open pairs are listed; members of a block beyond that; pairs of ids that may be broadcast (32 MB).
SMALL, BLOCK, MOST_IDS = 48, 256, 2_000_000
_SEED = np.random.default_rng(20240229)
_A = (_SEED.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _SEED.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of k-word shingles; hashes of words are remembered, up to a bound."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def set_of(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        held = self.held
        if len(held) > 150_000:
            held.clear()
        h = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            x = held.get(w)
            if x is None:
                x = held[w] = xxhash.xxh64_intdigest(w)
            h[i] = x
        k = min(self.k, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            out = (out ^ h[j : len(words) - k + 1 + j]) * _M
            out ^= out >> np.uint64(31)
        return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (low[None, i : i + 4096] * _A[:, None] + _B[:, None]).min(1), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _M
    for j in range(ROWS):
        h = (h ^ x[:, j]) * _M
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def least_matches(percent: int) -> list[int]:
    """For each batch, the matches below which P(similarity >= threshold | matches) < MISS: with a uniform prior the posterior is a
    Beta distribution, whose upper tail is the binomial sum below."""
    out, t = [], percent / 100
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < MISS:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a & b| >= percent |a | b|, on whole sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """docs (uid, id, t) -> (uid, id, n, key, sig): one row a document; key is null for the empty set. Only short columns: no set is carried."""

    def make():
        shingler = Shingler(k)

        def run(texts):
            n, key, sig = [], [], []
            for t in texts:
                s = shingler.set_of(t)
                n.append(len(s))
                key.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            return [pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())]

        return run

    return map_text(docs, F.col("t"), make, "n long, key binary, sig binary", {"uid": F.col("uid"), "id": F.col("id")})


def pruned(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sequential test doesn't drop."""
    least = least_matches(percent)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            alive = np.arange(len(x))
            matches = np.zeros(len(x), int)
            for k, m in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (x[alive, cut] == y[alive, cut]).sum(1)
                alive = alive[matches[alive] >= m]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda c: sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, uids: DataFrame, k: int) -> DataFrame:
    """(id, items) for the rows of ``uids`` (uid, id). The ids are broadcast if few enough, so that texts stay where they are."""
    wanted = docs.select("uid", "t").join(F.broadcast(uids) if uids.count() <= MOST_IDS else uids, "uid")

    def make():
        shingler = Shingler(k)

        def run(texts):
            sets = [shingler.set_of(t).view(np.int64) for t in texts]
            return [pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32), np.concatenate(sets))]

        return run

    return map_text(wanted, F.col("t"), make, "items array<long>", {"id": F.col("id")})


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold. Sets are compared row by row, as a batch of pairs of long ones would not fit."""
    left = materialize(pruned(pairs, reps, percent))
    wanted = left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct()
    uids = materialize(reps.join(wanted, "id", "left_semi").select("uid", "id"))
    sets = materialize(sets_of(docs, uids, k))
    side = lambda c: sets.select(F.col("id").alias(c), F.col("items").alias(f"items_{c}"))
    x, y, both = F.size("items_a"), F.size("items_b"), F.size(F.array_intersect("items_a", "items_b"))
    paired = left.join(side("a"), "a").join(side("b"), "b").where(100 * F.least(x, y) >= percent * F.greatest(x, y))
    return paired.where(100 * both >= percent * (x + y - both)).select("a", "b")


def blocks(large: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links across components inside large buckets: (bucket, id, comp, n) -> (a, b), a spanning forest a pair of blocks.

    Members outside a bucket's largest component are few after the star step; they alone meet all members, block by block."""
    least = least_matches(percent)
    sizes = large.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), (F.sum("m") - F.max("m")).alias("others"), F.sum("m").alias("held"))
    wanted = materialize(large.select("id").distinct().join(reps, "id").select("uid", "id", "sig"))
    sets = materialize(sets_of(docs, wanted.select("uid", "id"), k))
    block = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int") - 1))
    placed = spread_join(large, main, "bucket", "held", "id").drop("held")
    members = placed.select("bucket", "id", "comp", F.lit(False).alias("other"), block(F.col("n")).alias("p"), every(F.col("others")).alias("q"))
    others = placed.where("comp != main").select("bucket", "id", "comp", F.lit(True).alias("other"), every(F.col("n")).alias("p"), block(F.col("others")).alias("q"))
    rows = members.unionByName(others).join(wanted.select("id", "sig"), "id").join(sets, "id")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group.sig), np.uint32).reshape(-1, BANDS * ROWS)
        items = list(group["items"])
        ids, comp, side = group.id.to_numpy(), group.comp.to_numpy(), group.other.to_numpy()
        inside = np.flatnonzero(~side)
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for i in np.flatnonzero(side).tolist():
            other = inside[comp[inside] != comp[i]]
            for step, m in enumerate(least, 1):
                if len(other):
                    other = other[(sig[other, : step * BATCH] == sig[i, : step * BATCH]).sum(1) >= m]
            for j in other.tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and similar(items[i], items[j], percent):
                    root[max(x, y)] = min(x, y)
                    links.append((int(ids[i]), int(ids[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("bucket", "p", "q").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """(uid, doc_id, n_shingles, component_id, kept, first): one row a row of ``docs``; ``first`` is true for one row a component.
    ``uid_col``: row numbers that hold at every run of the plan, if the rows have them."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), *([F.col(uid_col).alias("uid")] if uid_col else []))
    docs = named if uid_col else numbered(named)
    sketched = materialize(sketch(docs, k))
    some = sketched.where("key is not null")
    # the struct's order puts rows without an id last
    by_key = materialize(some.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("m"), F.min_by("sig", F.struct(F.col("id").isNull(), "id", "uid")).alias("sig")).select("key", F.col("m.id").alias("doc"), "m.uid", "sig"))
    reps = by_key.select(F.col("uid").alias("id"), "uid", "sig")  # rows are linked by their numbers

    def cut(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
            out = np.array([bands(s) for s in sig]).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(out)], names=["id", "bucket"])

    banded = reps.select("id", "sig").mapInArrow(cut, "id long, bucket long")
    shared = materialize(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("center")).where("n > 1"))
    members = materialize(spread_join(banded, shared, "bucket", "n", "id"))
    star = materialize(members.where("id != center").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct())
    links = materialize(verified(star, docs, reps, k, percent))
    comps = components(links)
    labelled = materialize(members.where("n > 2").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("comp")))
    several = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held")).where("lo < hi").select("bucket", "held")
    open_ = materialize(spread_join(labelled, several, "bucket", "held", "id").drop("held"))
    few = open_.where(F.col("n") <= SMALL)
    x, y = few.select("bucket", F.col("id").alias("a"), F.col("comp").alias("ca")), few.select("bucket", F.col("id").alias("b"), F.col("comp").alias("cb"))
    rest = x.join(y, "bucket").where("a > b and ca != cb").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    links = links.union(materialize(verified(materialize(rest), docs, reps, k, percent)))
    many = open_.where(F.col("n") > SMALL)
    if many.limit(1).count():
        links = links.union(materialize(blocks(many, docs, reps, k, percent)))
    ids = by_key.where("doc is not null").select("doc", "uid")
    repeated = ids.join(ids.groupBy("doc").agg(F.min("uid").alias("b"), F.count("*").alias("n")).where("n > 1"), "doc")
    comps = components(links.union(repeated.where("uid != b").select(F.col("uid").alias("a"), "b")))
    # a component is named by its least doc_id, of whose rows the first of each set is kept, or the first of all if it has none
    linked = materialize(by_key.select("key", "doc", "uid").join(comps.select(F.col("node").alias("uid"), "component"), "uid"))
    named = materialize(linked.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "uid")).alias("m")).select("component", F.col("m.doc").alias("component_id"), F.col("m.uid").alias("first_uid")))
    of_key = linked.join(F.broadcast(named) if named.count() <= MOST_IDS else named, "component").select("key", "component_id", F.when(F.col("component_id").isNull(), F.col("first_uid")).otherwise(F.col("uid")).alias("first_uid"))
    roots = by_key.join(of_key, "key", "left").select("key", F.when(F.col("first_uid").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first_uid", "uid").alias("first_uid"))
    joined = some.join(roots, "key").select("uid", "id", "n", "component_id", "first_uid")
    alone = sketched.where("key is null").select("uid", "id", "n", F.col("id").alias("component_id"), F.col("uid").alias("first_uid"))
    kept = F.col("component_id").isNull() | F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return joined.union(alone).select("uid", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), (kept & (F.col("uid") == F.col("first_uid"))).alias("first"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, k=2).select("doc_id", "n_shingles", "component_id", "kept")


def oracle() -> str:
    """The query's rows by brute force in SQL: all pairs of shingle sets that share a shingle."""
    return r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as g from d),
keyed as (select doc_id, g, len(g) as n, md5(array_to_string(list_sort(g), chr(10))) as k from s),
rep as (select k, min(doc_id) as r, any_value(g) as g, any_value(n) as n from keyed where n > 0 group by k),
sh as (select r, n, unnest(g) as h from rep),
common as (select h from sh group by h having count(*) > 1),
held as (select sh.* from sh semi join common using (h)),
p as (select a.r as a, b.r as b, count(*) as i, any_value(a.n) as na, any_value(b.n) as nb from held a join held b on a.h = b.h and a.r < b.r and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by a.r, b.r),
l as (select a, b from p where 100 * i >= 80 * (na + nb - i)),
both_ as (select a, b from l union all select b, a from l),
reach as (select a, b from both_ union select reach.a, both_.b from reach join both_ on reach.b = both_.a),
c as (select r, least(r, coalesce(m, r)) as c from rep left join (select a as r, min(b) as m from reach group by a) using (r))
select doc_id, cast(keyed.n as bigint) as n_shingles, coalesce(c, doc_id) as component_id, coalesce(coalesce(c, doc_id) = doc_id, true) as kept
from keyed left join rep using (k) left join c using (r)"""
