"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at cosine >= c are at Euclidean distance <= eps = sqrt(2 - 2c), and so in any orthonormal projection. Vectors are rotated
onto leading principal dimensions and sorted by their grid cells of width eps there, first dimension first. The length of what is left of
a vector beyond those dimensions is one more coordinate: lengths differ by at most the distance. The sequence is cut into
blocks of bounded size; two blocks meet unless their boxes are provably more than eps apart. Strips of ``STRIP`` neighbouring parts of the
sequence meet in one task, so a block is sent once for all of a strip. Inside a task two intervals are halved
recursively, skipping distant halves, down to leaves that are compared in double precision. A task hands on a count a vector and a
spanning forest of its links, never its pairs.

Equal vectors are folded into the one of least id first, which carries their number: copies cost nothing beyond a group-by.

The principal dimensions are fitted on a bounded sample (``SAMPLE`` vectors); any rotation gives the same links, a good one skips more.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths never link; rows that repeat a vec_id count once, with the greatest vector; rows without vec_id link with nothing, have a null
component and are not kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import components, materialize, table

BLOCK, LEAF, LEADING, SAMPLE, STRIP = 4096, 128, 16, 4096, 4
#: Components in a block: longer vectors make shorter blocks.
CELLS = 1 << 18


def rotation(vectors: DataFrame, dim: int, count: int) -> np.ndarray:
    """dim x leading: principal directions of a bounded sample, the vectors of least hash."""
    span = 1 << 30
    near = min(span, int(span * 2.0 * SAMPLE / max(1, count)) + 1)
    rows = vectors.where(F.pmod(F.xxhash64("id"), F.lit(span)) < near).orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
    x = np.array([r.v for r in rows], float).reshape(len(rows), dim)
    x /= np.linalg.norm(x, axis=1)[:, None]
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))
    return axes[:, np.argsort(values)[::-1][: min(dim, LEADING)]]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = x.astype(float)
    return x / np.linalg.norm(x, axis=1)[:, None]


def coordinates(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Leading coordinates of unit vectors, and the length of the rest: no two are further apart than the vectors."""
    y = u @ axes
    return np.c_[y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))]


def projected(vectors: DataFrame, axes: np.ndarray, eps: float, kind: str) -> DataFrame:
    """(id, m, x, y, cells): the vector in its own precision and its leading coordinates as bytes, and its grid cells."""
    held = vectors.sparkSession.sparkContext.broadcast(axes)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), kind).reshape(batch.num_rows, len(held.value))
            y = coordinates(unit(x), held.value)
            cells = np.floor(y / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([v.tobytes() for v in x]), pa.array([v.tobytes() for v in y]), pa.array(cells.tolist(), pa.list_(pa.int32()))], names=["id", "m", "x", "y", "cells"])

    return vectors.select("id", "m", "v").mapInArrow(run, "id long, m long, x binary, y binary, cells array<int>")


def cut(ordered: DataFrame, width: int, block: int) -> DataFrame:
    """(block, ids, m, x, lo, hi): intervals of the sorted sequence (id, m, x, y), each in one row of bounded size."""
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))

    def run(batches):
        from pyspark import TaskContext

        at, held = TaskContext.get().partitionId() << 32, [[], [], [], []]

        def out(k):
            nonlocal at, held
            ids, m, x, y = (c[:k] for c in held)
            held = [c[k:] for c in held]
            c = np.frombuffer(b"".join(y), float).reshape(-1, width)
            row = [at, np.array(ids, np.int64).tobytes(), np.array(m, np.int64).tobytes(), b"".join(x), c.min(0).tolist(), c.max(0).tolist()]
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["block", "ids", "m", "x", "lo", "hi"])

        for batch in batches:
            for i in range(4):
                held[i] += batch.column(i).to_pylist()
            while len(held[0]) >= block:
                yield out(block)
        if held[0]:
            yield out(len(held[0]))

    return ordered.mapInArrow(run, "block long, ids binary, m binary, x binary, lo array<double>, hi array<double>")


def meet(ids: tuple, m: tuple, u: tuple, y: tuple, least: float, eps: float) -> tuple[np.ndarray, list]:
    """Two intervals, or one with itself: links counted a vector of each, by the numbers ``m`` of vectors that they stand for, and a
    spanning forest of the links."""
    same = len(ids) == 1
    ids_a, ids_b = ids[0], ids[-1]
    a, b = u[0], u[-1]
    shift = 0 if same else len(ids_a)
    label = np.arange(len(ids_a) + (0 if same else len(ids_b)))
    root = label.copy()
    counts = np.zeros(len(label), np.int64)
    every = ids_a if same else np.concatenate([ids_a, ids_b])
    weight = m[0] if same else np.concatenate(m)
    forest = []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    boxes: dict = {}

    def box(side, i, j):
        k = (side, i, j)
        if k not in boxes:
            boxes[k] = (y[side][i:j].min(0), y[side][i:j].max(0))
        return boxes[k]

    stack = [(0, len(a), 0, len(b))]
    last = len(y) - 1
    while stack:
        i0, i1, j0, j1 = stack.pop()
        (lo, hi), (lo2, hi2) = box(0, i0, i1), box(last, j0, j1)
        gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
        if gap @ gap > eps * eps:
            continue
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            hit = a[i0:i1] @ b[j0:j1].T >= least
            if same and i0 == j0:
                hit = np.triu(hit, 1)
            p, q = np.nonzero(hit)
            if len(p):
                p, q = p + i0, q + j0 + shift
                np.add.at(counts, p, weight[q])
                np.add.at(counts, q, weight[p])
                fresh = label[p] != label[q]
                for s, t in zip(p[fresh].tolist(), q[fresh].tolist(), strict=True):
                    x, z = find(s), find(t)
                    if x != z:
                        root[max(x, z)] = min(x, z)
                        forest.append((int(every[s]), int(every[t])))
                for s in np.unique(np.r_[p, q]).tolist():
                    label[s] = find(s)
            continue
        mi, mj = (i0 + i1) // 2, (j0 + j1) // 2
        if same and i0 == j0 and i1 == j1:
            stack += [(i0, mi, i0, mi), (i0, mi, mi, i1), (mi, i1, mi, i1)]
        elif i1 - i0 >= j1 - j0:
            stack += [(i0, mi, j0, j1), (mi, i1, j0, j1)]
        else:
            stack += [(i0, i1, j0, mj), (i0, i1, mj, j1)]
    return counts, forest


def links(vectors: DataFrame, dim: int, count: int, least: float, kind: str) -> DataFrame:
    """(a, b, n): rows with b null count n links of vector a; the others are spanning links."""
    spark = vectors.sparkSession
    eps = math.sqrt(2 - 2 * least) + 1e-9
    axes = rotation(vectors, dim, count)
    width = axes.shape[1] + 1
    block = max(LEAF, min(BLOCK, CELLS // dim))
    parts = max(1, -(-count // block))
    # the id ends the key, so that a vector that fills many rows is still dealt out
    ordered = projected(vectors, axes, eps, kind).repartitionByRange(parts, "cells", "id").sortWithinPartitions("cells", "id").select("id", "m", "x", "y")
    blocks = materialize(cut(ordered, width, block))
    boxes = blocks.select("block", "lo", "hi")
    cells = lambda lo, hi, k, more: F.sequence(F.floor(F.element_at(lo, k) / eps) - more, F.floor(F.element_at(hi, k) / eps) + more)
    near = boxes.select(F.col("block").alias("p"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    own = boxes.select(F.col("block").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    for k in (1, 2):  # a dimension has 2 / eps cells at most
        near = near.withColumn(f"cell{k}", F.explode(cells("lo1", "hi1", k, 1)))
        own = own.withColumn(f"cell{k}", F.explode(cells("lo2", "hi2", k, 0)))
    gaps = F.transform(F.arrays_zip("lo1", "hi1", "lo2", "hi2"), lambda x: F.greatest(F.lit(0.0), x["lo1"] - x["hi2"], x["lo2"] - x["hi1"]))
    pairs = near.join(own, ["cell1", "cell2"]).where("p <= q").where(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= eps * eps).select("p", "q")
    strip = lambda c: F.floor(F.shiftright(c, 32) / STRIP)
    sides = pairs.select(strip("p").alias("p"), strip("q").alias("q"), F.explode(F.array_distinct(F.array("p", "q"))).alias("block")).distinct()
    rows = sides.join(blocks.select("block", "ids", "m", "x"), "block")
    held = spark.sparkContext.broadcast(axes)

    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        strips = (group.block.to_numpy() >> 32) // STRIP
        first, last = int(group.p.iloc[0]), int(group.q.iloc[0])
        ids, m = ([np.frombuffer(x, np.int64) for x in group[c]] for c in ("ids", "m"))
        u = [unit(np.frombuffer(x, kind).reshape(-1, dim)) for x in group.x]
        y = [coordinates(v, held.value) for v in u]
        counts, forest = [np.zeros(len(i), np.int64) for i in ids], []
        for i in np.flatnonzero(strips == first).tolist():
            for j in np.flatnonzero(strips == last).tolist():
                if i == j:
                    n, links_ = meet((ids[i],), (m[i],), (u[i],), (y[i],), least, eps)
                    counts[i] += n
                elif i < j:
                    n, links_ = meet((ids[i], ids[j]), (m[i], m[j]), (u[i], u[j]), (y[i], y[j]), least, eps)
                    counts[i] += n[: len(ids[i])]
                    counts[j] += n[len(ids[i]) :]
                else:
                    continue
                forest += links_
        every, total = np.concatenate(ids), np.concatenate(counts)
        some = total > 0
        return pd.DataFrame({"a": np.r_[every[some], np.array([x for x, _ in forest], np.int64)].astype("int64"), "b": pd.array([None] * int(some.sum()) + [x for _, x in forest], dtype="Int64"), "n": np.r_[total[some], np.zeros(len(forest), np.int64)].astype("int64")})

    return rows.groupBy("p", "q").applyInPandas(task, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row a vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # vectors travel in their own precision; all arithmetic is in double
    kind = "f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    unique = materialize(rows.where("id is not null").groupBy("id").agg(F.max("v").alias("v")))
    # a finite number is equal to itself times zero plus itself; sums of squares catch overflow
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    usable = unique.where(F.col("v").isNotNull() & fine).where((square > 0) & (square != float("inf")))
    reps = materialize(usable.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("m")))
    found = None
    for r in reps.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        one = links(reps.where(F.size("v") == r.dim), r.dim, r.n, least, kind)
        found = one if found is None else found.union(one)
    if found is None:
        counted = unique.select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    else:
        found = materialize(found)
        n = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        comps = components(found.where("b is not null").select("a", "b"))
        linked = reps.join(n, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
        linked = linked.select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
        back = usable.join(linked, "v").select("id", "n", "component")
        counted = unique.select("id").join(back, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("component", "id").alias("component"))
    out = counted.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    nameless = rows.where("id is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("kept"))
    return out.union(nameless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def oracle() -> str:
    """The same by brute force in SQL."""
    return """
with recursive v as (select vec_id, max(cast(embedding as double[])) as e from embeddings where vec_id is not null group by vec_id),
u as (select vec_id, e from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: x * x)) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a)
select v.vec_id, coalesce(n, 0) as n_links, least(v.vec_id, coalesce(c, v.vec_id)) as component_id, least(v.vec_id, coalesce(c, v.vec_id)) = v.vec_id as kept
from v left join (select a as vec_id, count(*) as n from l group by a) using (vec_id) left join (select a as vec_id, min(b) as c from reach group by a) using (vec_id)
union all select null, 0, null, false from embeddings where vec_id is null"""
