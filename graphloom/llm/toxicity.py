"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of each hashed 3- to 5-gram of the lower-cased text is counted per class over a bounded sample of labelled rows
(``per_class`` a class); the log ratio of the smoothed class rates scales the feature. Logistic weights on those scaled features are
fitted on about ``sample`` of these rows, balanced, and the intercept is moved back to the odds of all labels. N-grams of weak log ratio
are left out, as thousands of them add up in very long texts: the least ratio is the one of ``RATIOS`` with the least log loss on an
inner fold, a fifth of the sampled training rows by hash, that the ratios and weights for this choice leave out.

Defined results: an id labelled both ways teaches nothing, and of a labelled id's texts the least one teaches; null and empty texts score the intercept alone; without labelled rows of both classes every score is 0.0; repeated
rows are scored each on its own; columns other than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import agreed, fold, map_text, materialize, table

BITS, NS = 20, (3, 4, 5)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
#: Characters hashed at a time; texts longer than this are cut with an overlap, so no n-gram is lost.
CHUNK = 1 << 17


def buckets(text: bytes):
    """Arrays of hashed n-grams of one text, chunk by chunk; repeats are not removed."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    for at in range(0, max(1, len(points)), CHUNK):
        g = points[at : at + CHUNK + NS[-1] - 1].astype(np.uint64)
        c, first = g, g
        for n in range(2, NS[-1] + 1):
            if len(first) < n:
                break
            g = g[:-1] * _BASE + c[n - 1 :]
            if n >= NS[0]:
                yield ((g * _MULT) >> np.uint64(64 - BITS)).astype(np.int64)


#: Least absolute log ratios tried.
RATIOS = (0.5, 1.0, 1.5, 2.0)


def count_classes(labelled: DataFrame) -> DataFrame:
    """(inner, y, t) -> (inner, bucket, n0, n1): documents of each fold and class that hold the bucket; bucket -1 counts the documents."""

    def run(batches):
        counts = np.zeros((2, 2, (1 << BITS) + 1), np.int32)  # the last place counts documents
        seen = np.zeros((1 << BITS) + 1, bool)
        for batch in batches:
            for inner, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                for b in buckets(text or b""):
                    seen[b] = True
                seen[-1] = True
                u = np.flatnonzero(seen)
                counts[int(inner), label, u] += 1
                seen[u] = False
        for inner in (0, 1):
            u = np.flatnonzero(counts[inner].any(0))
            bucket = np.where(u == 1 << BITS, -1, u)
            yield pa.RecordBatch.from_arrays([pa.array([bool(inner)] * len(u), pa.bool_()), pa.array(bucket), *(pa.array(counts[inner, y, u].astype(np.int64)) for y in (0, 1))], names=["inner", "bucket", "n0", "n1"])

    rows = labelled.select("inner", "y", "t").repartition(16)  # a bounded sample
    return rows.mapInArrow(run, "inner boolean, bucket long, n0 long, n1 long").groupBy("inner", "bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def picked(docs: DataFrame, labels: DataFrame, odds: dict, id_col: str, text_col: str, per_class: int) -> DataFrame:
    """(i, y, t, inner) of at most ``per_class`` labelled ids a class, the smallest by hash, one row an id. The ids are broadcast, so no other
    text is shuffled. The hash is cut near the quantile first, so the ordering sees about ``per_class`` ids whatever the number of labels."""
    span = 1 << 30
    near = {y: min(span, int(span * (1.2 * per_class + 1000) / odds.get(y, 1))) for y in (0, 1)}
    hashed = F.pmod(F.xxhash64("i"), F.lit(span))
    one = [labels.where((F.col("y") == y) & (hashed < near[y])).orderBy(hashed, "i").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    held = texts.join(F.broadcast(one[0].union(one[1])), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
    return held.withColumn("inner", F.pmod(F.xxhash64("i", F.lit(2)), F.lit(5)) == 0)


def features_of(counts: DataFrame, features: int, min_docs: int, least: float) -> tuple[np.ndarray, np.ndarray, tuple[int, int]] | None:
    """(a feature a bucket or 0, its log ratio, documents a class): the ``features`` buckets of largest gain with a log ratio of ``least``."""
    totals = counts.where("bucket = -1").collect()
    if not totals or not totals[0].n0 or not totals[0].n1:
        return None
    d0, d1 = totals[0].n0, totals[0].n1
    ratio = F.log((F.col("n1") + 1.0) / (d1 + 2.0)) - F.log((F.col("n0") + 1.0) / (d0 + 2.0))
    best = (
        counts.where((F.col("bucket") >= 0) & (F.col("n0") + F.col("n1") >= min_docs))
        .select("bucket", ratio.alias("r"), (F.abs(ratio) * F.sqrt(F.col("n0") / d0 + F.col("n1") / d1)).alias("gain"))
        .where(F.abs("r") >= least)
        .orderBy(F.desc("gain"), "bucket")
        .limit(features)
        .collect()
    )
    index, r = np.zeros(1 << BITS, np.int32), np.zeros(len(best) + 1)
    for k, row in enumerate(best, 1):
        index[row.bucket], r[k] = k, row.r
    return index, r, (d0, d1)


def held_features(text: bytes | None, index: np.ndarray) -> np.ndarray:
    """The distinct features of a whole text."""
    found = [k[k > 0] for b in buckets(text or b"") for k in (index[b],)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def sampled(rows: DataFrame, index: np.ndarray, docs: tuple[int, int], sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The feature sets and labels of about ``sample`` rows, half a class."""
    held = rows.sparkSession.sparkContext.broadcast(index)
    make = lambda: lambda texts: [pa.array([held_features(t, held.value).astype(np.int32).tobytes() for t in texts], pa.binary())]
    span = 1 << 30
    share = F.when(F.col("y") == 1, F.lit(sample / 2 / docs[1])).otherwise(F.lit(sample / 2 / docs[0]))
    chosen = rows.where(F.pmod(F.xxhash64("i", F.lit(1)), F.lit(span)) < share * span)
    got = map_text(chosen, F.col("t"), make, "f binary", {"y": F.col("y")}).collect()
    return [np.frombuffer(row.f, np.int32) for row in got], np.array([row.y for row in got], float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 12_000, features: int = 16384, sample: int = 4000, min_docs: int = 3, ratios: tuple = RATIOS, l2: float = 1e-3, rounds: int = 80) -> dict | None:
    """The model: a bucket-to-feature table, a weight a feature and an intercept; None without rows of both classes.

    The fit takes a bounded sample of the labelled rows: ``per_class`` ids a class for the ratios, about ``sample`` of those rows, half
    a class, for the weights. The ``features`` buckets of largest gain are kept, which bounds the model's size."""
    known = agreed(labels, id_col, label_col).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    odds = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = materialize(picked(docs, known, odds, id_col, text_col, per_class))
    counts = materialize(count_classes(rows))
    least = _least_ratio(rows, counts, features, sample, min_docs, ratios, l2, rounds)
    found = features_of(counts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), features, min_docs, least)
    if found is None:
        return None
    index, r, docs_ = found
    sets, y = sampled(rows, index, docs_, sample)
    w, b = _logistic(sets, y, r, l2, rounds)
    shift = np.log(odds[1] / odds[0]) - np.log(max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5))
    return {"index": index, "weight": w * r, "bias": float(b + shift)}


def _least_ratio(rows: DataFrame, counts: DataFrame, features: int, sample: int, min_docs: int, ratios: tuple, l2: float, rounds: int) -> float:
    """The ratio whose model, learnt outside the inner fold, has the least log loss on it; both classes weigh the same."""
    found = features_of(counts.where("not inner"), features, min_docs, min(ratios)) if len(ratios) > 1 else None
    if found is None:
        return ratios[0]
    index, r, docs = found
    sets, y = sampled(rows.where("not inner"), index, docs, sample)
    weights, bias = [], []
    for least in ratios:
        kept = np.abs(r) >= least
        w, b = _logistic([s[kept[s]] for s in sets], y, r, l2, rounds)
        weights.append(w * r * kept)
        bias.append(b)
    held = rows.sparkSession.sparkContext.broadcast((index, np.array(weights), np.array(bias)))

    def make():
        index_, w_, b_ = held.value
        return lambda texts: [pa.array([(b_ + w_[:, held_features(t, index_)].sum(1)).tolist() for t in texts], pa.list_(pa.float64()))]

    z = map_text(rows.where("inner"), F.col("t"), make, "z array<double>", {"y": F.col("y")})
    loss = lambda k: F.avg(F.log1p(F.exp(F.least(F.lit(50.0), F.when(F.col("y") == 1, -F.get("z", F.lit(k))).otherwise(F.get("z", F.lit(k)))))))
    of = z.groupBy("y").agg(*(loss(k).alias(f"l{k}") for k in range(len(ratios)))).collect()
    return ratios[int(np.argmin([sum(row[f"l{k}"] for row in of) for k in range(len(ratios))]))] if of else ratios[0]


def _logistic(sets: list[np.ndarray], y: np.ndarray, r: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the scaled presence features; weights start at the naive Bayes solution's direction."""
    if not sets:
        return np.zeros_like(r), 0.0
    idx = np.concatenate(sets) if sets else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    w, b = np.full(len(r), 0.05), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=(w * r)[idx], minlength=len(sets)) + b
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.bincount(idx, weights=e[row], minlength=len(r)) * r / len(sets) + l2 * w
        gb = e.mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= 0.02 * c * m / (np.sqrt(v) + 1e-8)
        b -= 0.05 * c * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def score(docs: DataFrame, model: dict | None, keep: dict, text_col: str = "text") -> DataFrame:
    """``keep`` columns plus score: the probability of label 1 from the whole text."""
    if model is None:
        return docs.select(*(c.alias(n) for n, c in keep.items()), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        index, weight, bias = m["index"], m["weight"], m["bias"]

        def run(texts):
            z = np.array([bias + weight[held_features(t, index)].sum() for t in texts])
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))]

        return run

    return map_text(docs, F.col(text_col), make, "score double", keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit(docs, labels.where(~held_out))
    scored = score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
