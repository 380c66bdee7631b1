"""Quality: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a Gaussian over the statistics; its covariance is shrunk towards the pooled one, its diagonal and a scaled identity. The
score is the logistic of the log-density difference plus the class log odds; Mahalanobis distances come from Cholesky factors that are
computed once and kept in the model. Means and covariances are summed over all labelled training rows. The shares of the shrinkage are
those of ``SHARES`` with the least log loss on an inner fold, a fifth of the training rows by hash, that the moments for this choice leave out.

Defined results: an id labelled both ways teaches nothing; null and empty texts have the statistics of no words and are scored like any text; without labelled rows of both
classes every score is 0.0; repeated rows are scored each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import agreed, fold, map_text, materialize, table

STATS = ("log_words", "word_length", "distinct_words", "upper", "symbols", "stops", "digits", "top_word", "repeats", "repeated_lines", "line_words", "compression")
_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower or non-ASCII, 3 digit, 4 space, 5 sentence marks, 6 other marks
_KIND[33:127] = 6
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-"]] = 5


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one whole text, each of order one and finite for any text."""
    text = text or b""
    counts = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=7)
    solid = max(1.0, counts.sum() - counts[4])
    words = text.lower().split()
    n = len(words)
    of: dict[bytes, int] = {}
    for w in words:
        of[w] = of.get(w, 0) + 1
    lines = text.split(b"\n")
    full = [x for x in lines if x]
    rate = lambda x: math.log((x + 0.5) / (solid + 1.0))
    return [
        math.log1p(n),
        math.log1p(solid / max(1, n)),
        math.log((len(of) + 1) / (n + 1)) / math.log(n + 3),
        rate(counts[1]),
        rate(counts[6]),
        rate(counts[5]),
        rate(counts[3]),
        math.log((max(of.values(), default=0) + 1) / (n + 2)),
        math.log((sum(a == b for a, b in zip(words, words[1:], strict=False)) + 0.5) / (n + 1)),
        math.log((len(full) - len(set(full)) + 0.5) / (len(full) + 1)),
        math.log1p(n / max(1, len(full))),
        math.log((sum(len(zlib.compress(text[i : i + 4096], 1)) for i in range(0, max(1, len(text)), 4096)) + 16) / (len(text) + 16)),
    ]


def measure(docs: DataFrame, keep: dict, text_col: str = "text") -> DataFrame:
    """``keep`` columns plus stats: the statistics of the whole text, in the order of STATS."""
    return map_text(docs, F.col(text_col), lambda: lambda texts: [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], "stats array<double>", keep)


#: Shares tried: of the pooled covariance, of the own diagonal and of the mean variance.
SHARES = tuple((p, d, i) for p in (0.1, 0.3, 0.6) for d in (0.02, 0.2) for i in (0.02, 0.1))


def moments(rows: DataFrame) -> DataFrame:
    """(inner, y, i, j, total): sums of products of statistics per fold and class; index -1 stands for one."""
    first = rows.select("inner", "y", F.concat(F.array(F.lit(1.0)), F.col("stats")).alias("x")).select("inner", "y", "x", F.posexplode("x").alias("i", "a"))
    return first.select("inner", "y", "i", "a", F.posexplode("x").alias("j", "b")).where("j >= i").groupBy("inner", "y", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("total"))


def discriminant(sums: np.ndarray, shares: tuple[float, float, float]) -> dict | None:
    """The model of summed moments (class, k + 1, k + 1)."""
    k, n = sums.shape[1] - 1, sums[:, 0, 0]
    if min(n) < 1:
        return None
    pooled, diagonal, identity = shares
    total = sums.sum(0)
    spread = np.sqrt(np.maximum(np.diag(total)[1:] / n.sum() - (total[0, 1:] / n.sum()) ** 2, 1e-6))
    means = [sums[y, 0, 1:] / n[y] / spread for y in (0, 1)]
    covs = [sums[y, 1:, 1:] / n[y] / np.outer(spread, spread) - np.outer(means[y], means[y]) for y in (0, 1)]
    both = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    model = {"scale": spread, "mean": [], "chol": [], "const": []}
    for y in (0, 1):
        cov = (1 - pooled) * covs[y] + pooled * both
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov))
        cov = (1 - identity) * cov + identity * max(np.trace(cov) / k, 1e-3) * np.eye(k) + 1e-6 * np.eye(k)
        chol = np.linalg.cholesky(cov)
        model["mean"].append(means[y])
        model["chol"].append(np.linalg.inv(chol))
        model["const"].append(math.log(n[y] / n.sum()) - np.log(np.diag(chol)).sum())
    return model


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density differences of rows of statistics."""
    log = []
    for mean, factor, const in zip(model["mean"], model["chol"], model["const"], strict=True):
        log.append(const - (((x / model["scale"] - mean) @ factor.T) ** 2).sum(1) / 2)
    return log[1] - log[0]


def losses(rows: DataFrame, models: list[dict]) -> list[float]:
    """The summed log loss of each model over rows (y, stats)."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        out = np.zeros(len(held.value))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(y), len(STATS))
            for k, m in enumerate(held.value):
                out[k] += np.logaddexp(0, np.where(y == 1, -1, 1) * log_odds(m, x)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["k", "loss"])

    summed = rows.select("y", "stats").mapInArrow(run, "k long, loss double").groupBy("k").agg(F.sum("loss").alias("loss"))
    return [r.loss for r in summed.orderBy("k").collect()]


def fit(measured: DataFrame, label_col: str = "quality", id_col: str = "__id", shares=SHARES) -> dict | None:
    """The model of labelled rows (id, label, stats)."""
    rows = materialize(measured.where(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("y"), "stats", (F.pmod(F.xxhash64(id_col), F.lit(5)) == 0).alias("inner")))
    k = len(STATS)
    sums = np.zeros((2, 2, k + 1, k + 1))
    for row in moments(rows).collect():  # 2 (k+1)(k+2) rows
        at = sums[int(row.inner), row.y]
        at[row.i, row.j] = at[row.j, row.i] = row.total
    chosen = shares[0]
    outer = [discriminant(sums[0], s) for s in shares] if len(shares) > 1 else [None]
    if None not in outer and sums[1, :, 0, 0].sum() >= 1:
        chosen = shares[int(np.argmin(losses(rows.where("inner"), outer)))]
    return discriminant(sums.sum(0), chosen)


def score(measured: DataFrame, model: dict | None) -> DataFrame:
    """Replace stats by score, the probability of label 1 (good): the logistic of the difference of log densities."""
    if model is None:
        return measured.withColumn("score", F.lit(0.0)).drop("stats")
    log = []
    for mean, factor, const in zip(model["mean"], model["chol"], model["const"], strict=True):
        scaled = factor / model["scale"]  # one product a statistic: the inverse Cholesky factor on the unscaled statistics
        shift = factor @ mean
        distance = sum((F.pow(sum((F.element_at("stats", j + 1) * float(scaled[i, j]) for j in range(i + 1)), F.lit(-float(shift[i]))), F.lit(2.0)) for i in range(len(STATS))), F.lit(0.0))
        log.append(F.lit(float(const)) - distance / 2)
    return measured.withColumn("score", 1 / (1 + F.exp(log[0] - log[1]))).drop("stats")


#: The least score of a text predicted good.
GOOD = 0.7


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: dict) -> DataFrame:
    """Each text is measured once; the written statistics, a few bytes a document, feed both the fit and the scores. Only they meet
    the labels in a shuffle, never the texts."""
    keep = {**keep, "__id": F.col("doc_id"), "__train": fold(F.col("doc_id"), 4) != 2}
    measured = materialize(measure(docs, keep))
    labels = agreed(table(spark, sf_dir, "labels"), "doc_id", "quality").withColumnRenamed("doc_id", "__id")
    model = fit(measured.where("__train").select("__id", "stats").join(labels, "__id"))
    return score(measured.drop("__id", "__train"), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(spark, docs, sf_dir, {"doc_id": F.col("doc_id"), "held_out": fold(F.col("doc_id"), 4) == 2})
    return out.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
