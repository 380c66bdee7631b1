"""Language-model scores: a document's marginal probability over all subword segmentations.

Tokens are the words between ASCII white space, A-Z lower-cased, and one end a text. The existing vocabulary's scores weigh all
segmentations, and the forward recursion in log space sums those of each word. No piece spans two words, so a text's marginal is the
product of its words' and the end's: that is ``score`` of the operator. The vocabulary and its scores are never changed.

``adapted_score`` is a second model on top, which learns from the training rows: each word's lattice gets a whole-word arc weighted by
the discounted count,

    P(w) = max(c - D, 0) / N  +  (D V / N) * P_lattice(w),   D = n1 / (n1 + 2 n2)

with N, V, n1 and n2 the training tokens, distinct tokens, and those seen once and twice. This sums to one over all words.

``learned_score``, the query's score, is the same with two more things learned. The lattice's pieces weigh by how often they lie on the
shortest paths of the distinct training tokens, ``OWN`` of the weight kept as it was. And a text's tokens are drawn from an urn that holds
``URN`` tokens as P has them and each token of the text drawn before, so words that a text repeats are likelier; the product over a text
doesn't depend on the order, and sums to one over all texts.

Counts cover all training rows. The tokens that occur most in all rows (about ``frequent_tokens`` at most) are resolved in place; each
of the others is rare, in training rows or not, so joining on the token meets no hot key; every token of every text is counted exactly.

Defined results: tokens are compared byte by byte, and bytes that are no UTF-8 go through the lattice as U+FFFD; null and empty texts have the end token alone; with nothing to learn from, base_score is 0.0 and the adapted score is
the lattice's; repeated rows are scored each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, fold, materialize, most_frequent, numbered, table
from graphloom.llm.pieces import Pieces
from graphloom.llm.sentencepiece import MODEL

END, FLUSH = b"", 200_000
#: Share of the pieces' own weights beside their training counts; tokens of the corpus in a text's urn.
OWN, URN = 0.01, 1000.0
LOG_URN = math.log10(URN)


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, and the end."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def count_tokens(docs: DataFrame) -> DataFrame:
    """docs: text, train boolean -> (token, c, t): occurrences in training rows and in all rows."""

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())  # of other rows, of training rows

        def out():
            words = list(counts[0].keys() | counts[1].keys())
            c = np.fromiter((counts[1][w] for w in words), np.int64, len(words))
            other = np.fromiter((counts[0][w] for w in words), np.int64, len(words))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(c + other)], names=["token", "c", "t"])

        for batch in batches:
            for part in by_bytes(batch):
                for train, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    counts[bool(train)].update(tokens(text))
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield out()
                    for held in counts:
                        held.clear()
        yield out()

    return docs.select("train", "text").mapInArrow(run, "token binary, c long, t long").groupBy("token").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def piece_logs(counts: DataFrame, model_path: str) -> np.ndarray | None:
    """Log weights of the pieces from the shortest paths of the distinct training tokens; None with nothing to learn from. At most a row a
    piece reaches the driver."""
    held = counts.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches):
        pieces = Pieces.of(held.value)
        seen = np.zeros(len(pieces.log), np.int64)
        for batch in batches:
            ids = b"".join(pieces.paths([f" {w.decode('utf-8', 'replace')}" for w in batch.column(0).to_pylist()]))
            seen += np.bincount(np.frombuffer(ids, np.uint32), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["id", "k"])

    rows = counts.where((F.col("c") > 0) & (F.octet_length("token") > 0)).select("token").mapInArrow(run, "id long, k long").groupBy("id").agg(F.sum("k").alias("k")).collect()
    if not rows:
        return None
    pieces = Pieces.of(held.value)
    seen, own = np.zeros(len(pieces.log)), np.exp(pieces.log)
    seen[[r.id for r in rows]] = [r.k for r in rows]
    words = own.sum()  # what the end leaves
    with np.errstate(divide="ignore"):
        return np.log((1 - OWN) * words * seen / seen.sum() + OWN * own)


def with_lattice(counts: DataFrame, model_path: str, logs: np.ndarray | None) -> DataFrame:
    """Add lat and learned: log10 of the lattice's marginal of each distinct token, by the pieces' own weights and by ``logs``."""
    held = counts.sparkSession.sparkContext.broadcast((Path(model_path).read_bytes(), logs))

    def run(batches):
        model, learned = held.value
        pieces = Pieces.of(model)
        for batch in batches:
            words = batch.column(0).to_pylist()
            texts, end = [w.decode("utf-8", "replace") for w in words], [not w for w in words]
            both = []
            for weights in (None, learned):
                lat = pieces.marginals(texts, weights) if weights is not None or not both else both[0].copy()
                lat[end] = pieces.end_log / math.log(10)
                both.append(lat)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, both)], names=["token", "c", "t", "lat", "learned"])

    return counts.mapInArrow(run, "token binary, c long, t long, lat double, learned double")


def score(docs: DataFrame, train, keep: dict, text_col: str = "text", model_path: str = MODEL, frequent_tokens: int = 60_000) -> DataFrame:
    """``keep`` columns plus n_tokens, n_known, train_tokens, base_score, score, adapted_score and learned_score; ``train`` marks training rows."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(c.alias(n) for n, c in keep.items())).alias("kept"), train.alias("train"), F.col(text_col).cast("string").alias("text"))
    counts = materialize(count_tokens(rows))
    vocabulary = materialize(with_lattice(counts, model_path, piece_logs(counts, model_path)))
    n, v, n1, n2 = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    floor = n + 0.1 * (v + 1)
    weight = math.log10(discount * v / n) if n else 0.0
    often = most_frequent(vocabulary, "t", frequent_tokens, "token")
    common = {bytes(r.token): (int(r.c), r.lat, r.learned) for r in vocabulary.where(often).collect()}  # about frequent_tokens rows at most

    def logs(c: int, lat: float, learned: float) -> tuple[float, float, float, float]:
        adapted = [weight + x if c <= discount else math.log10((c - discount) / n + 10 ** max(weight + x, -320.0)) for x in (lat, learned)]
        return math.log10((c + 0.1) / floor), lat, *adapted

    held = spark.sparkContext.broadcast({w: (*logs(*x), int(x[0] > 0)) for w, x in common.items()})
    ln10 = math.log(10)

    def run(batches):
        known = held.value
        for batch in batches:
            for part in by_bytes(batch):
                uid, word, times, n_tokens, n_known, base, model, adapted, urn = [], [], [], [], [], [], [], [], []

                def put(*x, to=(uid, word, times, n_tokens, n_known, base, model, adapted, urn)):
                    for column, value in zip(to, x, strict=True):
                        column.append(value)

                for u, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    b = m = a = 0.0
                    k = 0
                    words = tokens(text)
                    drawn = (math.lgamma(URN) - math.lgamma(len(words) + URN)) / ln10
                    for w, times_ in Counter(words).items():
                        of = known.get(w)
                        if of is None:
                            put(u, w, times_, 0, 0, 0.0, 0.0, 0.0, 0.0)
                        else:
                            k += times_ * of[4]
                            b += times_ * of[0]
                            m += times_ * of[1]
                            a += times_ * of[2]
                            drawn += of[3] + LOG_URN
                            if times_ > 1:
                                in_urn = URN * 10 ** max(of[3], -300.0)
                                drawn += (math.lgamma(in_urn + times_) - math.lgamma(in_urn + 1)) / ln10
                    # a text's own row has a token that no text holds, so it joins nothing and is dealt out evenly
                    put(u, b" %d" % u, 0, len(words), k, b, m, a, drawn)
                arrays = [pa.array(uid, pa.int64()), pa.array(word, pa.binary()), *(pa.array(x, pa.int64()) for x in (times, n_tokens, n_known)), *(pa.array(x, pa.float64()) for x in (base, model, adapted, urn))]
                yield pa.RecordBatch.from_arrays(arrays, names=["uid", "token", "times", "n_tokens", "n_known", "base", "model", "adapted", "urn"])

    numbered_ = numbered(rows)
    parts = numbered_.select("uid", "text").mapInArrow(run, "uid long, token binary, times long, n_tokens long, n_known long, base double, model double, adapted double, urn double")
    rare = vocabulary.where(~often)
    c, lat, learned = F.coalesce("c", F.lit(0)), F.coalesce("lat", F.lit(0.0)), F.coalesce("learned", F.lit(0.0))
    rare_base = F.log10((c + 0.1) / F.lit(floor))
    rare_adapted, rare_learned = (F.when(c <= discount, F.lit(weight) + x).otherwise(F.log10((c - F.lit(discount)) / F.lit(float(max(n, 1))) + F.pow(F.lit(10.0), F.lit(weight) + x))) for x in (lat, learned))
    in_urn = F.lit(URN) * F.pow(F.lit(10.0), rare_learned)
    again = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("times") - 1), F.lit(0.0), lambda sum_, j: sum_ + F.log10(j + in_urn))
    rare_drawn = F.when(F.col("times") == 0, 0.0).when(F.col("times") == 1, rare_learned + LOG_URN).otherwise(rare_learned + LOG_URN + again)
    summed = (
        parts.join(rare, "token", "left")
        .groupBy("uid")
        .agg(
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.col("times") * rare_base).alias("base_score"),
            F.sum(F.col("model") + F.col("times") * lat).alias("score"),
            F.sum(F.col("adapted") + F.col("times") * rare_adapted).alias("adapted_score"),
            F.sum(F.col("urn") + rare_drawn).alias("learned_score"),
        )
    )
    return numbered_.select("uid", "kept").join(summed, "uid").select("kept.*", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "adapted_score", "learned_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 10) == 0
    scored = score(docs, ~held_out, {"doc_id": F.col("doc_id"), "held_out": held_out}).withColumnRenamed("score", "lattice_score")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("learned_score").alias("score"), "lattice_score", "adapted_score")
