"""Ranked lexical search: WAND over the postings of each document shard, and the shards' heaps merged.

``index`` cuts documents into terms, in Arrow batches, and writes postings by shard and term: a shard is what one task gathers until it
holds ``shard_postings`` postings, whatever the rows. Terms are sorted in each file, so a search reads the row groups of its terms alone.

``search`` takes queries in blocks of a bounded number of terms. Document frequencies and sizes come from the index, over all
documents; a block's terms are broadcast, their postings go to their shards, and each shard answers all queries of the block:

* each term has the largest impact it has in the shard, times its weight: its bound;
* exact scores of some documents of the lists of largest bounds give a first threshold for the heap of the ``most`` best;
* pivots are the documents where the bounds of the lists that they stand in reach the threshold. All of a shard's are found at once, with
  arrays: lists whose bounds together don't reach it need not be walked, they are only looked up at documents of the others;
* pivots are scored in the order of documents, some at a time, and enter the heap; those that its threshold has passed by then are skipped.

Heaps of the shards, ``most`` rows a query each, meet in one aggregate. Scores are whole numbers and exact.

Defined results: documents and queries that are null or hold no term find nothing and count for nothing; documents of the same id or text
rank each by itself; equal scores go by rising id, null ids last; an empty table on either side gives an empty result; a query's
term that no document holds adds nothing; bytes that are no UTF-8 are parts of terms as they are; extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import LOWER, UPPER, by_bytes, materialize, numbered, release, table

MOST = 10
#: Postings of a shard, about; terms of a block of queries.
SHARD_POSTINGS, BLOCK_TERMS = 3_000_000, 50_000
#: Everything but ASCII letters and digits and bytes beyond ASCII becomes a blank, and A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(shard, term, n, total, docs, tfs, ids) by shard and term, written to the shared folder: the number of documents and occurrences, and both
    lists, with documents by their number in the shard. The row without a term has the shard's documents: their ids and, as ``tfs``, their sizes."""

    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0

        def out():
            codes_, docs_, tfs_ = (np.frombuffer(x, np.int32) for x in (codes, numbers, tfs))
            words = list(of)
            rank = np.empty(len(words), np.int64)
            order = sorted(range(len(words)), key=words.__getitem__)
            rank[order] = np.arange(len(words))
            by = np.argsort(rank[codes_], kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(rank[codes_], minlength=len(words)))]).astype(np.int32)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values[by]))
            n, at = len(words), part << 24 | shard
            counts, sums = np.diff(ends), np.diff(np.concatenate([[0], np.cumsum(tfs_[by], dtype=np.int64)])[ends])
            names = ["shard", "term", "n", "total", "docs", "tfs", "ids"]
            head = [pa.array([at]), pa.array([None], pa.binary()), pa.array([len(ids)], pa.int32()), pa.array([sum(sizes)]), pa.array([None], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*head, pa.array([sizes], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64()))], names=names)
            for k in range(0, n, 50_000):
                m = min(50_000, n - k)
                held = [pa.array(np.full(m, at)), pa.array([words[i] for i in order[k : k + m]], pa.binary()), pa.array(counts[k : k + m]), pa.array(sums[k : k + m])]
                yield pa.RecordBatch.from_arrays([*held, lists(docs_).slice(k, m), lists(tfs_).slice(k, m), pa.nulls(m, pa.list_(pa.int64()))], names=names)

        def fresh():
            return {}, array("i"), array("i"), array("i"), [], []

        of, codes, numbers, tfs, ids, sizes = fresh()
        for batch in batches:
            for some in by_bytes(batch):
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    words = terms(text)
                    if not words:
                        continue
                    held = Counter(words)
                    codes.extend([of.setdefault(w, len(of)) for w in held])
                    tfs.extend(held.values())
                    numbers.extend([len(ids)] * len(held))
                    ids.append(doc_id)
                    sizes.append(len(words))
                    if len(codes) >= shard_postings:
                        yield from out()
                        of, codes, numbers, tfs, ids, sizes = fresh()
                        shard += 1
        if ids:
            yield from out()
        release()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(source.mapInArrow(run, "shard long, term binary, n int, total long, docs array<int>, tfs array<int>, ids array<long>"))


class Shard:
    """The documents of one shard and the postings of a block's terms."""

    SOME, STEP = 500, 64

    def __init__(self, ids: list, sizes: np.ndarray, n: int, total: int) -> None:
        self.ids = ids
        self.slow = 8 * (25 + 75 * sizes.astype(np.int64) * n // total)
        self.lists: dict[bytes, tuple[np.ndarray, np.ndarray, int]] = {}

    def add(self, term: bytes, docs: np.ndarray, tfs: np.ndarray) -> None:
        tf = tfs.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + self.slow[docs])
        self.lists[term] = docs, impact, int(impact.max())

    def key(self, doc: int) -> tuple:
        """The order among equal scores, the later the less."""
        held = self.ids[doc]
        return (0, 0, -doc) if held is None else (1, -held, -doc)

    def search(self, query: dict[bytes, int], most: int) -> list[tuple[int, int]]:
        """(score, document), at most ``most``, by WAND. ``query`` has the weight of each term, times its repeats."""
        held = [(*self.lists[t], w) for t, w in query.items() if w > 0 and t in self.lists]
        held.sort(key=lambda x: x[2] * x[3])
        bounds = np.array([top * w for _, _, top, w in held], np.int64)
        least = self._floor(held, most)
        upto = np.cumsum(bounds)
        pivot = int(np.searchsorted(upto, least))  # a document of the lists before it alone can't reach the threshold
        if pivot == len(held):
            return []
        reach = np.zeros(len(self.ids), np.int64)
        for (docs, *_), bound in zip(held[pivot:], bounds[pivot:], strict=True):
            reach[docs] += bound
        pivots = np.flatnonzero(reach).astype(np.int32)
        reach = reach[pivots]
        for k in range(pivot - 1, -1, -1):  # the bounds of lists further down are what they could add yet
            kept = reach + upto[k] >= least
            pivots, reach = pivots[kept], reach[kept]
            reach += bounds[k] * (_at(held[k][0], pivots) >= 0)
        kept = reach >= least
        pivots, reach, heap = pivots[kept], reach[kept], []
        for begin in range(0, len(pivots), self.STEP):
            some = pivots[begin : begin + self.STEP]
            some = some[reach[begin : begin + self.STEP] >= least]
            for score, doc in zip(_scores(held, some).tolist(), some.tolist(), strict=True):
                entry = (score, self.key(doc), doc)
                if score < least:
                    continue
                if len(heap) < most:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == most:
                    least = heap[0][0]
        return [(score, doc) for score, _, doc in heap]

    def _floor(self, held: list, most: int) -> int:
        """A score that ``most`` documents reach, 1 at least."""
        chosen: list[np.ndarray] = []
        for docs, *_ in reversed(held):
            chosen.append(docs)
            if sum(map(len, chosen)) >= self.SOME:
                break
        at = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int32)
        return max(1, int(np.partition(_scores(held, at), -most)[-most])) if len(at) >= most else 1


def _at(docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted document in a list, or -1."""
    k = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[k] == wanted, k, -1)


def _scores(held: list, docs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(docs), np.int64)
    for of, impact, _, w in held:
        k = _at(of, docs)
        out += np.where(k >= 0, impact[k], 0) * w
    return out


def asked(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """queries: uid, and text -> (uid, term, repeats)."""

    def run(batches):
        for batch in batches:
            for some in by_bytes(batch):
                for uid, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    held = Counter(terms(text))
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([uid] * len(held), pa.int64()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["uid", "term", "repeats"])

    return queries.select("uid", F.col(text_col).cast("string")).mapInArrow(run, "uid long, term binary, repeats long")


def search(held: DataFrame, queries: DataFrame, most: int = MOST, query_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query_col, rank, doc_id, score) of an index: the ``most`` best documents of each query. A block holds whole queries, dealt by hash, of
    about ``block_terms`` terms together."""
    n, total = held.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    numbered_ = numbered(queries.select(query_col, text_col))
    wanted = materialize(asked(numbered_, text_col))
    blocks = max(1, -(-wanted.count() // block_terms))
    best = [_block(held, wanted.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b), n, total, most) for b in range(blocks)]
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "doc")
    ranked = functools.reduce(DataFrame.union, best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return numbered_.select("uid", query_col).join(ranked, "uid").select(query_col, "rank", "doc_id", "score")


def _block(held: DataFrame, wanted: DataFrame, n: int, total: int, most: int) -> DataFrame:
    """(uid, shard, doc, doc_id, score): the best of each shard for the queries of one block."""
    spark = held.sparkSession
    terms_ = F.broadcast(wanted.select("term").distinct())  # of one block
    df = {bytes(r.term): r.df for r in held.where("term is not null").select("term", "n").join(terms_, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).collect()}
    queries: dict[int, dict[bytes, int]] = {}
    for r in wanted.collect():
        term = bytes(r.term)
        if term in df:
            queries.setdefault(r.uid, {})[term] = r.repeats * math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
    sent = spark.sparkContext.broadcast(queries)

    def run(group: pa.Table) -> pa.Table:
        at = group.column("term").combine_chunks()
        head = int(np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))[0])
        ids = group.column("ids")[head].as_py()
        shard = Shard(ids, group.column("tfs")[head].values.to_numpy(), n, total)
        for term, docs, tfs in zip(at.to_pylist(), group.column("docs"), group.column("tfs"), strict=True):
            if term is not None:
                shard.add(term, docs.values.to_numpy(), tfs.values.to_numpy())
        rows = [(uid, doc, ids[doc], score) for uid, q in sent.value.items() for score, doc in shard.search(q, most)]
        uid, doc, doc_id, score = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"uid": pa.array(uid, pa.int64()), "shard": pa.array([group.column("shard")[0].as_py()] * len(rows), pa.int64()), "doc": pa.array(doc, pa.int32()), "doc_id": pa.array(doc_id, pa.int64()), "score": pa.array(score, pa.int64())})

    columns = ("shard", "term", "docs", "tfs", "ids")
    postings = held.where("term is not null").select(*columns).join(terms_, "term", "left_semi").select(*columns).union(held.where("term is null").select(*columns))
    return postings.groupBy("shard").applyInArrow(run, "uid long, shard long, doc int, doc_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    cut = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term"
    return f"""
WITH words AS (SELECT doc_id, {cut} FROM documents),
  freq AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
  sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
  whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
  asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {cut} FROM benchmark) GROUP BY item_id, term),
  weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM freq, whole GROUP BY term, docs),
  scored AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN freq USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id),
  ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {MOST}"""
