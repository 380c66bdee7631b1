"""Source divergence audit: how far apart the word distributions of a language's sources are, term by term and in all.

A group is a (lang, source), nulls as empty texts. Each language keeps the terms that stand in at least ``least_docs`` of its documents; a
group with count c of a kept term and N of all V kept terms gives it p = 1 + floor(1e9 (c + 5) / (N + 5 V)), and the language its own q in
the same way. Two groups are as far apart as the sum of abs(p - p') over all kept terms; a term stands out in a group by p - q.

Counting: tasks count in Arrow batches and write a row a (lang, term) with the counts of its sources. Document frequencies, a small
column of that, decide what is kept, and only counts of kept terms are shuffled by source: rows whose hash no kept term has are dropped where
they are read, the rest is summed and meets the kept terms themselves.

Pairs: kept terms are dealt by hash into tiles of bounded postings. In a tile the terms are split. Heavy ones, present in at least a
share ``heavy`` of the groups, are dense numpy columns, and all pairs of groups are compared column block by column block. For a light
term most groups are absent, with p0 for a count of 0, so the pair sum is written as

    n |p0 - p0'|  +  sum over the group's terms (|p - p0'| - |p0 - p0'|)  +  the same the other way round
                  +  sum over the common terms (|p - p'| - |p - p0'| - |p0 - p'| + |p0 - p0'|)

The first sums need no common term: sorted p with prefix sums answer them for all p0' at once. The last one is a correction a pair of
postings of a term. All is in whole numbers; the tiles' partial sums are added by an aggregate.

Groups of a language are numbered and taken in blocks of ``block`` against each other, so a tile's arrays stay bounded too.

Defined results: texts that are null or without letters are groups' members without terms; with no kept term all pairs are 0 apart and no
term stands out; a language of one source has no pairs; repeated rows count each; an empty table gives an empty result; bytes that are
no UTF-8 are parts of terms as they are (shown as U+FFFD where they are kept); extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import LOWER, UPPER, by_bytes, materialize, release, table

LEAST_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Share of a block's groups from which a term is heavy; groups a block; postings a tile, about; counts a task holds before it writes them.
HEAVY, BLOCK, TILE, FLUSH = 0.25, 256, 200_000, 1_000_000
#: Bytes of the kept terms' 64-bit hashes that may be broadcast; beyond them counts meet their terms by a shuffle.
MOST_BYTES = 8_000_000
#: Everything but ASCII letters and bytes beyond ASCII becomes a blank, and A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """docs: lang, source, text -> (lang, term, df, sources, counts), many rows a term, written. Rows without a term name the groups that occur."""

    def run(batches):
        counts: dict = defaultdict(Counter)  # (lang, source) -> term -> occurrences
        df: dict = defaultdict(Counter)  # lang -> term -> documents

        def out():
            by: dict = defaultdict(list)
            for (lang, source), held in counts.items():
                by[lang].append((source, held))
            counts.clear()
            for lang, groups in by.items():
                code: dict = {}
                sizes = [len(held) for _, held in groups]
                t = np.fromiter((code.setdefault(w, len(code)) for _, held in groups for w in held), np.int64, sum(sizes))
                c = np.fromiter((n for _, held in groups for n in held.values()), np.int64, sum(sizes))
                k = np.repeat(np.arange(len(groups)), sizes)
                for _, held in groups:
                    held.clear()
                order = np.argsort(t, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(code)))]).astype(np.int32)
                names = pa.array([s for s, _ in groups], pa.string()).take(pa.array(k[order]))
                lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), values)  # noqa: E731, B023
                of = df[lang]
                words = pa.array(list(code), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(code) + 1)), pa.concat_arrays([pa.array([None], pa.binary()), words]), pa.array([0, *(of[w] for w in code)], pa.int64())]
                    + [pa.concat_arrays([pa.array([first], x.type), x]) for first, x in (([s for s, _ in groups], lists(names)), ([0] * len(groups), lists(pa.array(c[order]))))],
                    names=["lang", "term", "df", "sources", "counts"],
                )
                del df[lang]
            df.clear()

        n = 0
        for batch in batches:
            for some in by_bytes(batch):
                lang, source = some.column(0).to_pylist(), some.column(1).to_pylist()
                for of, by, text in zip(lang, source, some.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    held, of_lang = counts[of, by], df[of]
                    words = (text or b"").translate(_FOLD).split()
                    n -= len(held)
                    held.update(words)
                    n += len(held)
                    of_lang.update(set(words))
                if n > FLUSH:
                    yield from out()
                    n = 0
        yield from out()
        release()

    source = docs.select(*(F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("lang", "source")), F.col("text").cast("string").alias("text"))
    return materialize(source.mapInArrow(run, "lang string, term binary, df long, sources array<string>, counts array<long>"))


def share(count: str, of: str) -> Column:
    """1 + floor(1e9 count / of) of columns with count <= of: three digits of base 1000, so that nothing overflows below 9e15; null if ``of`` is 0."""
    first, rest = f"(1000 * {count}) div {of}", f"mod(1000 * {count}, {of})"
    second, last = f"(1000 * {rest}) div {of}", f"(1000 * mod(1000 * {rest}, {of})) div {of}"
    return F.when(F.col(of) > 0, F.expr(f"1 + 1000000 * ({first}) + 1000 * ({second}) + {last}"))


def shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The same for arrays; 0 where ``of`` is 0."""
    out, rest, by = np.zeros(np.broadcast(count, of).shape, np.int64), count, np.maximum(of, 1)
    for _ in range(3):
        out, rest = 1000 * out + 1000 * rest // by, 1000 * rest % by
    return np.where(of > 0, 1 + out, 0)


def pair_sums(first: np.ndarray, second: np.ndarray, group: np.ndarray, term: np.ndarray, p: np.ndarray, absent: np.ndarray, heavy: float) -> np.ndarray:
    """Sums of abs(p - p') over the terms of a tile, for groups ``first`` against ``second`` (rows, columns). A posting is a (group, term, p);
    ``absent`` has each group's p of a count of 0. Terms are numbered from 0, each with a posting."""
    n_groups = len(absent)
    present = np.bincount(term, minlength=1)
    dense = present >= max(2, heavy * n_groups)
    out = np.zeros((len(first), len(second)), np.int64)
    apart = np.abs(absent[first][:, None] - absent[second][None, :])
    # heavy terms: dense columns
    column = np.cumsum(dense) - 1
    of_heavy = dense[term]
    width = 4096
    for begin in range(0, int(dense.sum()), width):
        some = of_heavy & (column[term] >= begin) & (column[term] < begin + width)
        tile = np.repeat(absent[:, None], min(width, int(dense.sum()) - begin), axis=1)
        tile[group[some], column[term[some]] - begin] = p[some]
        right = tile[second]
        for k, g in enumerate(first):
            out[k] += np.abs(right - tile[g]).sum(axis=1)
    # light terms: as if absent everywhere, then each group's own terms, then pairs of postings
    group, term, p = group[~of_heavy], term[~of_heavy], p[~of_heavy]
    out += int((~dense & (present > 0)).sum()) * apart
    for rows, others, to in ((first, second, out), (second, first, out.T)):
        for k, g in enumerate(rows):
            own = np.sort(p[group == g])
            if len(own):
                sums = np.concatenate([[0], np.cumsum(own)])
                at = np.searchsorted(own, absent[others])
                x = absent[others]
                to[k] += x * at - sums[at] + (sums[-1] - sums[at]) - x * (len(own) - at) - len(own) * np.abs(x - absent[g])
    order = np.argsort(term, kind="stable")
    group, term, p = group[order], term[order], p[order]
    row, col = np.full(n_groups, -1), np.full(n_groups, -1)
    row[first], col[second] = np.arange(len(first)), np.arange(len(second))
    for step in range(1, int(present[~dense].max(initial=1))):
        i = np.flatnonzero(term[:-step] == term[step:])
        j = i + step
        for a, b in ((i, j), (j, i)):
            met = (row[group[a]] >= 0) & (col[group[b]] >= 0)
            g, h, x, y = group[a[met]], group[b[met]], p[a[met]], p[b[met]]
            np.add.at(out, (row[g], col[h]), np.abs(x - y) - np.abs(x - absent[h]) - np.abs(absent[g] - y) + np.abs(absent[g] - absent[h]))
    return out


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, heavy: float = HEAVY, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    raw = counted(docs)
    kept = materialize(raw.where("term is not null").groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least_docs).select("lang", "term"))
    terms, hashed = raw.where("term is not null"), F.xxhash64("lang", "term").alias("h")
    few = 8 * kept.count() <= MOST_BYTES
    # hashes alone are broadcast; one that another term shares lets that through, and the join below drops it
    some = terms.withColumn("h", hashed).join(F.broadcast(kept.select(hashed).distinct()), "h", "left_semi") if few else terms.join(kept, ["lang", "term"])
    each = some.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    summed = each.groupBy("lang", F.col("x.sources").alias("source"), "term").agg(F.sum("x.counts").alias("n"))
    counts = materialize(summed.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n") if few else summed)
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("postings"))
    named = raw.where("term is null").select("lang", F.explode("sources").alias("source")).distinct().join(sizes, ["lang", "source"], "left").join(v, "lang", "left")
    of = F.coalesce("size", F.lit(0)) + PRIOR * F.coalesce("v", F.lit(0))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(named.select("lang", "source", number.alias("g"), of.alias("of"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("postings", F.lit(0)).alias("postings")))
    return _pairs(counts, groups, heavy, block, tile).unionByName(_terms(counts, groups, top))


def _terms(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms that stand out in each group."""
    whole = groups.groupBy("lang").agg((F.sum("size") + PRIOR * F.max("v")).alias("whole"))
    total = counts.groupBy("lang", "term").agg((F.sum("n") + PRIOR).alias("total"))
    seen = counts.join(total, ["lang", "term"]).join(groups.select("lang", "source", "of"), ["lang", "source"]).join(whole, "lang").withColumn("count", F.col("n") + PRIOR)
    over = seen.select("lang", "source", "term", (share("count", "of") - share("total", "whole")).alias("value")).where("value > 0")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    ranked = over.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.make_valid_utf8(F.col("term").cast("string")).alias("item"), "value", "rank")


def _pairs(counts: DataFrame, groups: DataFrame, heavy: float, block: int, tile: int) -> DataFrame:
    """All pairs of groups of a language."""
    langs = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.sum("postings") / tile)).alias("tiles"), F.ceil(F.count("*") / block).alias("blocks"))
    own, other = F.floor(F.col("g") / block), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = groups.join(langs, "lang").select("lang", "source", "g", "of", "tiles", own.alias("own"), other)
    dealt = dealt.select("lang", "source", "g", "of", "tiles", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    heads = dealt.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), "low", "high", "g", "of", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("n"))
    postings = counts.join(dealt, ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile"), "low", "high", "g", "of", "term", "n")

    def run(held: pa.Table) -> pa.Table:
        g, of, n = (held.column(c).to_numpy() for c in ("g", "of", "n"))
        term = held.column("term").combine_chunks()
        head = term.is_null().to_numpy(zero_copy_only=False)
        order = np.argsort(g[head])
        names, sizes = g[head][order], of[head][order]
        low, high = held.column("low")[0].as_py(), held.column("high")[0].as_py()
        first, second = (np.flatnonzero(names // block == b) for b in (low, high))
        code = term.filter(pa.array(~head)).dictionary_encode().indices.to_numpy()
        group = np.searchsorted(names, g[~head])
        sums = pair_sums(first, second, group, code, shares(n[~head] + PRIOR, sizes[group]), shares(np.full(len(sizes), PRIOR), sizes), heavy)
        a, b = np.nonzero(names[first][:, None] < names[second][None, :])
        lang = held.column("lang")[0].as_py()
        seen = int(code.max(initial=-1)) + 1
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(names[first][a]), "b": pa.array(names[second][b]), "value": pa.array(sums[a, b]), "seen": pa.array(np.full(len(a), seen, np.int64))})

    sums = heads.unionByName(postings).groupBy("lang", "tile", "low", "high").applyInArrow(run, "lang string, a int, b int, value long, seen long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # terms that no group of the tile's blocks has count as absent in both
    side = lambda x: groups.withColumn("none", F.lit(PRIOR)).select("lang", F.col("g").alias(x), F.col("source").alias(f"{x}_name"), F.coalesce(share("none", "of"), F.lit(0)).alias(f"{x}_none"), *(["v"] if x == "a" else []))
    named = sums.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).withColumn("value", F.col("value") + (F.col("v") - F.col("seen")) * F.abs(F.col("a_none") - F.col("b_none")))
    both = named.select("lang", "value", F.explode(F.array(F.struct(F.col("a_name").alias("source"), F.col("b_name").alias("item")), F.struct(F.col("b_name").alias("source"), F.col("a_name").alias("item")))).alias("x"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", place)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
  words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x60\\x7B-\\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
  groups AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
  sizes AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS size FROM groups g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
  p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0) + {PRIOR})) // (s.size + {PRIOR} * v.v) AS p
    FROM sizes s JOIN kept k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
  q AS (SELECT t.lang, t.term, 1 + ({SCALE} * (t.n + {PRIOR})) // (w.n + {PRIOR} * v.v) AS q FROM (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, term) t
    JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang) w ON w.lang = t.lang JOIN v ON v.lang = t.lang),
  sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
  found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
