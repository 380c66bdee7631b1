"""The corpus pipeline: quality, language, near-duplicates, decontamination, encoding. Each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, langid, minhash, quality, sentencepiece
from graphloom.llm.common import materialize, numbered, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected below these scores, and below this share of words that the language model knows.
QUALITY, LANGUAGE, KNOWN = quality.GOOD, 0.5, 0.1


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least ``QUALITY``; it learns from the labelled ones among them."""
    rows = numbered(docs)
    return without(rows, quality.scored(spark, rows, sf_dir, {"uid": F.col("uid")}).where(F.col("score") < QUALITY).select("uid"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: a letter, a most likely language of probability ``LANGUAGE`` or more, and a share of ``KNOWN`` of known words,
    which text of no learnt language doesn't have."""
    rows = numbered(docs)
    scored = langid.predict(rows, langid.fit(docs), {"uid": F.col("uid")})
    good = (F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE) & (F.col("known") >= KNOWN)
    return without(rows, scored.where(~good).select("uid"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles: the one of least doc_id."""
    rows = numbered(docs)
    return without(rows, minhash.near_duplicates(rows, uid_col="uid").where(~F.col("first")).select("uid"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    rows = numbered(docs)
    return without(rows, decontaminate.leaks(rows, table(spark, sf_dir, "benchmark")).select("uid").distinct())


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids): the whole text encoded."""
    out = sentencepiece.encode(docs, {"doc_id": F.col("doc_id")})
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "ids")


def without(rows: DataFrame, uids: DataFrame) -> DataFrame:
    """The numbered rows but those of these numbers, which are broadcast if few enough, so that texts stay where they are."""
    uids = materialize(uids)
    return rows.join(F.broadcast(uids) if uids.count() <= minhash.MOST_IDS else uids, "uid", "left_anti").select(*COLUMNS)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_first),
    ("decontamination", keep_uncontaminated),
    ("sentencepiece", encoded),
]

#: The classifiers, signatures and paths of the stages are not SQL; each stage is tested against its operator's brute-force check.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch():  # a stage's own tables end with it; its documents stay for the next one
            docs = materialize(stage(spark, docs, sf_dir))
