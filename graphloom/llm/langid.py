"""Language identification, words first: a known word scores its log frequency in each language; an unseen word backs off to the
longest known character n-grams, four letters down to one.

Words are a letter and the letters and marks that follow it (Unicode categories L and M), lower-cased. Counts cover all training rows.
The model keeps each language's most frequent words and n-grams, about ``words`` and ``grams`` of them, fewer if there are more
languages than ``total`` allows, so its size is bounded whatever the corpus and no language is crowded out by others. At the bound, of
entries equally frequent those of least hash are kept. Words beyond it are scored like unseen ones.

Defined results: ``und`` with score and known 0.0 where the text is null, empty or holds no letter, or nothing could be learnt; ties go
to the first language in sorted order; repeated rows are predicted each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, fold, map_text, materialize, most_frequent_each, table
from graphloom.llm.pieces import Automaton, codepoints

#: Longest grams; entries that a task holds before it hands its counts on; characters whose grams are looked up at once.
ORDER, FLUSH, CHUNK = 4, 100_000, 50_000


@functools.cache
def letters(most: int = 0x10FFFF) -> re.Pattern:
    """A letter, then letters and marks, of characters up to ``most``."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(most + 1)]

    def ranges(of: str) -> str:
        out, begin = [], None
        for c in range(most + 2):
            inside = c <= most and kinds[c] in of
            if inside and begin is None:
                begin = c
            elif not inside and begin is not None:
                out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
                begin = None
        return "".join(out)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


#: The first byte of a character beyond 16 bits.
WIDE = re.compile(b"[\xf0-\xf4]")


def words_of(text: bytes | None) -> list[str]:
    """The words of a text. A set with characters beyond 16 bits is searched range by range for each character that isn't in it, so it
    is used for texts that hold such characters alone."""
    if not text:
        return []
    lowered = text.decode("utf-8", "replace").lower()
    return letters(0x7F if lowered.isascii() else 0x10FFFF if WIDE.search(text) else 0xFFFF).findall(lowered)


def grams_of(word: str) -> list[str]:
    """All grams of the word with its edges marked."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked)) for n in range(1, min(ORDER, len(marked) - i) + 1)]


def _emit(by: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
    """One batch a language; empties the counts."""
    for lang, counts in by.items():
        keys = pa.array(list(counts), pa.string())
        n = pa.array(list(counts.values()), pa.int64())
        counts.clear()
        yield pa.RecordBatch.from_arrays([keys, pa.array([lang] * len(keys), pa.string()), n], names=["key", "lang", "n"])
    by.clear()


def count_words(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    def run(batches):
        by: dict[str, Counter] = {}
        for batch in batches:
            for part in by_bytes(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    by.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, by.values())) > FLUSH:
                    yield from _emit(by)
        yield from _emit(by)

    rows = train.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "key string, lang string, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    def run(batches):
        by: dict[str, dict[str, int]] = {}
        for batch in batches:
            for w, lang, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts = by.setdefault(lang, {})
                for g in grams_of(w):
                    counts[g] = counts.get(g, 0) + n
            if sum(map(len, by.values())) > FLUSH:
                yield from _emit(by)
        yield from _emit(by)

    return words.mapInArrow(run, "key string, lang string, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = 30_000, grams: int = 15_000, total: int = 250_000) -> dict:
    """The model: languages; rows of log frequencies, one a known word and gram."""
    counted = materialize(count_words(train, text_col, lang_col))
    counted_grams = materialize(count_grams(counted))
    totals = {r.lang: (r.n, r.v) for r in counted.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    of_order = {(r.lang, r.o): (r.n, r.v) for r in counted_grams.groupBy("lang", F.length("key").alias("o")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    langs = sorted(totals)
    at = {lang: i for i, lang in enumerate(langs)}

    def gathered(rows: DataFrame, most: int, of) -> tuple[list[str], np.ndarray]:
        """Kept keys and their rows; ``of(key, language)``: (tokens, types) that the counts are shares of."""
        kept = rows.where(most_frequent_each(rows, "n", min(most, total // max(1, len(langs))), "key", "lang")).select("key").distinct()
        got = rows.join(kept, "key", "left_semi").select("key", "lang", "n").toArrow()  # a row a kept key and language
        keys = sorted(set(got.column(0).to_pylist()))
        place = {k: i for i, k in enumerate(keys)}
        counts = np.zeros((len(keys), len(langs)))
        for batch in got.to_batches(10_000):
            for k, lang, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[place[k], at[lang]] = n
        sizes = np.array([[n + 0.5 * v + 1 for n, v in (of(k, lang) for lang in langs)] for k in keys]).reshape(counts.shape)
        return keys, np.log((counts + 0.5) / sizes)

    known, known_rows = gathered(counted, words, lambda _, lang: totals[lang])
    back, back_rows = gathered(counted_grams, grams, lambda g, lang: of_order.get((lang, len(g)), (0, 0)))
    return {"langs": langs, "known": known, "known_rows": known_rows, "back": back, "back_rows": back_rows}


class Scorer:
    """A model at hand: log frequencies of words in each language."""

    def __init__(self, model: dict) -> None:
        self.langs, self.known_rows, self.back_rows = model["langs"], model["known_rows"], model["back_rows"]
        self.known = {w: i for i, w in enumerate(model["known"])}
        self.grams = Automaton(model["back"], list(range(len(model["back"]))))

    def backed_off(self, words: list[str]) -> np.ndarray:
        """For each word the mean row of its longest known grams, one from each letter of the word with its edges marked where there is
        any; zeros if there is none."""
        out = np.zeros((len(words), len(self.langs)))
        if not words or not len(self.back_rows):
            return out
        classes = self.grams.classes[codepoints("".join([f"<{w}>" for w in words]))]  # no gram spans two words
        row = np.full(len(classes), -1, np.int32)
        for i in range(0, len(classes), CHUNK):
            begin, _, value = self.grams.matches(classes[i : i + CHUNK + ORDER], min(CHUNK, len(classes) - i))
            row[begin + i] = value  # longer grams come later
        starts = np.r_[0, np.cumsum([len(w) + 2 for w in words])[:-1]]
        found = np.add.reduceat((row >= 0).astype(np.int64), starts)
        for j in range(len(self.langs)):
            column = np.r_[self.back_rows[:, j], 0.0]  # -1 reads the last one
            out[:, j] = np.add.reduceat(column[row], starts) / np.maximum(found, 1)
        return out

    def rows_of(self, at: np.ndarray, new_rows: np.ndarray) -> np.ndarray:
        """A row a word: that of a known word from 0 on, and of the new ones at -1, -2, ..."""
        rows, new = np.empty((len(at), len(self.langs))), at < 0
        rows[~new], rows[new] = self.known_rows[at[~new]], new_rows[-1 - at[new]]
        return rows

    def __call__(self, texts: list[bytes | None]) -> tuple[list[str], list[float], list[float]]:
        """(language, its probability, share of known words) of each text. Distinct new words are scored once for all of them."""
        cut = [words_of(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        places = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(places < 0)
        unseen = [flat[i] for i in new.tolist()]
        index = {w: i for i, w in enumerate(dict.fromkeys(unseen))}
        places[new] = -1 - np.fromiter(map(index.__getitem__, unseen), np.int64, len(unseen))
        new_rows = self.backed_off(list(index))
        del flat, unseen
        pred, score, known = [], [], []
        end = 0
        for words in cut:
            at = places[end : end + len(words)]
            end += len(words)
            if not words or not self.langs:
                pred.append("und")
                score.append(0.0)
                known.append(0.0)
                continue
            s = sum(self.rows_of(at[i : i + CHUNK], new_rows).sum(0) for i in range(0, len(at), CHUNK))
            k = int(s.argmax())
            pred.append(self.langs[k])
            score.append(float(1 / np.exp(s - s[k]).sum()))
            known.append(float((at >= 0).mean()))
        return pred, score, known


def predict(docs: DataFrame, model: dict, keep: dict, text_col: str = "text") -> DataFrame:
    """``keep`` columns plus lang_pred, score, the probability of that language among those learnt, and known, the share of the text's
    words that the model knows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value)

        def run(texts):
            return [pa.array(c, t) for c, t in zip(scorer(texts), (pa.string(), pa.float64(), pa.float64()), strict=True)]

        return run

    return map_text(docs, F.col(text_col), make, "lang_pred string, score double, known double", keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 5) == 0
    return predict(docs, fit(docs.where(~held_out)), {"doc_id": F.col("doc_id"), "held_out": held_out})
