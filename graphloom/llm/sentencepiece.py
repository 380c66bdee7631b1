"""SentencePiece encoding and decoding by a weighted finite-state transducer: the shortest path in the tropical semiring.

The vocabulary file is a parameter and is read on the driver. Its weights are the pieces' stored scores, its rewriting rules are the
normaliser. Decoding gives back every text exactly under a normaliser without rules that keeps all spaces, as that of the default
file: U+2581 of the input itself goes by the byte fallback, where the original library would turn it into a space.

Defined results: a null text has null ids, an empty text has none; texts of any length are encoded whole; repeated rows are encoded
each on its own; an empty table gives an empty result. Bytes that are no UTF-8 are encoded as U+FFFD, so such a text does not come back.
"""

from __future__ import annotations

import zlib
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, map_text, release, table
from graphloom.llm.pieces import Pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _lists(parts: list[list[bytes] | None]) -> pa.Array:
    raw = [b"".join(p) if p is not None else b"" for p in parts]
    offsets = np.r_[0, np.cumsum([len(r) // 4 for r in raw])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)), mask=pa.array([p is None for p in parts]))


def _encoder(pieces: Pieces, remembered: int):
    """A function from texts, as UTF-8, to their ids. It remembers up to ``remembered`` segments."""
    seen: dict[str, bytes] = {}
    return lambda texts: _lists(pieces.encode([t.decode("utf-8", "replace") if t is not None else None for t in texts], seen, remembered))


def _bounds(ids: pa.ListArray) -> np.ndarray:
    """Where each row's ids begin among all, and the end."""
    return np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]


def _texts(pieces: Pieces, ids: pa.ListArray) -> list[str | None]:
    """The text that each row's ids spell, looked up id by id."""
    _, offsets, data = pa.array(pieces.spell, pa.large_binary()).take(ids.flatten()).buffers()
    cut = np.frombuffer(offsets, np.int64)[_bounds(ids)].tolist()
    data = memoryview(data) if data is not None else b""
    return [pieces.decoded(bytes(data[a:b])) if some else None for (a, b), some in zip(pairwise(cut), ids.is_valid().to_pylist(), strict=True)]


JUDGED = "n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean"


def _judged(pieces: Pieces, ids: pa.ListArray, texts: list[bytes | None]) -> list[pa.Array]:
    """The columns ``JUDGED`` of these ids, all read off the ids alone; the texts are only compared with what the ids decode to."""
    fallback = np.zeros(len(pieces.text), bool)
    fallback[pieces.byte_id] = True
    flat = ids.flatten().to_numpy()
    raw, is_byte, rows = memoryview(flat.astype("<i4", copy=False)), fallback[flat], []
    for (a, b), text, back in zip(pairwise(_bounds(ids).tolist()), texts, _texts(pieces, ids), strict=True):
        rows.append((b - a, int(np.count_nonzero(is_byte[a:b])), zlib.crc32(raw[a:b]), back.encode() == text) if back is not None else (None,) * 4)
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]


def encode(docs: DataFrame, keep: dict, text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """``keep`` columns plus ids: array<int>."""
    held = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def make():
        encoder = _encoder(Pieces.of(held.value), 50_000)
        return lambda texts: [encoder(texts)]

    return map_text(docs, F.col(text_col), make, "ids array<int>", keep, most=1_000_000)


def decode(encoded: DataFrame, keep: list[str], ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """``keep`` columns plus text: string."""
    held = encoded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    source = encoded.select(*keep, F.col(ids_col).cast("array<int>").alias("__ids"))
    kept = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in keep)

    def run(batches):
        pieces = Pieces.of(held.value)
        for batch in batches:
            texts = _texts(pieces, batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, f"{kept}, text string" if kept else "text string")


def judged(encoded: DataFrame, keep: list[str], ids_col: str = "ids", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """``keep`` columns plus what stands for the ids without carrying them: n_pieces, n_bytes (byte-fallback ids), ids_crc32 (of the
    little-endian 32-bit ids) and round_trip (these ids, decoded, give the text byte by byte)."""
    held = encoded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    source = encoded.select(*keep, F.col(ids_col).cast("array<int>").alias("__ids"), F.col(text_col).cast("string").alias("__text"))
    kept = "".join(f"`{n}` {source.schema[n].dataType.simpleString()}, " for n in keep)

    def run(batches):
        pieces = Pieces.of(held.value)
        for batch in batches:
            for part in by_bytes(batch):
                *same, ids, texts = part.columns
                out = _judged(pieces, ids, texts.cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*same, *out], names=[*keep, *(f.split()[0] for f in JUDGED.split(", "))])
        release()

    return source.mapInArrow(run, kept + JUDGED)


def digest(docs: DataFrame, keep: dict, text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """``keep`` columns plus those of ``judged``: every text encoded to its ids as by ``encode``, and these decoded as by ``decode``, within
    one worker a task; a second one for the ids would double the memory that all workers take."""
    held = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def make():
        pieces = Pieces.of(held.value)
        encoder = _encoder(pieces, 200_000)
        return lambda texts: _judged(pieces, encoder(texts), texts)

    return map_text(docs, F.col(text_col), make, JUDGED, keep, most=4_000_000)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"), {"doc_id": F.col("doc_id")})
