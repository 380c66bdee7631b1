"""Best-fit packing: tokens against the library, places against the contract, the program against bounds and exhaustive search."""

import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import packing  # noqa: E402
from tests.llm import edges  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(packing.TOKENIZER)
    return lambda text: [*held.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(rows, texts, library, capacity=packing.CAPACITY):
    """Pieces hold the whole text once, in order; sequences are gapless and no longer than they may be."""
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids, held = library(text), sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in held] == list(range(len(held)))
        assert [r.start for r in held] == [sum(r.length for r in held[:k]) for k in range(len(held))]
        assert all(r.length == capacity for r in held[1:]) and 0 < held[0].length <= capacity
        for r in held:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in held) == len(ids)
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_query(spark, library):
    rows = packing.query(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used = check(rows, texts, library)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // packing.CAPACITY)


def test_sequences_hold_the_pieces(spark, library):
    from pyspark.sql import functions as F

    docs = [(i, " ".join(random.Random(i).choices("one two three four, five. sixteen".split(), k=1 + 37 * i % 90))) for i in range(60)]
    placed = packing.packed(packing.pieces(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), {"doc_id": F.col("doc_id")}, capacity=32), 32).cache()
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        held = whole[r.sequence_id]
        assert bytes(held.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and r.offset in held.starts
    assert sum(r.length for r in whole.values()) == sum(len(library(t)) for _, t in docs)


def test_encoder_equals_the_library(library):
    encoder = packing.Encoder(open(packing.TOKENIZER, "rb").read())
    rng = random.Random(5)
    units = ["a", "The", "ñandú", "don't", "'ll", "12", "x1", ",", "...", "\n", " ", "  ", "\t", "\r\n", " ", " ", "\x1c", "日本", "😀", "ǅ", "ʰ", "\x02", "<|endoftext|>", "²", "_", "(a)", "é", "é", "\u0085"]
    texts = ["".join(rng.choices(units, k=rng.randrange(0, 12))) for _ in range(3000)] + [" ".join(rng.choices(units, k=9)) for _ in range(1000)] + [None, "", edges.LONG]
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    for text, begin, end in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert ids[begin:end].tolist() == library(text), repr(text)
    assert packing._Words.MOST >= len(encoder.known)


def test_words_are_forgotten_in_turn(monkeypatch):
    monkeypatch.setattr(packing._Words, "MOST", 3)
    encoder = packing.Encoder(open(packing.TOKENIZER, "rb").read())
    for k in range(5):
        encoder.encode(pa.array([f"word{chr(97 + k)} and more of it"]))
        assert len(encoder.known) + len(encoder.known.before) <= 24


def test_edges(spark, tmp_path, library):
    rows = packing.query(spark, edges.sf_dir(spark, tmp_path, documents=edges.documents(spark))).collect()
    texts = {r.doc_id: r.text for r in edges.documents(spark).collect() if r.doc_id != 6}
    twice = [r for r in rows if r.doc_id == 6]
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    check([r for r in rows if r.doc_id != 6 or r is twice[0] or r is twice[1]], texts, library)
    assert [r.length for r in rows if r.doc_id in (1, 2, 9)] == [1, 1, 1]
    assert packing.query(spark, edges.sf_dir(spark, tmp_path / "none")).count() == 0


def test_bytes_that_are_no_utf8(spark, library):
    from pyspark.sql import functions as F

    docs = spark.sql("select 1L as doc_id, cast(X'6162FF63' as string) as text union all select 2L, 'plain'")
    held = {r.doc_id: bytes(r.ids) for r in packing.pieces(docs, {"doc_id": F.col("doc_id")}).collect()}
    assert held == {i: np.array(library(t), "<u4").tobytes() for i, t in ((1, "ab�c"), (2, "plain"))}


def fewest(lengths, capacity):
    """By exhaustive search."""

    @functools.cache
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for mask in range(1 << len(rest)):
            if first + sum(x for i, x in enumerate(rest) if mask >> i & 1) <= capacity:
                best = min(best, 1 + least(tuple(x for i, x in enumerate(rest) if not mask >> i & 1)))
        return best

    return least(tuple(sorted(lengths, reverse=True)))


def total(found):
    return sum(found.values())


def histogram(lengths, capacity):
    return np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)


def test_program_against_exhaustive_search():
    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))]
        found, bound = packing.solve(histogram(lengths, 20), 20)
        best = fewest(lengths, 20)
        assert bound <= best + 1e-6 and best <= total(found) <= best + 1


@pytest.mark.parametrize("kind", ["uniform", "middle", "small", "thirds", "one"])
def test_program_against_bounds(kind):
    from graphloom.llm import sharding

    rng = np.random.default_rng(4)
    lengths = {"uniform": rng.integers(1, 1025, 6000), "middle": rng.integers(300, 800, 3000), "small": rng.integers(1, 50, 20000), "thirds": rng.choice([341, 342, 512, 171, 170], 5000), "one": np.full(700, 400)}[kind]
    n = histogram(lengths, 1024)
    found, bound = packing.solve(n)
    used = np.zeros(1025, np.int64)
    for made, times in found.items():
        assert sum(made) <= 1024
        np.add.at(used, list(made), times)
    assert (used == n).all() and bound <= total(found)
    greedy = sharding.best_fit(sorted(lengths.tolist(), reverse=True), 1024, len(lengths))
    assert total(found) <= 1.005 * (max(greedy) + 1) + 1
    held = packing.slots(found)
    assert held["end"][-1] == len(lengths) and held["times"].min() > 0


def test_weights_solve_the_program():
    """The amounts cover each length, and prices bound their sum: both ends meet where lengths fill sequences."""
    n = histogram([600] * 50 + [424] * 50 + [256] * 400, 1024)
    amounts, bound = packing.fractional(n, 1024)
    covered = np.zeros(1025)
    for made, x in amounts.items():
        np.add.at(covered, list(made), x)
    assert np.allclose(covered[n > 0], n[n > 0], rtol=0.02) and sum(amounts.values()) <= 1.05 * bound and bound == pytest.approx(150)
