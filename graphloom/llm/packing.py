"""Best-fit packing of token sequences: a linear program over configurations, by length alone.

A document's ids and one end id are cut into pieces of at most ``capacity`` ids, the first one shorter if need be, and pieces are put
into as few sequences of ``capacity`` ids as can be. Which pieces share a sequence depends on lengths alone, so the program sees the
histogram of lengths, at most ``capacity`` numbers whatever the input:

    least sum x_c   such that   sum a_cl x_c >= n_l for each length l,   c any multiset of lengths of sum at most capacity

``fractional`` solves it by multiplicative weights: a length's price falls with its covered share, and the configurations of each round
are those that a knapsack dynamic program prices best. Each round's prices bound the optimum from below (weak duality). ``solve`` rounds
the solution down, solves what is left again, and packs the last few pieces by their tightest fit, longest first.

Tokens are made once, in Arrow batches, and written with the piece's rank among those of its task and length. A histogram by task
and length turns that into a rank among all of this length, and the rank finds the sequence in the slots of the configurations: no
sort, no window over rows, and no piece of a length goes through one task.

Defined results: null and empty texts are one piece of the end id; bytes that are no UTF-8 are read as U+FFFD; rows with the same text or
id are packed each on its own; an empty table gives an empty result; extra columns are ignored unless kept.
"""

from __future__ import annotations

import itertools
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import by_bytes, materialize, release, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY, END = 1024, 2


# the program


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, last): the largest price of lengths that sum to c or less, for each c, and one length of such a choice, 0 to leave one unit.

    ``prices[l]`` is the price of length l, -inf where there is none; a length may be taken many times."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = prices[1 : c + 1] + best[c - 1 :: -1]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], last[c] = value[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, last


def traced(last: np.ndarray, c: int) -> list[int]:
    """The lengths of the choice for c."""
    out = []
    while c:
        k = int(last[c])
        if k:
            out.append(k)
        c -= k or 1
    return out


def fractional(n: np.ndarray, capacity: int, rounds: int = 40, share: float = 0.1, rate: float = 4.0, slack: float = 0.02) -> tuple[dict[tuple[int, ...], float], float]:
    """({configuration: amount}, a lower bound of the program's optimum) by multiplicative weights.

    A round covers at most ``share`` of each length, with configurations priced within ``slack`` of the best one; each holds the
    length that it is for and the best choice beside it. Prices start in proportion to the lengths, which is the volume bound."""
    lengths = np.flatnonzero(n)
    covered, amounts, bound = np.zeros(capacity + 1), {}, 0.0
    for _ in range(rounds):
        prices = np.full(capacity + 1, -np.inf)
        prices[lengths] = lengths * np.exp(-rate * (covered[lengths] - covered[lengths].min()))
        best, last = knapsack(prices, capacity)
        bound = max(bound, float(n[lengths] @ prices[lengths]) / best[capacity])
        left = np.minimum(share, 1.0 - covered)  # of this round
        for k in lengths[::-1]:
            if left[k] <= 1e-9 or prices[k] + best[capacity - k] < (1 - slack) * best[capacity]:
                continue
            made = (int(k), *traced(last, capacity - int(k)))
            items, times = np.unique(made, return_counts=True)
            amount = float((left[items] * n[items] / times).min())
            if amount > 1e-9:
                amounts[made] = amounts.get(made, 0.0) + amount
                left[items] -= amount * times / n[items]
        gained = np.minimum(share, 1.0 - covered) - left
        covered += gained
        if gained[lengths].max(initial=0.0) < 1e-6 or covered[lengths].min() > 1 - 1e-6:
            break
    return amounts, bound


def filled(n: np.ndarray, first: int, capacity: int) -> list[int]:
    """``first`` and the lengths, of those that are left, that fill its sequence best; long ones come first."""
    room, sums, steps = capacity - first, 1, []
    full = (1 << (room + 1)) - 1
    for k in np.flatnonzero(n[: room + 1])[::-1]:
        k = int(k)
        for _ in range(min(int(n[k]) - (k == first), room // k)):
            steps.append((k, sums))
            sums |= (sums << k) & full
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, [first]
    for k, before in reversed(steps):
        if not before >> at & 1:
            out.append(k)
            at -= k
    return out


def solve(n: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[tuple[int, ...], int], float]:
    """({configuration: times}, lower bound): every one of the n[l] pieces of each length in exactly one place."""
    left, out, bound = n.astype(np.int64).copy(), {}, 0.0

    def take(made: tuple[int, ...], most: float) -> int:
        items, times = np.unique(made, return_counts=True)
        k = int(min(most, (left[items] // times).min()))
        if k > 0:
            key = tuple(sorted(made, reverse=True))
            out[key] = out.get(key, 0) + k
            left[items] -= k * times
        return k

    if left[capacity]:
        take((capacity,), float(left[capacity]))
    alone = int(n[capacity])
    for turn in range(8):
        if left.sum() < 64:
            break
        amounts, low = fractional(left, capacity)
        if not turn:
            bound = low
        if not sum(take(made, np.floor(x + 1e-6)) for made, x in sorted(amounts.items(), key=lambda kv: (-kv[1], kv[0]))):
            break
    for first in range(capacity, 0, -1):
        while left[first]:
            made = tuple(filled(left, first, capacity))
            take(made, np.inf)
    return out, max(bound + alone, -(-int(n @ np.arange(capacity + 1)) // capacity))


def slots(found: dict[tuple[int, ...], int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, as ranges of ranks: those of a range, one after the other, go to the sequences from ``sequence`` on,
    each at ``offset``. Ranges of length l are first[l] to first[l + 1]."""
    rows, sequence = [], 0
    for made, times in sorted(found.items(), reverse=True):
        rows += [(k, sequence, at, times) for k, at in zip(made, itertools.accumulate(made, initial=0), strict=False)]
        sequence += times
    length, base, offset, times = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    ends = np.cumsum(times)
    first = np.searchsorted(length, np.arange(capacity + 2))
    before = np.concatenate([[0], ends])[first]  # pieces of all shorter lengths
    return {"first": first, "before": before, "end": ends, "times": times, "sequence": base, "offset": offset}


# tokens


class _Words(dict):
    """Word to ids. Words that were not met since the last two renewals are forgotten, which bounds the memory of a worker."""

    MOST = 500_000

    def __init__(self, make, before: dict) -> None:
        self.make, self.before = make, before

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?")
        if core != word and core[-1:].isalpha():  # letters and the marks after them are parts of their own
            return self[core] + self[BREAK + word[len(core) :]]
        ids = self[word] = self.before.get(word) or self.make(word)
        return ids

    def renewed(self) -> _Words:
        return self if len(self) <= self.MOST else _Words(self.make, dict(self))


class Encoder:
    """Ids of texts by the tokenizer library. Texts are cut at single spaces and line breaks, where no token of a byte-level vocabulary with
    its usual pre-tokenizer goes over; each distinct word of a batch is looked up once, and those of letters alone go to the model at
    once. Texts with white space side by side or the string of an added token go through the library whole."""

    _of: dict[str, Encoder] = {}

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]  # the byte alphabet: these stay, the others follow 255 in order
        others = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(others) for b in range(256)}
        self.known = _Words(self.word, {})

    @classmethod
    def of(cls, path: str, data: bytes) -> Encoder:
        """One a worker, whose words last over its tasks."""
        if path not in cls._of:
            cls._of[path] = cls(data)
        return cls._of[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def letters(self, word: str) -> bytes:
        """A space or nothing and letters below U+0250, which are one part for every version of Unicode."""
        return np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))], np.uint32).tobytes()

    def word(self, word: str) -> bytes:
        """``word`` after a space, or what follows a mark of a break without one."""
        if word.isalpha() and max(word) < "\u0250":
            return self.letters(" " + word)
        if not word.startswith(BREAK):
            return self.whole(" " + word).tobytes()
        word = word[1:]
        if word[:1] == "\n" and word[1:].isalpha() and max(word) < "\u0250":
            return self.letters("\n") + self.letters(word[1:])
        return self.whole(word).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): all ids of the texts, an end id after each, and where each text ends."""
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([t.decode("utf-8", "replace") if t is not None else None for t in texts.cast(pa.binary()).to_pylist()], pa.string())
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, UNSAFE), pc.match_substring(texts, BREAK))
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        plain = pc.binary_join_element_wise(BREAK, pc.replace_substring(pc.if_else(odd, "", texts), "\n", f" {BREAK}\n"), "")
        cut = pc.split_pattern(plain, " ")
        at, distinct = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        at = at - at[0]
        self.known = self.known.renewed()
        held = list(map(self.known.__getitem__, distinct.dictionary.to_pylist()))
        code, end = distinct.indices.to_numpy().astype(np.int64), len(held)
        held.append(np.array([END], np.uint32).tobytes())
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            code[at[i]] = len(held)
            held.append(self.whole(texts[i].as_py()).tobytes())
        code = np.insert(code, at[1:], end)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        begins = np.cumsum(sizes) - sizes
        n = sizes[code]
        upto = np.cumsum(n)
        ids = np.frombuffer(b"".join(held), np.uint32)[np.repeat(begins[code] - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)]
        return ids, upto[at[1:] + np.arange(len(at) - 1)]


#: What stands before a word that has no space in front; texts that hold it go through the library whole.
BREAK = "\x02"
#: White space side by side, where a token may go over a space or a line break.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSAFE = f"{_SPACE}{_SPACE}|{_SPACE}$"


def pieces(docs: DataFrame, keep: dict[str, Column], text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns plus piece, start, length, ids (little-endian unsigned 32-bit), part and local: the task that made the piece, and the
    number of those of the same length that it made before. Written to the shared folder, so that both stay as they are."""
    source = docs.select(*(c.alias(n) for n, c in keep.items()), F.col(text_col).cast("string").alias("__text"))
    data = source.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kept = source.columns[:-1]
    made = ("piece", "start", "length", "ids", "part", "local")
    schema = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in kept)

    def run(batches):
        encoder = Encoder.of(tokenizer, data.value)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in by_bytes(batch):
                ids, ends = encoder.encode(some.column(len(kept)))
                sizes = np.diff(ends, prepend=0)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                short = (sizes - (n - 1) * capacity)[row]
                start = np.where(piece > 0, short + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, short)
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                local = np.empty_like(length)
                local[order] = seen[sorted_] + np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
                seen += np.bincount(length, minlength=capacity + 1)
                begins = np.concatenate([[0], np.cumsum(length)]) * 4
                held = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(ids)])
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(i).take(of) for i in range(len(kept))), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), held, pa.array(np.full(len(row), part, np.int64)), pa.array(local)],
                    names=[*kept, *made],
                )
        release()

    return materialize(source.mapInArrow(run, f"{schema}, piece int, start long, length long, ids binary, part long, local long"))


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset in place of part and local."""
    spark = cut.sparkSession
    counts = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    n = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        n[r.length] = r.n
    held = spark.sparkContext.broadcast(slots(solve(n, capacity)[0], capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = held.value
        at = s["before"][length] + rank.to_numpy()
        k = np.searchsorted(s["end"], at, side="right")
        return pd.DataFrame({"sequence_id": s["sequence"][k] + at - (s["end"] - s["times"])[k], "offset": s["offset"][k]})

    ranked = cut.join(ahead, ["part", "length"])
    return ranked.withColumn("__at", place("length", F.col("ahead") + F.col("local"))).select(*(c for c in cut.columns if c not in ("part", "local")), "__at.sequence_id", "__at.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, starts, ids): whole sequences, with the place where each piece begins."""
    held = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))  # capacity pieces at most
    return held.select("sequence_id", "length", F.col("held.offset").alias("starts"), F.expr("aggregate(held.ids, X'', (a, x) -> concat(a, x))").alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")})
    digest = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "local")
    return packed(digest)
