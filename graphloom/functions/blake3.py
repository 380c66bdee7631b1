"""BLAKE3 content hashes, from the published specification, vectorised over the chunks of a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK, ROUNDS = 1024, 64, 7


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values of n blocks at once: cv (n, 8), words (n, 16)."""
    n = len(cv)
    v = [cv[:, i].copy() for i in range(8)] + [np.full(n, IV[i], np.uint32) for i in range(4)]
    v += [(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = [words[:, i] for i in range(16)]
    turn = lambda x, r: (x >> np.uint32(r)) | (x << np.uint32(32 - r))

    def mix(a, b, c, d, x, y):
        for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            v[a] = v[a] + v[b] + word
            v[d] = turn(v[d] ^ v[a], r1)
            v[c] = v[c] + v[d]
            v[b] = turn(v[b] ^ v[c], r2)

    for r in range(ROUNDS):
        for k in range(4):
            mix(k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            mix(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        if r < ROUNDS - 1:
            m = [m[p] for p in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], 1)


def blake3_many(texts: list[bytes]) -> list[str]:
    """Hex hashes of many texts. The chunks of all texts are compressed side by side, then their trees level by level."""
    if not texts:
        return []
    n = np.array([max(1, -(-len(t) // CHUNK)) for t in texts])
    words = np.frombuffer(b"".join(t.ljust(k * CHUNK, b"\0") for t, k in zip(texts, n, strict=True)), "<u4").reshape(-1, CHUNK // BLOCK, 16)
    first = np.r_[0, np.cumsum(n)[:-1]]
    sizes = np.full(len(words), CHUNK)
    sizes[first + n - 1] = [len(t) - (k - 1) * CHUNK for t, k in zip(texts, n, strict=True)]
    counter = (np.arange(len(words)) - np.repeat(first, n)).astype(np.uint64)
    alone = np.repeat(n == 1, n)
    last = np.maximum(1, -(-sizes // BLOCK)) - 1  # each chunk's last block
    cv = np.tile(IV, (len(words), 1))
    with np.errstate(over="ignore"):
        for b in range(int(last.max()) + 1):
            at = np.flatnonzero(last >= b)
            flags = (CHUNK_START if b == 0 else 0) + CHUNK_END * (last[at] == b) + ROOT * ((last[at] == b) & alone[at])
            cv[at] = _compress(cv[at], words[at, b], counter[at], np.clip(sizes[at] - b * BLOCK, 0, BLOCK), flags)
        while int(n.max()) > 1:  # parents pair up from the left; an odd one waits, which gives the tree of the specification
            first = np.r_[0, np.cumsum(n)[:-1]]
            pairs = n // 2
            inner = np.arange(pairs.sum()) - np.repeat(np.r_[0, np.cumsum(pairs)[:-1]], pairs)
            left = np.repeat(first, pairs) + 2 * inner
            top = np.repeat(n == 2, pairs)
            up = _compress(np.tile(IV, (len(left), 1)), np.concatenate([cv[left], cv[left + 1]], 1), np.zeros(len(left), np.uint64), np.full(len(left), BLOCK), PARENT + ROOT * top)
            after = pairs + n % 2
            start = np.r_[0, np.cumsum(after)[:-1]]
            new = np.empty((after.sum(), 8), np.uint32)
            new[np.repeat(start, pairs) + inner] = up
            odd = np.flatnonzero(n % 2)
            new[start[odd] + pairs[odd]] = cv[first[odd] + n[odd] - 1]
            cv, n = new, after
    return [c.tobytes().hex() for c in cv.astype("<u4")]


def blake3_hex(data: bytes) -> str:
    return blake3_many([data])[0]


#: Bytes hashed side by side.
BATCH = 4_000_000


@F.arrow_udf(T.StringType())
def content_hash(text: pa.Array) -> pa.Array:
    """Hex BLAKE3 of the UTF-8 text; null stays null. Texts stay in the Arrow batch, and bytes of about ``BATCH`` of them at a time are held beside it."""
    out: list = [None] * len(text)
    held, size = [], 0

    def flush() -> None:
        for i, h in zip([i for i, _ in held], blake3_many([t for _, t in held]), strict=True):
            out[i] = h
        held.clear()

    for i, t in enumerate(text):  # a scalar at a time
        if not t.is_valid:
            continue
        data = t.as_buffer().to_pybytes()
        held.append((i, data))
        size += max(len(data), CHUNK)
        if size >= BATCH:
            flush()
            size = 0
    flush()
    return pa.array(out, pa.string())
