"""A SentencePiece vocabulary file as weighted finite-state transducers, compiled to state and arc arrays.

The file is read from its published protobuf layout. ``Pieces`` holds three machines: the normaliser (``Normaliser``: the file's own
rewriting rules, white space, one dummy space in front), the pieces (``Automaton``: arcs by state and character class; final states carry
an id) and the byte fallback (one arc a character without a piece, spelling its UTF-8 bytes). An input composed with them is an
acyclic lattice over its characters, whose arcs are found for many inputs at once, a step of all starts at a time.

No piece of a usual file holds U+2581 after another character, so every path breaks before a run of spaces that follows a word: the
lattice of a text is then the chain of the lattices of its segments, and equal segments share their result.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from array import array

import numpy as np

SPACE = "▁"
#: Stands for a U+2581 of the input itself: a lone surrogate, which no valid text holds. It goes by the byte fallback.
ESCAPED = "\udc81"
#: Ends a segment in the arrays.
END = "\udc00"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SEGMENT = re.compile(" *[^ ]+| +")
#: Distance of the byte fallback below the least piece score.
UNKNOWN_PENALTY = 10.0
#: Characters whose arcs are held at once; longer segments go in parts, their paths along one frontier.
CHUNK = 50_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """A deterministic acceptor of a set of words in arrays: a class a character, arcs (state, class) -> state in an open-addressed
    table, and for each state the value of the word that ends there, or -1."""

    def __init__(self, words: list[str], values: list[int]) -> None:
        alphabet = sorted({ord(c) for w in words for c in w})
        self.classes = np.zeros(0x110000, np.int32)  # 0: in no word
        self.classes[alphabet] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        of = {chr(c): k for k, c in enumerate(alphabet, 1)}
        arcs: dict[int, int] = {}
        value = [-1]
        for w, v in zip(words, values, strict=True):
            state = 0
            for c in w:
                key = state * self.width + of[c]
                state = arcs.get(key, 0)
                if not state:
                    state = arcs[key] = len(value)
                    value.append(-1)
            value[state] = v
        self.value = np.array(value, np.int32)
        self.first = np.zeros(self.width, np.int32)  # arcs of the start, by class
        self.bits = max(4, (4 * len(arcs) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        left, to = np.fromiter(arcs, np.int64, len(arcs)), np.fromiter(arcs.values(), np.int32, len(arcs))
        start = left < self.width
        self.first[left[start]] = to[start]
        slot = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = left[free]  # one of those that want a slot gets it
            got = self.keys[slot] == left
            self.to[slot[got]] = to[got]
            left, to, slot = left[~got], to[~got], (slot[~got] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The states reached from each state by each class; 0 where there is no arc."""
        keys = state.astype(np.int64) * self.width + classes
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.to[slot], 0)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def matches(self, classes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, value) of every word in the sequence that starts before ``most``."""
        begin, end, value = [], [], []
        at = np.flatnonzero(classes[:most]).astype(np.int32)
        state, k = self.first[classes[at]], 1
        while True:
            some = state > 0
            at, state = at[some], state[some]
            v = self.value[state]
            hit = v >= 0
            begin.append(at[hit])
            end.append(at[hit] + np.int32(k))
            value.append(v[hit])
            inside = at + k < len(classes)
            at, state = at[inside], state[inside]
            if not len(at):
                break
            state = self.step(state, classes[at + k])
            k += 1
        return np.concatenate(begin), np.concatenate(end), np.concatenate(value)


def _rules(charsmap: bytes) -> dict[str, str]:
    """The rewriting rules of a compiled character map: a double array of the keys, whose leaves are offsets of the texts put in place."""
    if not charsmap:
        return {}
    size = struct.unpack_from("<I", charsmap)[0]
    unit = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
    texts = charsmap[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    out = {}
    stack = [(offset(unit[0]), b"")]
    while stack:
        node, key = stack.pop()
        for c in range(1, 256):
            at = node ^ c
            if at < len(unit) and unit[at] & 0x800000FF == c:
                inner = at ^ offset(unit[at])
                if unit[at] >> 8 & 1:
                    begin = unit[inner] & 0x7FFFFFFF
                    out[(key + bytes([c])).decode()] = texts[begin : texts.index(b"\0", begin)].decode()
                stack.append((inner, key + bytes([c])))
    return out


class Normaliser:
    """The first machine: longest rules from the left, then white space. Spaces stay spaces here; ``Pieces`` writes them as U+2581."""

    def __init__(self, spec: dict) -> None:
        rules = _rules(spec.get(2, b""))
        self.prefix, self.squeezed = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if not spec.get(5, 1):
            raise ValueError("only normalisers that escape spaces are compiled")
        self.machine = Automaton(list(rules), list(range(len(rules)))) if rules else None
        self.out = list(rules.values())

    def __call__(self, text: str) -> str:
        if self.machine is not None:
            classes = self.machine.classes[codepoints(text)]
            begin, end, value = self.machine.matches(classes, len(classes))
            longest = {b: (e, v) for b, e, v in zip(begin.tolist(), end.tolist(), value.tolist(), strict=True)}  # ends ascend
            parts, at = [], 0
            for b in sorted(longest):
                if b >= at:
                    e, v = longest[b]
                    parts += [text[at:b], self.out[v]]
                    at = e
            text = "".join(parts) + text[at:]
        if self.squeezed:
            text = re.sub(" +", " ", text.strip(" "))
        return f" {text}" if self.prefix and text else text


class Pieces:
    """Compiled once a worker; see ``of``."""

    _held: dict[bytes, Pieces] = {}

    def __init__(self, model: bytes) -> None:
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        spec: dict = {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.text.append(f.get(1, b"").decode())
                self.score.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kind.append(f.get(3, NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
        if BYTE not in self.kind:
            raise ValueError("the vocabulary has no byte fallback")
        self.normalise = Normaliser(spec)
        words = [(p, i) for i, (p, k) in enumerate(zip(self.text, self.kind, strict=True)) if k in (NORMAL, USER) and p]
        self.pieces = Automaton([p for p, _ in words], [i for _, i in words])
        self.longest = max(len(p) for p, _ in words)
        self.chained = all(SPACE not in p.lstrip(SPACE) for p, _ in words)
        self.byte_id = np.zeros(256, np.int32)
        for i, (p, k) in enumerate(zip(self.text, self.kind, strict=True)):
            if k == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        # weights of arcs by piece; the last one, which -1 reads, is the fallback's
        self.cost = np.array([-s for s in self.score] + [UNKNOWN_PENALTY - min(self.score[i] for _, i in words)])
        self.spell = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b"" for p, k in zip(self.text, self.kind, strict=True)]
        self.weighted()

    @classmethod
    def of(cls, model: bytes) -> Pieces:
        key = hashlib.sha256(model).digest()
        if key not in cls._held:
            cls._held.clear()
            cls._held[key] = cls(model)
        return cls._held[key]

    def segments(self, text: str) -> list[str]:
        """The normalised text, cut where every path has a cut."""
        whole = self.normalise(text)
        return SEGMENT.findall(whole) if self.chained else [whole] if whole else []

    # -- composition: the lattices of many segments in one sequence

    def _lattice(self, segments: list[str]):
        """Code points, the first place and the end of each segment, and its arcs (start, end, piece or -1) in order of their start in
        the segment, with the bounds of each such start."""
        s = "".join([x + END for x in segments]).replace(SPACE, ESCAPED).replace(" ", SPACE)
        points = codepoints(s)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(lengths + 1) - 1
        first = ends - lengths
        start, end, piece = self._arcs(points, len(points))
        depth = (start - np.repeat(first, lengths + 1)[start]).astype(np.int32)
        order = np.argsort(depth.astype(np.int16) if len(lengths) and lengths.max() < 1 << 15 else depth, kind="stable")
        return points, first, ends, start[order], end[order], piece[order], np.r_[0, np.cumsum(np.bincount(depth, minlength=1))]

    def _arcs(self, points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, piece = self.pieces.matches(self.pieces.classes[points], most)
        alone = points[:most] != ord(END)
        alone[start[end == start + 1]] = False
        lone = np.flatnonzero(alone).astype(np.int32)
        return np.r_[start, lone], np.r_[end, lone + 1], np.r_[piece, np.full(len(lone), -1, np.int32)]

    @staticmethod
    def _batches(segments: list[str]):
        """Places of segments of like lengths, at most about ``CHUNK`` characters together; a longer one comes alone."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(lengths, kind="stable")
        whole = np.cumsum(lengths[order] + 1)
        begin = 0
        while begin < len(order):
            done = whole[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(whole, done + CHUNK, "right")))
            yield order[begin:end].tolist()
            begin = end

    def paths(self, segments: list[str]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of the tropical-semiring shortest path of each segment through normaliser, pieces and
        byte fallback; ties go to the earliest start."""
        out: list[bytes] = [b""] * len(segments)
        for at in self._batches(segments):
            if len(segments[at[0]]) > CHUNK:
                out[at[0]] = self._long_path(segments[at[0]])
                continue
            points, first, ends, start, end, piece, bounds = self._lattice([segments[i] for i in at])
            weight = self.cost[piece]
            best, back = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
            best[first] = 0.0
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                to = end[a:b]  # of one start a segment, so no end occurs twice
                c = best[start[a:b]] + weight[a:b]
                better = np.flatnonzero(c < best[to])
                best[to[better]] = c[better]
                back[to[better]] = better + a
            taken, place = [], ends[ends > first]
            base = np.repeat(first, ends - first + 1)
            while len(place):
                arc = back[place]
                taken.append(arc)
                place = start[arc]
                place = place[place > base[place]]
            arcs = np.concatenate(taken) if taken else np.zeros(0, np.int64)
            arcs = arcs[np.argsort(start[arcs])]
            ids, sizes = self._spelled(points[start[arcs]], piece[arcs])
            ids_end = np.r_[0, np.cumsum(sizes)]
            cut = ids_end[np.searchsorted(start[arcs], np.r_[first, len(points)])] * 4
            raw = ids.tobytes()
            for k, i in enumerate(at):
                out[i] = raw[cut[k] : cut[k + 1]]
        return out

    def _spelled(self, points: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a path's arcs, with the bytes of a character in place of a fallback, and how many ids each arc has."""
        sizes = np.ones(len(piece), np.int64)
        lone = np.flatnonzero(piece < 0)
        if not len(lone):
            return piece.astype(np.int32), sizes
        raw = [(SPACE if c == ord(ESCAPED) else chr(c)).encode("utf-8", "replace") for c in points[lone].tolist()]
        sizes[lone] = list(map(len, raw))
        ids = np.repeat(piece, sizes).astype(np.int32)
        ids[ids < 0] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, sizes

    def _frontier(self, segment: str):
        """(start, its arcs as (end, piece)) along a segment of any length, ``CHUNK`` starts at a time."""
        s = segment.replace(SPACE, ESCAPED).replace(" ", SPACE)
        for at in range(0, len(s), CHUNK):
            points = codepoints(s[at : at + CHUNK + self.longest])
            most = min(CHUNK, len(points))
            start, end, piece = self._arcs(points, most)
            order = np.argsort(start, kind="stable")
            bounds = np.r_[0, np.cumsum(np.bincount(start, minlength=most))].tolist()
            end, piece = (end[order] + at).tolist(), piece[order].tolist()
            for i in range(most):
                yield i + at, zip(end[bounds[i] : bounds[i + 1]], piece[bounds[i] : bounds[i + 1]], strict=True)

    def _long_path(self, segment: str) -> bytes:
        best, back, by = (array(t, [v]) * (len(segment) + 1) for t, v in (("d", math.inf), ("i", 0), ("i", 0)))
        best[0], cost = 0.0, self.cost.tolist()
        for i, arcs in self._frontier(segment):
            for j, k in arcs:
                c = best[i] + cost[k]
                if c < best[j]:
                    best[j], back[j], by[j] = c, i, k
        starts, pieces, j = array("i"), array("i"), len(segment)
        while j:
            starts.append(back[j])
            pieces.append(by[j])
            j = back[j]
        places, piece = np.array(starts[::-1]), np.array(pieces[::-1], np.int32)
        points = np.array([ord(ESCAPED) if segment[i] == SPACE else ord(segment[i]) for i in places[piece < 0].tolist()], np.uint32)
        every = np.zeros(len(piece), np.uint32)
        every[piece < 0] = points
        return self._spelled(every, piece)[0].tobytes()

    # -- texts

    def encode(self, texts: list[str | None], held: dict[str, bytes], most: int = 50_000) -> list[list[bytes] | None]:
        """For each text the ids of its segments, as bytes of 32-bit integers. Segments are looked up once a batch; ``held``, a task's own,
        remembers up to ``most`` of them."""
        cut = [self.segments(t) if t is not None else None for t in texts]
        new = [s for s in dict.fromkeys(s for c in cut if c for s in c) if s not in held]
        if len(held) + len(new) > most:
            held.clear()
            new = list(dict.fromkeys(s for c in cut if c for s in c))
        held.update(zip(new, self.paths(new), strict=True))
        return [[held[s] for s in c] if c is not None else None for c in cut]

    def decoded(self, spelled: bytes) -> str:
        """The text of the bytes that all ids of a text spell."""
        text = spelled.decode("utf-8", "replace")
        return text[1:] if self.normalise.prefix and text.startswith(" ") else text

    # -- sums over all paths

    def weighted(self) -> None:
        """Set the log weights for sums over paths; they sum to one over pieces, bytes and end.

        Scores of this kind of file are negated ranks, not log probabilities: rank r weighs 1 / (r + 3); ranks beyond the vocabulary,
        bytes and the end weigh as the last rank. Scores of a unigram file (above -100, exponentials that sum to one at
        most) are taken as they are."""
        size = len(self.text)
        usable = [i for i, k in enumerate(self.kind) if k in (NORMAL, USER)]
        logs = min((self.score[i] for i in usable), default=0.0) > -100 and sum(math.exp(min(self.score[i], 50.0)) for i in usable) <= 1.01
        last = min((math.exp(self.score[i] - UNKNOWN_PENALTY) for i in usable), default=1.0) if logs else 1 / (size + 3)
        own = (lambda s: math.exp(s)) if logs else (lambda s: 1 / (min(-s, size) + 3))
        weight = np.array([own(s) if k in (NORMAL, USER) else last if k == BYTE else 0.0 for s, k in zip(self.score, self.kind, strict=True)])
        total = weight.sum() + last
        with np.errstate(divide="ignore"):
            self.log = np.log(weight / total)
        self.end_log = math.log(last / total)

    def _byte_logs(self, points: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Log weights of the fallback arcs of these characters."""
        raw = [(SPACE if c == ord(ESCAPED) else chr(c)).encode("utf-8", "replace") for c in points.tolist()]
        of = logs[self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]]
        return np.add.reduceat(of, np.r_[0, np.cumsum([len(r) for r in raw])[:-1]])

    def marginals(self, words: list[str], log: np.ndarray | None = None) -> np.ndarray:
        """log10 of the summed probability of all segmentations of each word with its space in front: the forward recursion in log space.
        ``log``: log weights by piece in place of the file's."""
        log = self.log if log is None else log
        out = np.empty(len(words))
        segments = [f" {w}" for w in words]
        for at in self._batches(segments):
            if len(segments[at[0]]) > CHUNK:
                out[at[0]] = self._long_marginal(segments[at[0]], log)
                continue
            points, first, ends, start, end, piece, bounds = self._lattice([segments[i] for i in at])
            weight = log[piece]
            lone = np.flatnonzero(piece < 0)
            if len(lone):
                weight[lone] = self._byte_logs(points[start[lone]], log)
            a = np.full(len(points), -np.inf)
            a[first] = 0.0
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                to = end[x:y]
                a[to] = np.logaddexp(a[to], a[start[x:y]] + weight[x:y])
            out[at] = a[ends]
        return out / math.log(10)

    def _long_marginal(self, segment: str, logs: np.ndarray) -> float:
        a = array("d", [-math.inf]) * (len(segment) + 1)
        a[0], log = 0.0, logs.tolist()
        for i, arcs in self._frontier(segment):
            for j, k in arcs:
                w = a[i] + (log[k] if k >= 0 else float(self._byte_logs(codepoints(segment[i].replace(SPACE, ESCAPED).replace(" ", SPACE)), logs)[0]))
                low, high = min(a[j], w), max(a[j], w)
                a[j] = high + math.log1p(math.exp(low - high)) if low > -math.inf else high
        return a[len(segment)]
