"""Scoring of texts by logistic mixing of bit predictors that know contexts.

Texts are sequences of words, lower-cased in A-Z, closed by an end. A word is coded byte by
byte, bit by bit, with a space after its last byte; the end is a byte that no word starts with. Predictors
hold counts of zeros and ones per context and bit. Their log odds are mixed with weights chosen by
gates, and the mixed probability is refined by a table of what came true after it. All together
give the probability of the text, hence its bits per byte.

The first two bytes of a word, its front, are coded after the word before, by three predictors: the
beginning alone, the beginning after the last two bytes of the word before, and the beginning after the whole
word before. The other bytes are coded by four: after the last one, two and three bytes, and after the whole
beginning of the word. The gates say how often the contexts were seen; each set of weights learns
from its own error, and their log odds are averaged.

How it scales. What a front costs depends on the word before and the front, what the rest costs on the word
alone, so everything that learns works on distinct words and distinct (word, front after it),
with their counts. Documents are read once, in blocks; a block gives its distinct words in order, the
fronts after each, and every document as numbers of the block's words. The sorted vocabulary is
cut into chunks at words chosen by their own hash, so chunks depend on the table alone; a chunk
holds all words that share a beginning and all fronts after them, hence whole contexts. A beginning that
the cut divides counts as unseen, on both sides. Blocks send each chunk its part in one compressed row, are
merged there, and get the scores back in the same order. A frequent word is at most its distinct fronts per
block, so it makes no chunk hot. The vocabulary and the fronts after its words grow with the corpus and
nowhere lie together. Contexts of up to three bytes are one table for all, of a fixed size: at most 2^18
contexts a kind, longer ones hashed. Weights are learnt online along each chunk, from the same start, each word
predicted as if it had been seen once less, and averaged; the refinement is counted on the way.

Defined cases: a NULL or empty text is an end alone; documents whose id's CRC-32 as text is a
multiple of 10 are held out (a NULL id counts as empty text, so it is held out); repeated rows
are documents like others; without any training document all counts are 0 and the model gives
every bit one half; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.llm.frames import map_arrow, sub_batches, texts_of, written
from levelbook.llm.scan import RangeHash, mix

SLOT_BITS = 19
# The vocabulary is cut into chunks of about this many bytes.
CHUNK_BYTES = 1 << 18
# At most about so many chunks, as their bounds are sent to every task.
CHUNKS_BITS = 30
BLOCK_BYTES = 16 << 20
# Words are coded in groups of about this many bytes.
GROUP_BYTES = 1 << 17
# The weights learn after every so many bytes.
LEARN_BYTES = 1 << 13
# Added to both counts of a context.
PRIOR = 0.02
RATE = 3.0
# Keeps the first steps of a gate small.
POWER = 100.0
#: Counts are told apart by their logarithm in this many levels.
LEVELS = 10
_LEVEL_OF = np.frexp(np.arange((1 << (LEVELS - 2)) + 1))[1].astype(np.int64)
# Steps of the mixed log odds in the refinement, from -12 to 12.
STEPS = 25
CELLS = 256 * 8 * STEPS
REFINE_PRIOR = 20.0
END = 0x0A
SPACE = 0x20
FRONT = 2
# Bounds of chunks are cut after so many bytes.
BOUND_BYTES = 32
# Kinds of short contexts, and bits of the hashed ones.
START, TAIL, ONE, TWO, THREE = range(5)
SHORT_BITS = 18
# The table of short contexts is put together in so many parts.
PARTS = 16
# Sums by key are merged whenever so many entries have come together.
MERGE_AT = 1 << 20


@dataclass(frozen=True)
class Kind:
    """A set of predictors and its gates: the predictors whose levels choose weights (never the first); one
    alone does so together with the number of the bit."""

    predictors: int
    gating: tuple[tuple[int, ...], ...]

    @property
    def gates(self) -> tuple[int, ...]:
        return tuple(LEVELS * (LEVELS if len(g) == 2 else 8) for g in self.gating)

    def rows(self, levels: list[np.ndarray], bit: int) -> list[np.ndarray]:
        return [levels[g[0]] * 8 + bit if len(g) == 1 else levels[g[0]] * LEVELS + levels[g[1]] for g in self.gating]

    def first_weights(self) -> list[np.ndarray]:
        return [np.full((n, self.predictors), 0.3) for n in self.gates]


FRONTS, RESTS = Kind(3, ((2,), (1,))), Kind(4, ((3,), (2, 1)))
KINDS = (FRONTS, RESTS)


def packed(*arrays: np.ndarray) -> bytes:
    """Whole and real numbers in one compressed text, byte by byte of their places."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        out += [a.dtype.str.encode().ljust(4), struct.pack("<Q", len(a))]
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes())
    return zlib.compress(b"".join(out), 1)


def unpacked(blob: bytes) -> list[np.ndarray]:
    data, at, out = zlib.decompress(blob), 4, []
    for _ in range(struct.unpack_from("<I", data)[0]):
        kind = np.dtype(data[at:at + 4].decode().strip())
        n = struct.unpack_from("<Q", data, at + 4)[0]
        at += 12
        planes = np.frombuffer(data, dtype=np.uint8, count=n * kind.itemsize, offset=at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += n * kind.itemsize
    return out


def _words_blob(words: Sequence[bytes]) -> bytes:
    return zlib.compress(b"\n".join(words), 1)


def _words_in(blob: bytes) -> list[bytes]:
    return zlib.decompress(blob).split(b"\n")


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their whole values."""
    if not keys:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    key, value = np.concatenate(keys), np.concatenate(values).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    return key[first], np.add.reduceat(value, first) if len(first) else value


class Sums:
    """Sums of whole values by key, from many pieces, with bounded memory beside the result."""

    def __init__(self):
        self._keys, self._values, self._n, self._at = [], [], 0, MERGE_AT

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self._keys.append(keys)
        self._values.append(values)
        self._n += len(keys)
        if self._n > self._at:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, values = summed(self._keys, self._values)
        self._keys, self._values, self._n = [keys], [values], len(keys)
        self._at = max(MERGE_AT, 2 * len(keys))
        return keys, values


class Nodes:
    """Counts of contexts as binary trees over the bits of the next byte: zeros, ones and ``child``
    per node; node 0 is what was never seen.

    ``contexts``, ``symbols`` and ``seen`` are sorted by context and next byte, each pair once.
    """

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray, seen: np.ndarray):
        new = np.ones(len(contexts), dtype=bool)
        new[1:] = contexts[1:] != contexts[:-1]
        self.contexts = contexts[new]
        path = (np.cumsum(new) - 1) << 8 | symbols.astype(np.int64)
        counts, edges, base, last = [np.zeros((1, 2), dtype=np.float32)], [], 1, None
        for b in range(8):
            prefix = path >> (8 - b)
            new[1:] = prefix[1:] != prefix[:-1]
            node = base - 1 + np.cumsum(new)
            if last is not None:
                edges.append((last[new], node[new]))
            last = node * 2 + (path >> (7 - b) & 1)
            size = int(new.sum())
            counts.append(np.bincount(last - base * 2, weights=seen, minlength=size * 2).reshape(-1, 2).astype(np.float32))
            base += size
        self.child = np.zeros(base * 2, dtype=np.int32 if base < 1 << 30 else np.int64)
        for place, node in edges:
            self.child[place] = node
        self.zeros, self.ones = (np.concatenate([c[:, v] for c in counts]) for v in (0, 1))

    def roots(self, contexts: np.ndarray) -> np.ndarray:
        """The first nodes of some contexts."""
        if not len(self.contexts):
            return np.zeros(len(contexts), dtype=self.child.dtype)
        # Equal contexts are looked up once, and the others in order, which keeps the search local.
        wanted, place = np.unique(contexts, return_inverse=True)
        at = np.minimum(np.searchsorted(self.contexts, wanted), len(self.contexts) - 1)
        return np.where(self.contexts[at] == wanted, at + 1, 0).astype(self.child.dtype)[place]

    @cached_property
    def odds(self) -> np.ndarray:
        return np.log((self.ones + np.float32(PRIOR)) / (self.zeros + np.float32(PRIOR)))

    @cached_property
    def level(self) -> np.ndarray:
        return _level(self.zeros + self.ones).astype(np.int8)


def _level(counts: np.ndarray) -> np.ndarray:
    """0 for nothing, then one level per doubling."""
    return _LEVEL_OF[np.minimum(counts, len(_LEVEL_OF) - 1).astype(np.int64)]


@lru_cache(maxsize=1)
def short_nodes(blob: bytes) -> Nodes:
    keys, seen = unpacked(blob)
    return Nodes(keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.uint8), seen)


@dataclass
class Coded:
    """Bytes to be coded: the context of each for every predictor, the byte before (0 for none),
    how often it was seen, and what it belongs to."""

    symbols: np.ndarray
    contexts: list[np.ndarray]
    last: np.ndarray
    seen: np.ndarray
    owner: np.ndarray

    def part(self, which) -> Coded:
        return Coded(
            self.symbols[which], [c[which] for c in self.contexts], self.last[which], self.seen[which], self.owner[which]
        )

    def parts(self, size: int) -> Iterator[Coded]:
        for a in range(0, len(self.symbols), size):
            yield self.part(slice(a, a + size))

    def bits(self, nodes: list[Nodes]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Per bit, the highest first: its number, its value, and the node of every predictor."""
        rows = [n.roots(c) for n, c in zip(nodes, self.contexts, strict=True)]
        for b in range(8):
            value = (self.symbols >> (7 - b) & 1).astype(bool)
            yield b, value, rows
            if b < 7:
                rows = [n.child[row * 2 + value] for n, row in zip(nodes, rows, strict=True)]


def _short(kind: int, payload: np.ndarray, hashed: bool = False) -> np.ndarray:
    if hashed:
        payload = mix(payload + np.uint64(kind)) >> np.uint64(64 - SHORT_BITS)
    return payload | np.uint64(kind << 48)


def fronts_of(words: Sequence[bytes]) -> np.ndarray:
    """The first two coded bytes of words as numbers; the end has one."""
    return np.array([w[0] << 8 | (w[1] if len(w) > 1 else SPACE) if w else END << 8 for w in words], dtype=np.uint16)


def _beginning(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ sizes.astype(np.uint64))


def beginnings_of(word: bytes) -> np.ndarray:
    """The contexts that the beginnings of a word from :data:`FRONT` bytes on are, the whole word included."""
    ends = np.arange(FRONT, len(word) + 1)
    hasher = RangeHash(np.frombuffer(word, dtype=np.uint8))
    return _beginning(hasher.of(np.zeros(len(ends), dtype=np.int64), ends), ends)


def code_rests(words: list[bytes], counts: np.ndarray) -> Coded:
    """The bytes of words after their fronts."""
    coded = [w + b" " if w else b"" for w in words]
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    s = np.frombuffer(b"".join(coded), dtype=np.uint8)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.arange(len(s)) - start
    at = np.flatnonzero(inside >= FRONT)
    start, inside, wide = start[at], inside[at], s.astype(np.uint64)
    one = wide[at - 1]
    two = wide[at - 2] << np.uint64(8) | one
    third = np.where(inside > 2, wide[np.maximum(at - 3, 0)], np.uint64(256))
    three = (third << np.uint64(16) | two) << np.uint64(1) | (inside == 3).astype(np.uint64)
    contexts = [
        _short(ONE, one), _short(TWO, two | (inside == 2).astype(np.uint64) << np.uint64(16)), _short(THREE, three, True),
        _beginning(RangeHash(s).of(start, at), inside),
    ]
    owner = np.repeat(np.arange(len(words)), sizes)[at]
    return Coded(s[at].astype(np.int64), contexts, one.astype(np.int64), counts[owner], owner)


def code_fronts(words: list[bytes], fan: np.ndarray, fronts: np.ndarray, seen: np.ndarray) -> tuple[Coded, np.ndarray]:
    """The bytes of the fronts after words, each distinct beginning once, and the first bytes' places.

    ``fronts`` are sorted after each word, ``fan`` tells how many there are after each. The first
    bytes come first; the second ones belong to the fronts that have one.
    """
    before = np.repeat(np.arange(len(words)), fan)
    first, second = (fronts >> 8).astype(np.int64), (fronts & 255).astype(np.int64)
    new = np.ones(len(fronts), dtype=bool)
    new[1:] = (before[1:] != before[:-1]) | (first[1:] != first[:-1])
    heads, place = np.flatnonzero(new), np.cumsum(new) - 1
    longer = np.flatnonzero(first != END)
    tails = np.array([int.from_bytes(w[-2:], "little") if w else 0 for w in words], dtype=np.uint64)
    row = np.concatenate([heads, longer])
    depth = np.concatenate([np.zeros(len(heads), dtype=np.uint64), (256 + first[longer]).astype(np.uint64)])
    word = before[row]
    contexts = [
        _short(START, depth), _short(TAIL, tails[word] << np.uint64(9) | depth, True), word.astype(np.uint64) << np.uint64(9) | depth,
    ]
    total = np.add.reduceat(seen, heads) if len(heads) else seen
    last = np.concatenate([np.zeros(len(heads), dtype=np.int64), first[longer]])
    symbols = np.concatenate([first[heads], second[longer]])
    owner = np.concatenate([np.arange(len(heads)), longer])
    return Coded(symbols, contexts, last, np.concatenate([total, seen[longer]]), owner), place


def _tree(contexts: list[np.ndarray], symbols: list[np.ndarray], seen: list[np.ndarray], without: np.ndarray | None = None) -> Nodes:
    """The counts of (context, byte), without some contexts."""
    context, symbol, times = (np.concatenate(x) if x else np.empty(0, dtype=np.uint64) for x in (contexts, symbols, seen))
    keep = times > 0
    if without is not None and len(without):
        keep &= ~np.isin(context, without)
    context, symbol, times = context[keep], symbol[keep], times[keep]
    order = np.lexsort((symbol, context))
    context, symbol, times = context[order], symbol[order], times[order]
    if not len(order):
        return Nodes(context.astype(np.uint64), symbol.astype(np.uint8), times)
    new = np.ones(len(order), dtype=bool)
    new[1:] = (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])
    first = np.flatnonzero(new)
    return Nodes(context[first], symbol[first].astype(np.uint8), np.add.reduceat(times, first))


@dataclass
class Chunk:
    """A run of the sorted vocabulary: words, their counts in training documents, the fronts after
    each and their counts, and the beginnings that the cuts divide."""

    words: list[bytes]
    counts: np.ndarray
    fan: np.ndarray
    fronts: np.ndarray
    seen: np.ndarray
    edges: np.ndarray

    def groups(self, order: np.ndarray, size: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, Coded]]:
        """Words in some order, in groups, with the bytes after their fronts."""
        start, total = 0, 0
        for i, n in enumerate([*(len(self.words[k]) + 1 for k in order), size + 1]):
            if i > start and total + n > size:
                own = order[start:i]
                yield own, code_rests([self.words[k] for k in own], self.counts[own])
                start, total = i, 0
            total += n

    @cached_property
    def coded_fronts(self) -> tuple[Coded, np.ndarray]:
        return code_fronts(self.words, self.fan, self.fronts, self.seen)

    @cached_property
    def beginnings(self) -> Nodes:
        """What came after the beginnings of the chunk's words."""
        found = [(g.contexts[3], g.symbols.astype(np.uint8), g.seen) for _, g in self.groups(np.flatnonzero(self.counts))]
        return _tree(*([f[i] for f in found] for i in range(3)), self.edges)

    @cached_property
    def after(self) -> Nodes:
        """What came after the chunk's words."""
        coded = self.coded_fronts[0]
        return _tree([coded.contexts[2]], [coded.symbols], [coded.seen])

    def short_contexts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Short contexts with the byte after, as one number, and how often."""
        for some in chain([self.coded_fronts[0]], (g for _, g in self.groups(np.flatnonzero(self.counts)))):
            used = some.part(some.seen > 0)
            for context in used.contexts[:-1]:
                yield summed([context << np.uint64(8) | used.symbols.astype(np.uint64)], [used.seen])


class Model:
    """Weights of both kinds and the refinement."""

    def __init__(self):
        self.weights = [k.first_weights() for k in KINDS]
        self.cells = np.zeros((len(KINDS) * CELLS, 2))

    @cached_property
    def refined(self) -> np.ndarray:
        center = np.tile(_logistic(np.linspace(-12.0, 12.0, STEPS)), len(self.cells) // STEPS)
        return (self.cells[:, 1] + REFINE_PRIOR * center) / (self.cells.sum(axis=1) + REFINE_PRIOR)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _mixed(odds: list[np.ndarray], gates: list[np.ndarray], weights: list[np.ndarray]) -> list[np.ndarray]:
    """The log odds that each set of weights gives."""
    out = []
    for gate, own in zip(gates, weights, strict=True):
        columns = np.ascontiguousarray(own.T)
        total = columns[0][gate] * odds[0]
        for k in range(1, len(odds)):
            total += columns[k][gate] * odds[k]
        out.append(np.clip(total, -12.0, 12.0))
    return out


def _cells(kind: int, bit: int) -> slice:
    """The refinement's part for a bit: a cell per byte before and step of the log odds."""
    first = (kind * 8 + bit) * 256 * STEPS
    return slice(first, first + 256 * STEPS)


def _cell(last: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return last * STEPS + np.rint((mixed + 12.0) * ((STEPS - 1) / 24.0)).astype(np.int64)


def learn_from(kind: int, coded: Coded, nodes: list[Nodes], weights: list[np.ndarray], cells: np.ndarray) -> float:
    """Online learning of the gated weights, in place, part by part, each byte predicted as if it had been seen once
    less; what came true is counted into ``cells``. Returns the weight of what was learnt from."""
    total = 0.0
    for some in coded.parts(LEARN_BYTES):
        importance = some.seen.astype(np.float64)
        total += float(importance.sum())
        for bit, value, rows in some.bits(nodes):
            one = value.astype(np.float32)
            odds, levels = [], []
            for n, row in zip(nodes, rows, strict=True):
                ones = np.maximum(n.ones[row] - one, 0)
                zeros = np.maximum(n.zeros[row] - (1 - one), 0)
                odds.append(np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))))
                levels.append(_level(zeros + ones) if len(levels) else None)
            gates = KINDS[kind].rows(levels, bit)
            mixed = _mixed(odds, gates, weights)
            cell = _cell(some.last, sum(mixed) / len(mixed)) * 2 + value
            cells[_cells(kind, bit)] += np.bincount(cell, weights=importance, minlength=512 * STEPS).reshape(-1, 2)
            strength = sum(o * o for o in odds) * importance
            for gate, own_mixed, own in zip(gates, mixed, weights, strict=True):
                error = (value - _logistic(own_mixed)) * importance
                power = np.bincount(gate, weights=strength, minlength=len(own)) + POWER
                for k, o in enumerate(odds):
                    own[:, k] += RATE * np.bincount(gate, weights=error * o, minlength=len(own)) / power
    return total


def learn_chunk(chunk: Chunk, short: Nodes, cells: np.ndarray) -> tuple[list[list[np.ndarray]], list[float]]:
    """The weights after learning along a chunk in mixed order, and what they learnt from."""
    weights, rng = [k.first_weights() for k in KINDS], np.random.default_rng(0)
    coded = chunk.coded_fronts[0]
    order = rng.permutation(np.flatnonzero(coded.seen))
    totals = [learn_from(0, coded.part(order), [short, short, chunk.after], weights[0], cells), 0.0]
    for _, group in chunk.groups(rng.permutation(np.flatnonzero(chunk.counts))):
        totals[1] += learn_from(1, group, [short, short, short, chunk.beginnings], weights[1], cells)
    return weights, totals


def costs(kind: int, coded: Coded, nodes: list[Nodes], model: Model) -> np.ndarray:
    """Log10 probabilities of bytes."""
    out = []
    for some in coded.parts(GROUP_BYTES):
        bits = np.zeros(len(some.symbols))
        for bit, value, rows in some.bits(nodes):
            levels = [None, *(n.level[row].astype(np.int64) for n, row in zip(nodes[1:], rows[1:], strict=True))]
            gates = KINDS[kind].rows(levels, bit)
            mixed = _mixed([n.odds[row] for n, row in zip(nodes, rows, strict=True)], gates, model.weights[kind])
            mean = sum(mixed) / len(mixed)
            p = 0.5 * _logistic(mean) + 0.5 * model.refined[_cells(kind, bit)][_cell(some.last, mean)]
            p = np.clip(p, 1e-7, 1 - 1e-7)
            bits += np.log10(np.where(value, p, 1 - p))
        out.append(bits)
    return np.concatenate(out) if out else np.zeros(0)


def score_chunk(chunk: Chunk, short: Nodes, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probabilities of the words after their fronts, and of the fronts after words."""
    rests = np.zeros(len(chunk.words))
    for own, group in chunk.groups(np.arange(len(chunk.words))):
        cost = costs(1, group, [short, short, short, chunk.beginnings], model)
        rests[own] = np.bincount(group.owner, weights=cost, minlength=len(own))
    coded, place = chunk.coded_fronts
    cost = costs(0, coded, [short, short, chunk.after], model)
    heads = len(cost) - int((chunk.fronts >> 8 != END).sum())
    fronts = cost[:heads][place] if len(place) else np.zeros(0)
    fronts[coded.owner[heads:]] += cost[heads:]
    return rests, fronts


# Spark side ---------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Block:
    """Documents read so far, as numbers of their words."""

    def __init__(self):
        self.index = _Numbers({b"": 0})
        self.batches: list[tuple[pa.RecordBatch, list[np.ndarray], list[int]]] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        numbers, sizes = [], []
        for text in texts_of(batch.column("text")):
            found = list(map(self.index.__getitem__, text.lower().split()))
            found.append(0)
            numbers.append(np.array(found, dtype=np.uint32))
            sizes.append(len(text))
            self.size += len(text)
        self.batches.append((batch.select(["doc_id", "held_out"]), numbers, sizes))

    def rows(self, block: int) -> Iterator[dict]:
        names = list(self.index)
        order = sorted(range(len(names)), key=names.__getitem__)
        words = [names[i] for i in order]
        rank = np.empty(len(names), dtype=np.uint32)
        rank[order] = np.arange(len(names), dtype=np.uint32)
        fronts, train, keys = fronts_of(words), np.zeros(len(words), dtype=np.int64), []
        id_type = None
        for batch, numbers, sizes in self.batches:
            held = batch.column("held_out").to_pylist()
            id_type = batch.schema.field("doc_id").type
            coded = [rank[s] for s in numbers]
            keys += [keys_of(s, fronts) << np.uint64(1) | np.uint64(not out) for s, out in zip(coded, held, strict=True)]
            learnt = [s for s, out in zip(coded, held, strict=True) if not out]
            if learnt:
                train += np.bincount(np.concatenate(learnt), minlength=len(words))
            n = len(numbers)
            yield {
                "block": [block] * n, "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "n_tokens": [len(s) for s in coded], "n_bytes": sizes, "words": [None] * n,
                "numbers": [packed(s) for s in coded],
            }
        keys = np.sort(np.concatenate(keys))
        learnt = (keys & np.uint64(1)).astype(np.int64)
        keys >>= np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, seen = keys[first], np.add.reduceat(learnt, first)
        fan = np.bincount((keys >> np.uint64(16)).astype(np.int64), minlength=len(words))
        yield {
            "block": [block], "doc_id": pa.nulls(1, id_type), "held_out": [None], "n_tokens": [None], "n_bytes": [None],
            "words": [_words_blob(words)],
            "numbers": [packed(train.astype("<u4"), fan.astype("<u4"), (keys & np.uint64(0xFFFF)).astype("<u2"), seen.astype("<u4"))],
        }


def keys_of(numbers: np.ndarray, fronts: np.ndarray) -> np.ndarray:
    """(word before, front) of every word of a text, as one number."""
    before = np.zeros(len(numbers), dtype=np.uint64)
    before[1:] = numbers[:-1]
    return before << np.uint64(16) | fronts[numbers].astype(np.uint64)


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row per document with the numbers of its words in the block, and one per block with its
    sorted words, their counts in training documents, and the fronts after each with their counts."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    chosen = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.pmod(F.crc32(name.cast("binary")), F.lit(10)) == 0).alias("held_out"),
    )
    kind = chosen.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for some in sub_batches(batch):
                block.add(some)
                if block.size >= block_bytes:
                    yield from block.rows(number)
                    number, block = number + 1, _Block()
        if block.batches:
            yield from block.rows(number)

    schema = (f"block long, doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_bytes long, "
              "words binary, numbers binary")
    return written(map_arrow(chosen, work, schema), "mixing-blocks")


def _bounds(blocks: DataFrame, every: int) -> list[bytes]:
    """Where the sorted vocabulary is cut: the words whose CRC-32 is a multiple of ``every``, cut to 32 bytes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for blob in batch.column("words").to_pylist():
                yield {"bound": [w[:BOUND_BYTES] for w in _words_in(blob) if w and zlib.crc32(w) % every == 0]}

    chosen = blocks.filter(F.col("words").isNotNull()).select("words")
    return sorted(bytes(r[0]) for r in map_arrow(chosen, work, "bound binary").distinct().collect())


def _packs(blocks: DataFrame, bounds: list[bytes]) -> DataFrame:
    """The part of each block that belongs to a chunk, in one row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = _words_in(batch.column("words")[i].as_py())
                train, fan, fronts, seen = unpacked(batch.column("numbers")[i].as_py())
                cuts = [0, *(bisect_left(words, b) for b in bounds), len(words)]
                places = np.concatenate([[0], np.cumsum(fan, dtype=np.int64)])
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if a < b:
                        own = slice(places[a], places[b])
                        yield {
                            "chunk": [k], "block": [batch.column("block")[i].as_py()], "words": [_words_blob(words[a:b])],
                            "numbers": [packed(train[a:b], fan[a:b], fronts[own], seen[own])],
                        }

    chosen = blocks.filter(F.col("words").isNotNull()).select("block", "words", "numbers")
    return map_arrow(chosen, work, "chunk int, block long, words binary, numbers binary")


def _chunks(packs: DataFrame, bounds: list[bytes]) -> DataFrame:
    """One row per chunk of the vocabulary, merged from all blocks."""
    def merge(found: pa.Table) -> pa.Table:
        index, counts, pairs = _Numbers(), Sums(), Sums()
        for i in range(found.num_rows):
            own = np.array([index[w] for w in _words_in(found.column("words")[i].as_py())], dtype=np.uint64)
            train, fan, fronts, seen = unpacked(found.column("numbers")[i].as_py())
            counts.add(own, train.astype(np.int64))
            pairs.add(np.repeat(own, fan) << np.uint64(16) | fronts.astype(np.uint64), seen.astype(np.int64))
        names = list(index)
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), dtype=np.uint64)
        rank[order] = np.arange(len(names), dtype=np.uint64)
        total = counts.total()[1][order]
        keys, seen = pairs.total()
        keys, seen = summed([rank[(keys >> np.uint64(16)).astype(np.int64)] << np.uint64(16) | keys & np.uint64(0xFFFF)], [seen])
        fan = np.bincount((keys >> np.uint64(16)).astype(np.int64), minlength=len(names))
        chunk = found.column("chunk")[0].as_py()
        edges = [beginnings_of(b) for b in bounds[max(0, chunk - 1):chunk + 1]]
        return pa.table({
            "chunk": pa.array([chunk], pa.int32()),
            "n_train": pa.array([int(total.sum())], pa.int64()),
            "n_known": pa.array([int((total > 0).sum())], pa.int64()),
            "words": pa.array([_words_blob([names[i] for i in order])], pa.binary()),
            "numbers": pa.array([packed(
                total.astype("<i8"), fan.astype("<u4"), (keys & np.uint64(0xFFFF)).astype("<u2"), seen.astype("<i8"),
                np.concatenate(edges) if edges else np.empty(0, dtype="<u8"),
            )], pa.binary()),
        })

    merged = packs.groupBy("chunk").applyInArrow(merge, "chunk int, n_train long, n_known long, words binary, numbers binary")
    return written(merged, "mixing-chunks")


def _opened(batches: Iterator[pa.RecordBatch | pa.Table]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(_words_in(batch.column("words")[i].as_py()), *unpacked(batch.column("numbers")[i].as_py()))


def _short_table(chunks: DataFrame) -> bytes:
    """The short contexts of all training words, with the byte after each and how often."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums = Sums()
        for chunk in _opened(batches):
            for keys, seen in chunk.short_contexts():
                sums.add(keys, seen)
        keys, seen = sums.total()
        part = mix(keys >> np.uint64(8)) % np.uint64(PARTS)
        for p in range(PARTS):
            own = part == p
            if own.any():
                yield {"part": [p], "numbers": [packed(keys[own], seen[own])]}

    def merge(found: pa.Table) -> pa.Table:
        sums = Sums()
        for blob in found.column("numbers").to_pylist():
            sums.add(*unpacked(blob))
        return pa.table({"numbers": pa.array([packed(*sums.total())], pa.binary())})

    parts = map_arrow(chunks.select("words", "numbers"), count, "part int, numbers binary")
    found = [unpacked(bytes(r[0])) for r in parts.groupBy("part").applyInArrow(merge, "numbers binary").collect()]
    return packed(*summed([k for k, _ in found], [s for _, s in found]))


def _learnt(chunks: DataFrame, short: bytes) -> Model:
    """Each chunk's weights after learning online over its words, averaged by what they learnt from,
    and the refinement.

    Every chunk starts from the same weights and is the same wherever it lies, and the sums are those of
    decimals, which any order of adding gives; so the model depends on the table alone.
    """
    sizes = [sum(k.gates) * k.predictors for k in KINDS]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cells = np.zeros((len(KINDS) * CELLS, 2))
        for chunk in _opened(batches):
            weights, totals = learn_chunk(chunk, short_nodes(short), cells)
            flat = np.concatenate([w.ravel() for own in weights for w in own])
            weight = np.repeat(totals, sizes)
            yield {"k": np.arange(len(flat), dtype=np.int32), "a": flat * weight, "b": weight}
        used = np.flatnonzero(cells.any(axis=1))
        yield {"k": (sum(sizes) + used).astype(np.int32), "a": cells[used, 0], "b": cells[used, 1]}

    exact = [F.sum(F.col(c).cast("decimal(28,8)")).cast("double").alias(c) for c in ("a", "b")]
    found = map_arrow(chunks.select("words", "numbers"), learn, "k int, a double, b double").groupBy("k").agg(*exact).toArrow()
    k, a, b = (found.column(c).to_numpy() for c in ("k", "a", "b"))
    model = Model()
    own = (k < sum(sizes)) & (b > 0)
    flat = np.concatenate([w.ravel() for weights in model.weights for w in weights])
    flat[k[own]] = a[own] / b[own]
    shapes = [w.shape for weights in model.weights for w in weights]
    cut = np.split(flat, np.cumsum([np.prod(s) for s in shapes])[:-1])
    both = [w.reshape(s) for w, s in zip(cut, shapes, strict=True)]
    model.weights = [both[:len(FRONTS.gates)], both[len(FRONTS.gates):]]
    cell = k >= sum(sizes)
    model.cells[k[cell] - sum(sizes)] = np.stack([a[cell], b[cell]], axis=1)
    return model


def _answers(packs: DataFrame, chunks: DataFrame, short: bytes, model: Model) -> DataFrame:
    """What every block asked each chunk: counts and scores of its words and of the fronts after them."""
    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        chunk = next(_opened([known]))
        rests, fronts = score_chunk(chunk, short_nodes(short), model)
        index = {w: i for i, w in enumerate(chunk.words)}
        keys = np.repeat(np.arange(len(chunk.words), dtype=np.uint64), chunk.fan) << np.uint64(16) | chunk.fronts.astype(np.uint64)
        out = []
        for i in range(asked.num_rows):
            words = _words_in(asked.column("words")[i].as_py())
            _, fan, own_fronts, _ = unpacked(asked.column("numbers")[i].as_py())
            own = np.array([index[w] for w in words], dtype=np.int64)
            wanted = np.repeat(own.astype(np.uint64), fan) << np.uint64(16) | own_fronts.astype(np.uint64)
            out.append(packed(
                chunk.counts[own], rests[own].astype("<f4"), fronts_of(words), fronts[np.searchsorted(keys, wanted)].astype("<f4")
            ))
        return pa.table({
            "block": asked.column("block"), "chunk": asked.column("chunk"), "numbers": pa.array(out, pa.binary()),
        })

    return packs.groupBy("chunk").cogroup(chunks.select("chunk", "words", "numbers").groupBy("chunk")).applyInArrow(
        answer, "block long, chunk int, numbers binary"
    )


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    slot_bits: int = SLOT_BITS,
    block_bytes: int = BLOCK_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (smoothed word frequencies), ``score`` (the model's log10
    probability) and ``bits_per_byte`` (of the whole text, NULL for an empty one). ``slot_bits``
    is taken for callers of older versions and changes nothing."""
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    bounds = _bounds(blocks, max(1, chunk_bytes // 16, total >> CHUNKS_BITS))
    packs = _packs(blocks, bounds)
    chunks = _chunks(packs, bounds)
    n_train, n_distinct = (x or 0 for x in chunks.agg(F.sum("n_train"), F.sum("n_known")).first())
    short = _short_table(chunks)
    answers = _answers(packs, chunks, short, _learnt(chunks, short))
    least = 0.1 / (n_train + 0.1 * (n_distinct + 1))

    def join(documents: pa.Table, found: pa.Table) -> pa.Table:
        parts = [unpacked(blob) for blob in found.sort_by("chunk").column("numbers").to_pylist()]
        c, rests, fronts, cost = (np.concatenate(x) for x in zip(*parts, strict=True))
        base = np.log10((c + 0.1) * (least / 0.1))
        rests, cost = rests.astype(np.float64), cost.astype(np.float64)
        texts = [unpacked(blob)[0] for blob in documents.column("numbers").to_pylist()]
        # The block's own order of its fronts: sorted by the word before.
        keys = Sums()
        for s in texts:
            own = np.unique(keys_of(s, fronts))
            keys.add(own, np.ones(len(own), dtype=np.int64))
        keys = keys.total()[0]
        out = {"n_known": [], "base_score": [], "score": []}
        for s in texts:
            place = np.searchsorted(keys, keys_of(s, fronts))
            out["n_known"].append(int((c[s] > 0).sum()))
            out["base_score"].append(float(base[s].sum()))
            out["score"].append(float((rests[s] + cost[place]).sum()))
        return pa.table({
            "doc_id": documents.column("doc_id"), "held_out": documents.column("held_out"),
            "n_tokens": documents.column("n_tokens"), "n_known": pa.array(out["n_known"], pa.int64()),
            "train_tokens": pa.array([n_train] * len(texts), pa.int64()),
            "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64()),
            "n_bytes": documents.column("n_bytes"),
        })

    rows = blocks.filter(F.col("words").isNull()).drop("words")
    kind = blocks.schema["doc_id"].dataType.simpleString()
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        join,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, n_bytes long",
    )
    bits = -F.col("score") / np.log10(2.0)
    return scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes"))).drop("n_bytes")
