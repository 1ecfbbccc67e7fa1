"""Vectorised scanning of many texts at once: words, their hashes, windows and minimisers.

Texts are handled as UTF-8. A word is a maximal run of bytes other than space and
0x09-0x0D, which never occur inside a multi-byte character. Everything below works on one
buffer of joined texts, so cost follows bytes, not the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = {}
# Tables of powers of up to this many entries are kept.
_KEPT = 1 << 20


def _power_table(base: int, n: int) -> np.ndarray:
    """1, base, base^2, .. modulo 2^64; the table is kept, unless it is large, and grows by doubling."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n <= _KEPT else n
        factors = np.full(size, base, dtype=U64)
        factors[0] = 1
        table = np.cumprod(factors)
        if size <= _KEPT:
            _powers[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class RangeHash:
    """Hashes of ranges of one integer sequence, each in constant time after one pass."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self._sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((values.astype(U64) + U64(1)) * _power_table(_BASE, n), out=self._sums[1:])
        self._n = n

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = self._sums[ends] - self._sums[starts]
        return mix(sums * _power_table(_INVERSE, self._n + 1)[starts])

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of ``width`` values, by its start."""
        if self._n < width:
            return np.empty(0, dtype=U64)
        sums = self._sums[width:] - self._sums[:-width]
        return mix(sums * _power_table(_INVERSE, len(sums)))


@dataclass
class Words:
    """The words of several texts, in order.

    ``starts`` and ``ends`` are byte positions in ``buffer``; ``hashes`` one value a word;
    ``first[i]:first[i + 1]`` are the words of text ``i``.
    """

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows_in_text(self, width: int) -> np.ndarray:
        """Whether the window of ``width`` words that starts at a word ends in the same text."""
        last = np.repeat(self.first[1:], self.counts)
        return np.arange(len(self.starts)) + width <= last


def split_words(texts: list[bytes], lower: bool = False) -> Words:
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    buffer = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    space = _IS_SPACE[buffer]
    if not len(texts):
        buffer, space = buffer[:0], space[:0]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    hashes = RangeHash(buffer).of(starts, ends)
    text_starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    return Words(buffer, starts, ends, hashes, np.searchsorted(starts, text_starts))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchored_runs(hasher: RangeHash, valid: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows that share their anchor.

    The anchor of a window of ``window`` values is the leftmost of its ``gram``-value parts with
    the least hash, so equal windows have equal anchors at equal places, wherever they stand.
    ``valid`` says of each start whether its window counts. Returns the starts of the runs, their
    numbers of windows and the anchors' hashes. A run has at most ``window - gram + 1`` windows.
    """
    grams = hasher.windows(gram)
    least = sliding_min(grams, window - gram + 1)
    at = np.flatnonzero(valid[: len(least)])
    if not len(at):
        return at, at, least[:0]
    anchors = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchors[1:] != anchors[:-1]) | (grams[at[:-1]] == anchors[:-1])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), anchors[first]


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of true values as (begin, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as sorted spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = out[-1][0], end
        else:
            out.append((begin, end))
    return out


def by_bytes(items: Iterable, size: int, length=len) -> Iterator[list]:
    """Lists of consecutive items of about ``size`` bytes; a longer item stands alone."""
    taken, total = [], 0
    for item in items:
        n = length(item)
        if taken and total + n > size:
            yield taken
            taken, total = [], 0
        taken.append(item)
        total += n
    if taken:
        yield taken
