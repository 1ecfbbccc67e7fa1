"""SentencePiece encoding and decoding with a given model, by a batched Viterbi in numpy.

The segmentation with the greatest sum of piece scores is chosen. A model trained as a unigram
model states log probabilities; a model trained by merging states ranks, which are turned into
log probabilities of a Zipf law (``log 1 / (100 + rank)``). Its ids can differ from those of
merging pair by pair, as the whole best path is sought; decoding does not depend on that.

No piece of such a model reaches over a word start (a space after another character) and many
marks are in no piece after a letter, so texts are cut there without changing the result. Long words (text
without spaces) are cut further wherever no piece that occurs reaches over. Each distinct word of a task is
segmented once. Substrings of all new words are hashed and looked up among the sorted hashes of the
pieces of their length; words of equal length then advance together, one position at a time,
and vectorised maxima keep the backpointers. A long stretch whose pieces overlap without end (such as base64) cannot
be batched with others: it advances alone, window by window.

A character that is no piece is written as its bytes, so decoding gives every text back. The
mark that stands for a space is written as bytes too where a text itself holds it.

Ties: of several best segmentations the one whose last differing piece is shortest.

Defined cases: a NULL or empty text has no ids; repeated rows are encoded each for itself;
NULL ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from levelbook.llm.frames import BATCH_BYTES, documents, map_arrow, sub_batches, texts_of
from levelbook.llm.scan import RangeHash, by_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁".encode()
# Stands for the mark where a text itself holds it; no text in UTF-8 holds this byte.
OWN_MARK = b"\xff"
# Words over this many bytes are cut where no piece reaches over; parts that stay longer advance alone.
LONG = 64
# Long words are read in windows of so many bytes.
WINDOW = 1 << 16
# New words are segmented in groups of about this many bytes.
GROUP_BYTES = 1 << 16
# A task forgets its words after this many.
KNOWN_WORDS = 1 << 18
LEADING_BITS = 18
# Ids are decoded so many at a time.
DECODED = 1 << 18

@dataclass
class Model:
    """Pieces by length: sorted hashes, with the ids and scores in that order."""

    lengths: list[int]
    hashes: dict[int, np.ndarray]
    ids: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]
    leading: dict[int, np.ndarray]  # which leading bits of a hash occur, so that few probes search
    unknown: float
    byte_ids: np.ndarray
    text: list[bytes]
    words: re.Pattern

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        text, byte_ids, by_length = [b""] * size, np.full(256, -1, dtype=np.int64), {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = piece.encode()
                if SPACE in raw.lstrip(SPACE):
                    raise ValueError(f"piece {i} reaches over a word start")
                text[i] = raw.replace(SPACE, b" ")
                by_length.setdefault(len(raw), []).append((raw, i, sp.get_score(i)))
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        hashes, ids, scores, leading = {}, {}, {}, {}
        for length, found in by_length.items():
            joined = np.frombuffer(b"".join(raw for raw, _, _ in found), dtype=np.uint8)
            starts = np.arange(len(found)) * length
            keys = RangeHash(joined).of(starts, starts + length)
            order = np.argsort(keys)
            hashes[length] = keys[order]
            ids[length] = np.array([i for _, i, _ in found])[order]
            scores[length] = np.array([s for _, _, s in found])[order]
            leading[length] = np.zeros(1 << LEADING_BITS, dtype=bool)
            leading[length][keys >> np.uint64(64 - LEADING_BITS)] = True
        if all((s <= 0).all() and (s == np.rint(s)).all() for s in scores.values()):
            scores = {length: -np.log(100.0 - s) for length, s in scores.items()}
        least = min(s.min() for s in scores.values())
        return cls(sorted(hashes), hashes, ids, scores, leading, least - 10.0, byte_ids, text, _word_pattern(text))


def _word_pattern(pieces: list[bytes]) -> re.Pattern:
    """Cuts a text before spaces, around line ends if no piece holds one, and before marks that
    follow a byte after which no piece holds a mark."""
    marks = {c for c in range(33, 127) if not chr(c).isalnum()}
    pairs = {pair for piece in pieces for pair in zip(piece, piece[1:], strict=False)}
    joined = {a for a, b in pairs if b in marks and a not in marks and a != 32}

    def any_of(found: set[int]) -> bytes:
        return b"".join(re.escape(bytes([c])) for c in sorted(found))

    line = b"" if any(10 in pair for pair in pairs) else b"\\n"
    own, rest = b"[" + any_of(marks) + b"]", b"[^ " + line + any_of(marks) + b"]"
    more = rest + b"+"
    if joined:
        more = b"(?:" + more + b"|(?<=[" + any_of(joined) + b"])" + own + b"+)"
    word = b" +" + own + b"*" + more + b"*|" + own + b"+" + more + b"*|" + more + (b"+" if joined else b"")
    return re.compile(word + (b"|" + line if line else b""))


@lru_cache(maxsize=2)
def _model(path: str) -> Model:
    return Model.load(path)


def _steps(raw: bytes, model: Model, before: int) -> tuple[np.ndarray, ...]:
    """All steps that begin in ``raw[:before]``, as begins, ends, scores and ids: pieces, and characters
    that are none (id -1). Ordered by end, then by length."""
    buffer = np.frombuffer(raw, dtype=np.uint8)
    n = len(buffer)
    hasher = RangeHash(buffer)
    width = np.where(buffer >= 0xF0, 4, np.where(buffer >= 0xE0, 3, np.where(buffer >= 0xC0, 2, 1)))
    strange = (buffer & 0xC0) != 0x80
    strange[before:] = False
    found = []
    for length in model.lengths:
        if length > n:
            break
        keys = hasher.windows(length)[:before]
        likely = np.flatnonzero(model.leading[length][keys >> np.uint64(64 - LEADING_BITS)])
        table = model.hashes[length]
        at = np.minimum(np.searchsorted(table, keys[likely]), len(table) - 1)
        hit = table[at] == keys[likely]
        begin, at = likely[hit], at[hit]
        strange[begin[width[begin] == length]] = False
        found.append((begin, begin + length, model.scores[length][at], model.ids[length][at]))
    odd = np.flatnonzero(strange)
    found.append((odd, np.minimum(odd + width[odd], n), np.full(len(odd), model.unknown), np.full(len(odd), -1)))
    begin, end, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((end - begin, end))
    return begin[order], end[order], score[order], ids[order]


def safe_parts(word: bytes, model: Model) -> Iterator[list[bytes]]:
    """``word`` cut wherever no step reaches over, a list of parts per window."""
    reach = model.lengths[-1] + 4
    first, before, ahead = 0, 0, np.zeros(reach + 1, dtype=np.int64)
    for a in range(0, len(word), WINDOW):
        n = min(WINDOW, len(word) - a)
        begin, end, _, _ = _steps(word[a:a + WINDOW + reach], model, n)
        # How many steps reach over the place before each byte.
        change = np.bincount(begin + 1, minlength=n + reach + 1) - np.bincount(end, minlength=n + reach + 1)
        change[: reach + 1] += ahead
        over = before + np.cumsum(change[:n])
        before, ahead = int(over[-1]), change[n:n + reach + 1]
        parts = []
        for cut in (a + np.flatnonzero(over == 0)).tolist():
            if cut > first:
                parts.append(word[first:cut])
                first = cut
        yield parts
    if first < len(word):
        yield [word[first:]]


def long_path(word: bytes, model: Model) -> np.ndarray:
    """The ids of one long word, window by window; of equally good steps to a place the shortest one."""
    reach = model.lengths[-1] + 4
    size = len(word)
    best = [0.0] + [-np.inf] * (WINDOW + reach)
    taken, ids = np.zeros(size + 1, dtype=np.uint16), np.zeros(size + 1, dtype=np.int32)
    for a in range(0, size, WINDOW):
        n = min(WINDOW, size - a)
        own_taken, own_ids = taken[a:a + n + reach].tolist(), ids[a:a + n + reach].tolist()
        for begin, end, score, i in zip(*(x.tolist() for x in _steps(word[a:a + WINDOW + reach], model, n)), strict=True):
            total = best[begin] + score
            if total > best[end] or (total == best[end] and end - begin < own_taken[end]):
                best[end], own_taken[end], own_ids[end] = total, end - begin, i
        taken[a:a + len(own_taken)], ids[a:a + len(own_ids)] = own_taken, own_ids
        best = best[WINDOW:] + [-np.inf] * WINDOW
    out, at = [], size
    while at > 0:
        i, step = int(ids[at]), int(taken[at])
        out.extend([i] if i >= 0 else model.byte_ids[list(word[at - step:at])].tolist()[::-1])
        at -= step
    return np.array(out[::-1], dtype=np.int32)


def segment(words: list[bytes], model: Model) -> list[np.ndarray]:
    """The ids of each word. A word holds no space; spaces stand as ``SPACE``, or as NUL-free
    bytes of their own where the text held the mark (see :func:`_marked`)."""
    out: list[np.ndarray | None] = [None] * len(words)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    buffer = np.frombuffer(b"".join(words), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = len(buffer)
    left = np.repeat(starts[1:], sizes) - np.arange(n)  # bytes to the end of the word
    hasher = RangeHash(buffer)
    lengths, score, ids = [], [], []
    for length in model.lengths:
        if length > sizes.max(initial=0):
            break
        found = hasher.windows(length)
        likely = model.leading[length][found >> np.uint64(64 - LEADING_BITS)]
        fits = np.flatnonzero(likely & (left[: len(found)] >= length))
        keys = found[fits]
        table = model.hashes[length]
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        hit = table[at] == keys
        if length > 4 and not hit.any():
            continue
        lengths.append(length)
        score.append(np.full(n, -np.inf, dtype=np.float32))
        ids.append(np.zeros(n, dtype=np.int32))
        score[-1][fits[hit]] = model.scores[length][at[hit]]
        ids[-1][fits[hit]] = model.ids[length][at[hit]]
    score, ids = np.array(score).reshape(len(lengths), n), np.array(ids).reshape(len(lengths), n)
    # A character that is no piece: one step over all its bytes, marked by id -1.
    strange = np.zeros(n + 1, dtype=np.int64)
    lead = (buffer & 0xC0) != 0x80
    width = np.where(buffer >= 0xF0, 4, np.where(buffer >= 0xE0, 3, np.where(buffer >= 0xC0, 2, 1)))
    for size in (1, 2, 3, 4):
        if size in lengths:
            k = lengths.index(size)
            alone = lead & (width == size) & (left >= size) & np.isneginf(score[k])
            score[k, alone] = model.unknown
            ids[k, alone] = -1
            strange[1:] += alone
    steps = np.array(lengths)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        if size:
            for w, path in zip(which, _paths(score, ids, starts[which], int(size), steps), strict=True):
                out[w] = path
    empty = np.empty(0, dtype=np.int32)
    out = [empty if path is None else path for path in out]
    strange = np.cumsum(strange)
    for w in np.flatnonzero(strange[starts[1:]] > strange[starts[:-1]]):
        out[w] = _bytes_filled(out[w], words[w], model)
    return out


def _paths(score: np.ndarray, ids: np.ndarray, starts: np.ndarray, size: int, steps: np.ndarray) -> list[np.ndarray]:
    """Best paths of words of one length, advancing together."""
    n = len(starts)
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0.0
    back = np.zeros((size + 1, n), dtype=np.int16)
    for end in range(1, size + 1):
        usable = np.flatnonzero(steps <= end)
        for k in usable:
            begin = end - steps[k]
            total = best[begin] + score[k, starts + begin]
            better = total > best[end]
            np.copyto(best[end], total, where=better)
            np.copyto(back[end], np.int16(k), where=better)
    found = np.zeros((size, n), dtype=np.int32)
    count = np.zeros(n, dtype=np.int64)
    at = np.full(n, size)
    live = np.arange(n)
    while len(live):
        k = back[at[live], live]
        at[live] -= steps[k]
        found[count[live], live] = ids[k, starts[live] + at[live]]
        count[live] += 1
        live = live[at[live] > 0]
    return [found[: count[i], i][::-1] for i in range(n)]


def _bytes_filled(path: np.ndarray, word: bytes, model: Model) -> np.ndarray:
    """``path`` with the steps over unknown characters (id -1) replaced by the ids of their bytes."""
    if (path >= 0).all():
        return path
    out, at = [], 0
    for i in path.tolist():
        if i >= 0:
            out.append(i)
            piece = model.text[i]
            at += len(piece) + 2 * piece.count(b" ")
        else:
            first = word[at]
            width = 4 if first >= 0xF0 else 3 if first >= 0xE0 else 2 if first >= 0xC0 else 1
            out.extend(model.byte_ids[list(word[at:at + width])].tolist())
            at += width
    return np.array(out, dtype=np.int32)


class _Numbers(dict):
    """Numbers what it is asked for in the order of first sight."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


class Encoder:
    """Encodes texts of one task; keeps the segmentation of words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self._index = _Numbers()
        self._flat = np.empty(0, dtype=np.int32)
        self._sizes = np.empty(0, dtype=np.int64)
        self._starts = np.empty(0, dtype=np.int64)

    def _cut(self, word: bytes) -> Iterator[list[bytes]]:
        """A word as parts that are segmented each for itself. A mark that the text itself holds
        is a part, as it is written as bytes."""
        for i, part in enumerate(word.split(SPACE)):
            if i:
                yield [OWN_MARK]
            part = part.replace(b" ", SPACE)
            if len(part) > LONG:
                yield from safe_parts(part, self.model)
            elif part:
                yield [part]

    def _learn(self, words: list[bytes]) -> None:
        parts = _Numbers()
        plans = [
            np.concatenate([np.fromiter(map(parts.__getitem__, some), dtype=np.int64, count=len(some)) for some in self._cut(word)])
            for word in words
        ]
        known = [np.empty(0, dtype=np.int32)] * len(parts)
        short = []
        for part, number in parts.items():
            if part == OWN_MARK:
                known[number] = self.model.byte_ids[list(SPACE)].astype(np.int32)
            elif len(part) > LONG:
                known[number] = long_path(part, self.model)
            else:
                short.append((part, number))
        for group in by_bytes(short, GROUP_BYTES, lambda x: len(x[0])):
            for (_, number), path in zip(group, segment([part for part, _ in group], self.model), strict=True):
                known[number] = path
        found = [known[plan[0]] if len(plan) == 1 else np.concatenate([known[p] for p in plan.tolist()]) for plan in plans]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        self._flat = np.concatenate([self._flat, *found])
        self._sizes = np.concatenate([self._sizes, sizes])
        self._starts = np.cumsum(self._sizes) - self._sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text begins and ends in it."""
        if len(self._index) > KNOWN_WORDS:
            self._forget()
        index, which, firsts = self._index, [], [0]
        known, words = len(index), self.model.words.findall
        for text in texts:
            if text:
                which.extend(map(index.__getitem__, words(b" " + text)))
            firsts.append(len(which))
        if len(index) > known:
            self._learn(list(islice(index, known, None)))
        chosen = np.array(which, dtype=np.int64)
        sizes = self._sizes[chosen]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(self._starts[chosen] - ends[:-1], sizes)
        return self._flat[at], ends[firsts]


def decode_ids(ids: np.ndarray, bounds: np.ndarray, model: Model) -> list[bytes]:
    """The texts of several id sequences that lie in one array."""
    sizes = np.array([len(t) for t in model.text])
    joined = np.frombuffer(b"".join(model.text), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    flat = []
    for a in range(0, len(ids), DECODED):
        some = ids[a:a + DECODED]
        each = sizes[some]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat.append(joined[np.arange(ends[-1]) + np.repeat(starts[some] - ends[:-1], each)].tobytes())
    whole = b"".join(flat)
    edges = np.concatenate([[0], np.cumsum(sizes[ids])])[bounds].tolist()
    # The space before the first word is not part of the text.
    return [whole[a + 1:b] if b > a else b"" for a, b in zip(edges, edges[1:], strict=False)]


def _ids_column(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: ``doc_id``, ``ids``, ``n_tokens``, ``n_bytes`` (of the text),
    ``decoded_sha256`` and ``round_trip``, whether decoding gives the text back.

    ``model`` is a path that every executor can read. One pass, no shuffle; a batch holds about
    a megabyte of text, or one longer text.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = Encoder(_model(model))
        for batch in batches:
            for part in sub_batches(batch, size=4 * BATCH_BYTES):
                texts = texts_of(part.column("text"))
                ids, bounds = encoder.encode(texts)
                back = decode_ids(ids, bounds, encoder.model)
                yield {
                    "doc_id": part.column("doc_id"),
                    "ids": _ids_column(ids, bounds),
                    "n_tokens": np.diff(bounds),
                    "n_bytes": [len(t) for t in texts],
                    "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in back],
                    "round_trip": [a == b for a, b in zip(texts, back, strict=True)],
                }

    chosen = documents(docs, id_col, text_col).select("doc_id", "text")
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, n_tokens long, n_bytes long, decoded_sha256 string, round_trip boolean"
    return map_arrow(chosen, work, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``text`` of id sequences. NULL sequences give empty texts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces = _model(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = part.column("ids")
                ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.array([0 if x is None else len(x) for x in column], dtype=np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                texts = decode_ids(ids, bounds, pieces)
                yield {"doc_id": part.column("doc_id"), "text": pa.array(texts, type=pa.binary()).cast(pa.string())}

    chosen = encoded.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids")
    return map_arrow(chosen, work, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, text string")
