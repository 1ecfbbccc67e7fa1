"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to ``k`` edits, a fixed share of its length. Cut
into ``k + 1`` pieces, at least one piece then occurs unchanged. All pieces go into one
automaton per shard of items, documents are streamed through it, and every hit is verified by
Myers' bit-parallel edit distance between the item and the text around the hit. Texts and
items are compared in lower case with single spaces.

Items are read in shards of at most about ``SHARD_BYTES``, so an automaton is bounded however many
items there are; each shard is one pass over the documents, which adds its hits to a row's.

Defined cases: NULL and empty texts contain nothing; NULL and empty items match nothing; items
with equal texts are all reported; an item too short for an edit matches whole words only, so "the"
is not found in "other"; repeated documents are matched each for itself; NULL ids
stay; an empty benchmark or an empty table gives no hits; other columns are ignored. Of several
places of one item in a document the best counts, and the first of equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.llm.frames import documents, map_arrow, sub_batches

ERROR_RATE = 0.08
SHARD_BYTES = 4 << 20
_HIT = ("item_id", "distance", "begin", "end")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, rate: float) -> int:
    """Edits allowed in an item of ``length`` characters."""
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``item`` in ``k + 1`` pieces of nearly equal length, with their starts."""
    edges = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def alphabet_bits(item: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def best_match(bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """The least edit distance between an item and any part of ``text``, and where it first ends.

    Myers' algorithm on whole-item bit vectors; ``bits`` come from :func:`alphabet_bits`.
    """
    every, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = every, 0, length
    best, end = length, 0
    for at, c in enumerate(text, 1):
        equal = bits.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & every
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & every, (down << 1) & every
        plus = down | ~(vertical | up) & every
        minus = up & vertical
        if score < best:
            best, end = score, at
    return best, end


def _inside_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


class Matcher:
    """Finds the items of one shard in texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        by_text: dict[str, list] = {}
        for key, text in items:
            if text:
                by_text.setdefault(text, []).append(key)
        self.items = [(keys, text, budget(len(text), rate), alphabet_bits(text)) for text, keys in by_text.items()]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k, _) in enumerate(self.items):
            for start, piece in pieces(text, k):
                places.setdefault(piece, []).append((i, start + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, found)
        if places:
            self.automaton.make_automaton()

    def matches(self, raw: str) -> Iterator[tuple[object, int, int, int]]:
        """Item key, distance, and begin of the searched part and end of the match in the
        normalised text."""
        if not self.items:
            return
        text = normal(raw)
        found: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, int] = {}
        for last, hits in self.automaton.iter(text):
            for i, piece_end in hits:
                _, item, k, bits = self.items[i]
                # The match begins within k characters of the place the piece suggests.
                begin = last + 1 - piece_end
                if begin + k < 0 or begin - k + len(item) > len(text) + k:
                    continue
                if not k and (_inside_word(text, begin) or _inside_word(text, begin + len(item))):
                    continue
                if i in tried and abs(begin - tried[i]) == 0:
                    continue
                tried[i] = begin
                if i in found and found[i][0] == 0:
                    continue
                a = max(0, begin - k)
                distance, end = best_match(bits, len(item), text[a:begin + len(item) + k])
                if distance <= k and (i not in found or distance < found[i][0]):
                    found[i] = distance, a, a + end
        for i, (distance, a, b) in sorted(found.items()):
            for key in self.items[i][0]:
                yield key, distance, a, b


def _shards(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[list[tuple[object, str]]]:
    """The items with a text, normalised, in lists of bounded size."""
    items = benchmark.select(F.col(item_col).alias("k"), F.col(text_col).cast("string").alias("t")).filter("t <> ''")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // size)
    for shard in range(n):
        rows = items if n == 1 else items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == shard)
        yield sorted(((r[0], normal(r[1])) for r in rows.collect()), key=lambda x: (x[1], str(x[0])))


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = ERROR_RATE,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per document row: ``doc_id`` and ``hits``, an array of (item_id, distance, begin,
    end). Nothing is shuffled."""
    chosen = documents(docs, id_col, text_col)
    doc_kind = chosen.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id_col].dataType.simpleString()
    hits = f"array<struct<item_id: {item_kind}, distance: int, begin: bigint, end: bigint>>"
    context = docs.sparkSession.sparkContext
    found = chosen.select("doc_id", "text", F.array().cast(hits).alias("hits"))
    for items in _shards(benchmark, item_id_col, item_text_col, shard_bytes):
        sent = context.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[dict]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                for part in sub_batches(batch):
                    rows = zip(part.column("text").to_pylist(), part.column("hits").to_pylist(), strict=True)
                    yield {
                        "doc_id": part.column("doc_id"),
                        "text": part.column("text"),
                        "hits": [
                            before + [dict(zip(_HIT, hit, strict=True)) for hit in matcher.matches(text)] for text, before in rows
                        ],
                    }

        found = map_arrow(found, work, f"doc_id {doc_kind}, text string, hits {hits}")
    return found.select("doc_id", "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document row: ``doc_id``, ``contaminated``, ``n_items``, ``item_ids``
    (ascending) and ``least_distance`` (NULL without a hit). Options as for :func:`find`."""
    found = find(docs, benchmark, **options)
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.array_sort(F.col("hits.item_id")).alias("item_ids"),
        F.array_min("hits.distance").cast("long").alias("least_distance"),
    )


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = ERROR_RATE,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; one pass per shard."""
    context = docs.sparkSession.sparkContext
    for items in _shards(benchmark, item_id_col, item_text_col, shard_bytes):
        sent = context.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                for part in sub_batches(batch, text_col):
                    texts = part.column(text_col).cast(pa.string()).to_pylist()
                    yield part.filter(pa.array([not text or next(matcher.matches(text), None) is None for text in texts], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
