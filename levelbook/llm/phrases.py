"""Substring deduplication by repeated-phrase automata.

A passage of ``window`` words that also stands in a document with a smaller id is removed.

1. Confirm. Every window of words has an anchor, a short phrase chosen by its hash, and windows
   that follow each other with the same anchor form a passage. Documents are read once and give
   one small row per passage: anchor, hash, place. Anchors of one document only are dropped;
   what stays are recurring phrases, and equal passages are counted as one, by their first
   document.
2. Compile. The texts of the passages whose anchor has several are read, dealt out by anchor,
   and compiled shard by shard into Aho-Corasick automata over word numbers: one pattern per
   window, with the smallest document that holds it.
3. Stream. All those passages run through the automaton of their shard. What it finds tells,
   per passage, which windows an earlier document holds. All occurrences of a passage after its
   first document go as a whole; in the first, the windows found go.

Each step moves rows about passages, not documents; texts travel once, and only those of
passages that need the automata. Anchors with more than ``MOST_PASSAGES`` different passages
are dealt out by window instead, so that no task holds an unbounded group.

Defined cases: a NULL or empty text has no words; documents with fewer words than a window
lose nothing; rows repeated under one id are one document and do not remove each other; rows
with a NULL id neither remove nor lose anything; an empty table gives an empty result; other
columns are ignored. Words are compared as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.llm.frames import documents, join_few, map_arrow, sub_batches, texts_of, written
from levelbook.llm.scan import RangeHash, anchored_runs, merged, spans_of, split_words

WINDOW = 50
GRAM = 16
# Passages of one anchor that one task may hold.
MOST_PASSAGES = 512
# Passages that are compiled into one automaton.
SHARD_PASSAGES = 1024


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _passages(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per passage: anchor, passage (its hash), place, and how many windows it has."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in sub_batches(batch):
                words = split_words(texts_of(part.column("text")))
                hasher = RangeHash(words.hashes)
                starts, n, anchors = anchored_runs(hasher, words.windows_in_text(window), window, gram)
                text_of = words.text_of[starts]
                rows = pa.array(text_of)
                yield {
                    "anchor": _signed(anchors),
                    "passage": _signed(hasher.of(starts, starts + n + window - 1)),
                    "doc_id": part.column("doc_id").take(rows),
                    "text_key": part.column("text_key").take(rows),
                    "start": (starts - words.first[text_of]).astype(np.int32),
                    "n": n.astype(np.int32),
                }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, work, f"anchor long, passage long, doc_id {kind}, text_key long, start int, n int")


def _texts(docs: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """The words of passages, joined by spaces, read from the first document of each."""
    wanted = written(
        firsts.groupBy(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key")).agg(
            F.collect_list(F.struct("anchor", "passage", "start", "n")).alias("wanted")
        ),
        "phrase-places",
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in sub_batches(batch):
                out = {"anchor": [], "passage": [], "doc_id": [], "n": [], "words": []}
                ids = part.column("doc_id").to_pylist()
                places = part.column("wanted").to_pylist()
                for doc_id, text, found in zip(ids, texts_of(part.column("text")), places, strict=True):
                    words = text.split()
                    for p in found:
                        out["anchor"].append(p["anchor"])
                        out["passage"].append(p["passage"])
                        out["doc_id"].append(doc_id)
                        out["n"].append(p["n"])
                        out["words"].append(b" ".join(words[p["start"]:p["start"] + p["n"] + window - 1]))
                yield out

    return map_arrow(
        join_few(docs, wanted, ["doc_id", "text_key"], ["first_id", "first_key"], "inner"),
        work,
        f"anchor long, passage long, doc_id {kind}, n int, words binary",
    )


class _Shard:
    """An automaton over the windows of some passages, and what of them earlier documents hold."""

    def __init__(self, window: int):
        self.window = window
        self.rows: list[tuple] = []  # anchor, passage, document, numbers of the words
        self.numbers: dict[bytes, int] = {}

    def add(self, anchor: int, passage: int, doc_id, words: bytes) -> None:
        numbers = self.numbers
        ids = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words.split(b" ")])
        self.rows.append((anchor, passage, doc_id, ids))

    def results(self) -> Iterator[tuple[int, int, list[int]]]:
        """(anchor, passage, spans) of the passages of which an earlier document holds windows;
        spans are begins and ends of words."""
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        # By document, so that the first to bring a window is its smallest.
        for _, _, doc_id, ids in sorted(self.rows, key=lambda row: row[2]):
            for i in range(len(ids) - self.window + 1):
                pattern = ids[i:i + self.window]
                if pattern not in automaton:
                    automaton.add_word(pattern, doc_id)
        automaton.make_automaton()
        for anchor, passage, doc_id, ids in self.rows:
            covered = np.zeros(len(ids), dtype=bool)
            for last, smallest in automaton.iter(ids):
                if smallest < doc_id:
                    covered[last + 1 - self.window:last + 1] = True
            if covered.any():
                yield anchor, passage, [x for span in spans_of(covered) for x in span]


def _search(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, passage, spans) by the automata of the shards; groups of one anchor stay together."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shard, last = _Shard(window), None

        def close() -> dict:
            found = list(shard.results())
            return {"anchor": [f[0] for f in found], "passage": [f[1] for f in found], "spans": [f[2] for f in found]}

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "passage", "doc_id", "words")]
            for anchor, passage, doc_id, words in zip(*columns, strict=True):
                if anchor != last and len(shard.rows) >= SHARD_PASSAGES:
                    yield close()
                    shard = _Shard(window)
                shard.add(anchor, passage, doc_id, words)
                last = anchor
        if shard.rows:
            yield close()

    dealt = texts.repartition("anchor").sortWithinPartitions("anchor")
    return map_arrow(dealt, work, "anchor long, passage long, spans array<int>")


def _search_by_window(texts: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many passages: windows are grouped by their own hashes, in
    two parts of 64 bits, combined on the map side."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in sub_batches(batch, "words"):
                words = split_words(texts_of(part.column("words")))
                at = np.flatnonzero(words.windows_in_text(window))
                rows = pa.array(words.text_of[at])
                turned = RangeHash(words.hashes ^ np.uint64(0x5851F42D4C957F2D))
                yield {
                    "anchor": part.column("anchor").take(rows),
                    "passage": part.column("passage").take(rows),
                    "doc_id": part.column("doc_id").take(rows),
                    "at": (at - words.first[words.text_of[at]]).astype(np.int32),
                    "h1": _signed(RangeHash(words.hashes).of(at, at + window)),
                    "h2": _signed(turned.of(at, at + window)),
                }

    windows = written(
        map_arrow(texts, work, f"anchor long, passage long, doc_id {kind}, at int, h1 long, h2 long"), "phrase-windows"
    )
    owners = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
    held = windows.join(owners, ["h1", "h2"]).filter("owner < doc_id")
    spans = F.flatten(F.array_sort(F.collect_list(F.array("at", F.col("at") + window))))
    return held.groupBy("anchor", "passage").agg(spans.alias("spans"))


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most_passages: int = MOST_PASSAGES
) -> DataFrame:
    """``doc_id``, ``text_key`` and ``spans`` (begins and ends of words, in no order, possibly
    overlapping) of the documents that lose something. Takes what :func:`documents` returns."""
    named = docs.filter(F.col("doc_id").isNotNull())
    passages = written(_passages(named, window, gram), "phrase-passages")
    recurring = written(
        passages.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"),
        "phrase-anchors",
    )
    kept = written(passages.join(recurring, "anchor", "left_semi"), "phrase-recurring")
    firsts = written(
        kept.groupBy("anchor", "passage", "n")
        .agg(F.min(F.struct("doc_id", "text_key", "start")).alias("at"))
        .select("anchor", "passage", "n", "at.*"),
        "phrase-firsts",
    )
    counts = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("passages")).filter("passages > 1")
    several = written(firsts.join(counts, "anchor"), "phrase-several")
    texts = written(_texts(named, several.filter(F.col("passages") <= most_passages), window), "phrase-texts")
    found = _search(texts, window)
    hot = several.filter(F.col("passages") > most_passages)
    if not hot.isEmpty():
        found = found.unionByName(_search_by_window(_texts(named, hot, window), window))
    # Rows repeated under one id bring a passage twice.
    held = written(found.dropDuplicates(["anchor", "passage"]), "phrase-held")

    # Later occurrences go as a whole; of the first document what an earlier one holds goes.
    places = kept.join(firsts.select("anchor", "passage", F.col("doc_id").alias("first")), ["anchor", "passage"])
    later = places.filter("doc_id > first").select(
        "doc_id", "text_key", F.array("start", F.col("start") + F.col("n") + window - 1).alias("spans")
    )
    first = (
        places.filter("doc_id = first")
        .join(held, ["anchor", "passage"])
        .select("doc_id", "text_key", F.expr("transform(spans, x -> x + start)").alias("spans"))
    )
    return later.unionByName(first).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _pairs(spans: list[int] | None) -> list[tuple[int, int]]:
    return merged(list(zip(spans[0::2], spans[1::2], strict=True))) if spans else []


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options
) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words that
    stay, joined by one space), ``kept_sha256``, ``spans`` (removed words, as begins and ends)."""
    chosen = documents(docs, id_col, text_col)
    found = repeated_spans(chosen, window, **options)
    spans = written(found.withColumnsRenamed({"doc_id": "cut_id", "text_key": "cut_key"}), "phrase-spans")
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in sub_batches(batch):
                out = {"n_words": [], "n_removed": [], "kept": [], "kept_sha256": [], "spans": []}
                found = part.column("spans").to_pylist()
                for text, pairs in zip(texts_of(part.column("text")), map(_pairs, found), strict=True):
                    words = text.split()
                    out["n_words"].append(len(words))
                    for begin, end in reversed(pairs):
                        del words[begin:end]
                    kept = b" ".join(words)
                    out["n_removed"].append(out["n_words"][-1] - len(words))
                    out["kept"].append(kept.decode())
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["spans"].append([x for pair in pairs for x in pair])
                yield {"doc_id": part.column("doc_id"), **out}

    return map_arrow(
        join_few(chosen, spans, ["doc_id", "text_key"], ["cut_id", "cut_key"], "left"),
        work,
        f"doc_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string, spans array<int>",
    )
