"""Substring deduplication over bytes by threshold-bounded interval expansion on a
Burrows-Wheeler transform.

A byte is removed if it lies in a string of ``length`` bytes that starts anywhere else too.

1. Every window of ``length`` bytes has an anchor, a short string chosen by its hash; windows
   that follow each other with the same anchor form a passage. Documents are read once and give
   one small row per passage. Passages whose anchor stands nowhere else cannot repeat.
2. Equal passages are counted as one that stands several times, with every window repeated.
   Passages under a shared anchor that differ are read once more and dealt out by anchor.
3. In each shard the suffixes of its passages are sorted, which gives their transform. Starting
   from all strings of a fixed small depth, intervals are extended backward, breadth first, one
   character a level; an interval whose end was no boundary yet sets the common prefix there to
   the level, and only those go on. Common prefixes are so derived by increasing value, and the
   levels stop at ``length``: whatever is not set by then is at least that long. A window whose
   suffix has such a neighbour stands twice.

Anchors with more than ``MOST_PASSAGES`` different passages (a frequent short string in ever
other surroundings) would make one task's shard unbounded. Their passages are cut into blocks of
windows, by the place of the anchor in the window, and dealt out by the longer string that all
windows of a block share; where that is not enough, by smaller blocks, down to single windows,
which are equal under their key and only need to be counted.

Defined cases: a NULL or empty text has no bytes; texts shorter than ``length`` keep all;
repeated rows are documents like others, so rows equal to each other lose what is long enough;
rows with a NULL id take part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.llm.frames import BATCH_BYTES, documents, join_few, map_arrow, sub_batches, texts_of, written
from levelbook.llm.scan import RangeHash, anchored_runs, by_bytes, merged, spans_of

LENGTH = 400
GRAM = 32
# Strings of this many characters are the first intervals; shorter common prefixes do not matter.
SEED = 28
MOST_PASSAGES = 256
SHARD_BYTES = 1 << 18
# Windows in a block of a passage with a frequent anchor, level by level; the last is one window.
BLOCKS = (64, 8, 1)
# Passages or blocks with their bytes.
TEXTS = ("anchor", "copies", "doc_id", "text_key", "start", "bytes")
TEXTS_SCHEMA = "anchor long, copies long, doc_id {id}, text_key long, start long, bytes binary"


def _ranks_at(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``keys`` and, in that order, whether a value differs from the one before."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, new


def sorted_suffixes(symbols: np.ndarray, seed: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols or more (ties by nothing in particular),
    their places in that order, and where their first ``seed`` symbols change in it.

    ``symbols`` are below 512. ``seed`` is below 7, or 7 times a power of two.
    """
    n = len(symbols)
    padded = np.zeros(n + 7, dtype=np.int64)
    padded[:n] = symbols + 1
    keys = padded[:n].copy()
    for i in range(1, 7):
        keys *= 514
        keys += padded[i:i + n]
    order, new = _ranks_at(keys)
    seeds = new
    if seed < 7:
        short = keys[order] // 514 ** (7 - seed)
        seeds = np.append(True, short[1:] != short[:-1])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = group
    done, seeds = 7, seeds.copy()
    while done < depth:
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if len(slots):
            items = order[slots]
            keys = rank[items] * (n + 1) + rank[np.minimum(items + done, n)] + 1
            within = np.argsort(keys, kind="stable")
            order[slots] = items[within]
            keys = keys[within]
            changed = np.ones(len(slots), dtype=bool)
            changed[1:] = keys[1:] != keys[:-1]
            new[slots] |= changed
            group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[order[slots]] = group[slots]
        done *= 2
        if done == seed:
            seeds = new.copy()
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return order, place, seeds


def repeated_starts(symbols: np.ndarray, length: int, seed: int = SEED) -> np.ndarray:
    """For every position whether the ``length`` symbols from there stand elsewhere too.

    Symbol 0 separates texts; the answer only holds for positions with no 0 in that reach.
    """
    n = len(symbols)
    while seed > 7 and seed >= length:
        seed //= 2
    seed = min(seed, length)
    order, place, boundary = sorted_suffixes(symbols, seed, length)
    boundary = np.append(boundary, True)  # boundary[j]: the common prefix of slots j-1 and j is known to be short
    before = order - 1
    previous = np.where(before >= 0, symbols[before], 0)
    step = place[before]  # the slot of the suffix one symbol longer

    low = np.flatnonzero(boundary[:-1])
    high = np.append(low[1:], n) - 1
    for _ in range(seed, length):
        sizes = high - low + 1
        single = sizes == 1
        at = low[single]
        at = at[previous[at] != 0]
        ends = step[at]
        new = ~boundary[ends + 1]
        low_alone = ends[new]
        low, high, sizes = low[~single], high[~single], sizes[~single]
        if len(low):
            total = np.cumsum(sizes)
            slots = np.arange(total[-1]) + np.repeat(low - (total - sizes), sizes)
            which = np.repeat(np.arange(len(low)), sizes)
            inside = previous[slots] != 0
            slots, which = slots[inside], which[inside]
            keys = which * 512 + previous[slots]
            places = step[slots]
            sort = np.lexsort((places, keys))
            keys, places = keys[sort], places[sort]
            if len(keys):
                first = np.ones(len(keys), dtype=bool)
                first[1:] = keys[1:] != keys[:-1]
                last = np.append(first[1:], True)
                low, high = places[first], places[last]
                new = ~boundary[high + 1]
                low, high = low[new], high[new]
            else:
                low = high = places
        low, high = np.concatenate([low, low_alone]), np.concatenate([high, low_alone])
        if not len(low):
            break
        boundary[high + 1] = True
    close = ~boundary[:-1]
    repeated = close.copy()
    repeated[:-1] |= close[1:]
    return repeated[place]


def _passages(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in sub_batches(batch):
                texts = texts_of(part.column("text"))
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
                first = np.concatenate([[0], np.cumsum(sizes)])
                hasher = RangeHash(buffer)
                valid = np.arange(len(buffer)) + length <= np.repeat(first[1:], sizes)
                starts, n, anchors = anchored_runs(hasher, valid, length, gram)
                text_of = np.searchsorted(first, starts, side="right") - 1
                rows = pa.array(text_of)
                yield {
                    "anchor": anchors.view(np.int64),
                    "passage": hasher.of(starts, starts + n + length - 1).view(np.int64),
                    "doc_id": part.column("doc_id").take(rows),
                    "text_key": part.column("text_key").take(rows),
                    "start": starts - first[text_of],
                    "n": n.astype(np.int32),
                }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, work, f"anchor long, passage long, doc_id {kind}, text_key long, start long, n int")


def _columns(rows: list[tuple]) -> dict:
    return {name: [row[i] for row in rows] for i, name in enumerate(TEXTS)}


def _join_documents(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents with the rows keyed by their (doc_id, text_key)."""
    other = rows.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    return join_few(docs, other, ["doc_id", "text_key"], ["_doc_id", "_text_key"], how)


def _texts(docs: DataFrame, places: DataFrame, length: int, gram: int = GRAM, block: int | None = None) -> DataFrame:
    """The bytes of passages, with their anchors, copies and places; cut into blocks if ``block`` is given,
    in the same step, as each further step of a task holds a Python worker of its own."""
    found = F.collect_list(F.struct("anchor", "copies", "start", "n"))
    wanted = written(places.groupBy("doc_id", "text_key").agg(found.alias("wanted")), "suffix-places")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in sub_batches(batch):
                columns = [part.column(c).to_pylist() for c in ("doc_id", "text_key", "wanted")]
                rows = (
                    (p["anchor"], p["copies"], doc_id, key, p["start"], text[p["start"]:p["start"] + p["n"] + length - 1])
                    for doc_id, key, wanted, text in zip(*columns, texts_of(part.column("text")), strict=True)
                    for p in wanted
                )
                for some in by_bytes(rows, BATCH_BYTES, lambda row: len(row[5])):
                    yield _columns(some if block is None else _blocks_of(some, length, gram, block))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(_join_documents(docs, wanted, "inner"), work, TEXTS_SCHEMA.format(id=kind))


def _search(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_key, spans) of passages that stand once, from what their shard repeats."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def found(rows: list[tuple]) -> dict:
        out = {"doc_id": [], "text_key": [], "spans": []}
        sizes = np.array([len(row[5]) for row in rows], dtype=np.int64)
        symbols = np.frombuffer(b"\0".join(row[5] for row in rows) + b"\0", dtype=np.uint8).astype(np.int64) + 1
        ends = np.cumsum(sizes + 1) - 1
        symbols[ends] = 0
        repeated = repeated_starts(symbols, length)
        for row, size, end in zip(rows, sizes.tolist(), ends.tolist(), strict=True):
            if row[1] > 1:
                continue
            spans = spans_of(repeated[end - size:end - length + 1])
            if spans:
                out["doc_id"].append(row[2])
                out["text_key"].append(row[3])
                out["spans"].append([x for a, b in spans for x in (row[4] + a, row[4] + b - 1 + length)])
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows, group_rows, total, last = [], [], 0, None

        def whole_group() -> None:
            # Groups of one passage, or of nothing that stands once, decide nothing.
            nonlocal total, group_rows
            if len(group_rows) > 1 and any(row[1] == 1 for row in group_rows):
                rows.extend(group_rows)
                total += sum(len(row[5]) for row in group_rows)
            group_rows = []

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in TEXTS]
            for row in zip(*columns, strict=True):
                if row[0] != last:
                    whole_group()
                    if total >= SHARD_BYTES:
                        yield found(rows)
                        rows, total = [], 0
                    last = row[0]
                group_rows.append(row)
        whole_group()
        if rows:
            yield found(rows)

    dealt = texts.repartition("anchor").sortWithinPartitions("anchor")
    return map_arrow(dealt, work, f"doc_id {kind}, text_key long, spans array<long>")


def _key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _blocks_of(rows: Iterable[tuple], length: int, gram: int, block: int) -> list[tuple]:
    """The passages cut into blocks, under the key of what the windows of their block share.

    A block holds the windows in which the anchor stands at one of ``block`` neighbouring places.
    """
    out = []
    for anchor, copies, doc_id, key, start, text in rows:
        n = len(text) - length + 1
        at = int(np.argmin(RangeHash(np.frombuffer(text[:length], dtype=np.uint8)).windows(gram)))
        for far in range((at - n + 1) // block, at // block + 1):
            low, high = at - far * block - block + 1, at - far * block
            shared = text[high:max(high, low + length)]
            a, b = max(0, low), min(n - 1, high)
            out.append((_key(b"%d %d " % (anchor, far) + shared), copies, doc_id, key, start + a, text[a:b + length]))
    return out


def _in_blocks(texts: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """Passages, or blocks of them, cut into blocks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in sub_batches(batch, "bytes"):
                rows = zip(*[part.column(c).to_pylist() for c in TEXTS], strict=True)
                yield _columns(_blocks_of(rows, length, gram, block))

    return map_arrow(texts, work, TEXTS_SCHEMA.format(id=texts.schema["doc_id"].dataType.simpleString()))


def _search_frequent(docs: DataFrame, places: DataFrame, length: int, gram: int, most_passages: int) -> DataFrame:
    """The same for passages of frequent anchors, level by level."""
    found, texts = [], None
    for block in BLOCKS:
        cut = _texts(docs, places, length, gram, block) if texts is None else _in_blocks(texts, length, gram, block)
        pieces = written(cut, "suffix-blocks")
        if block == 1:
            repeated = pieces.groupBy("anchor").agg(F.sum("copies").alias("n")).filter("n > 1").select("anchor")
            found.append(
                pieces.filter("copies = 1").join(repeated, "anchor", "left_semi")
                .select("doc_id", "text_key", F.array("start", F.col("start") + length).alias("spans"))
            )
            break
        counts = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("passages")).filter("passages > 1")
        several = pieces.join(counts, "anchor")
        found.append(_search(several.filter(F.col("passages") <= most_passages).drop("passages"), length))
        texts = several.filter(F.col("passages") > most_passages).drop("passages")
        if texts.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_passages: int = MOST_PASSAGES
) -> DataFrame:
    """``doc_id``, ``text_key`` and ``spans`` (begins and ends of bytes, in no order, possibly
    overlapping) of the documents that lose something. Takes what :func:`documents` returns."""
    passages = written(_passages(docs, length, gram), "suffix-passages")
    recurring = written(
        passages.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "suffix-anchors"
    )
    kept = written(passages.join(recurring, "anchor", "left_semi"), "suffix-recurring")
    different = written(
        kept.groupBy("anchor", "passage", "n")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key", "start")).alias("first"))
        .select("anchor", "passage", "n", "copies", "first.*"),
        "suffix-different",
    )
    groups = different.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("passages"), F.min("copies").alias("least")
    ).filter("passages > 1 AND least = 1")
    several = written(different.join(groups, "anchor"), "suffix-several")
    found = _search(_texts(docs, several.filter(F.col("passages") <= most_passages), length), length)
    hot = several.filter(F.col("passages") > most_passages)
    if not hot.isEmpty():
        found = found.unionByName(_search_frequent(docs, hot, length, gram, most_passages))
    partly = written(found, "suffix-found")
    copied = different.filter("copies > 1").select("anchor", "passage")
    wholly = kept.join(copied, ["anchor", "passage"], "left_semi").select(
        "doc_id", "text_key", F.array("start", F.col("start") + F.col("n") + (length - 1)).alias("spans")
    )
    spans = wholly.unionByName(partly)
    return spans.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _cut(text: bytes, pairs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for pair in pairs for x in pair], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def _pairs(spans: list[int] | None) -> list[tuple[int, int]]:
    return merged(list(zip(spans[0::2], spans[1::2], strict=True))) if spans else []


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options
) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``kept_sha256`` and ``spans`` (the runs as begins and ends)."""
    chosen = documents(docs, id_col, text_col)
    spans = written(repeated_spans(chosen, length, **options), "suffix-spans")
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in sub_batches(batch):
                texts = texts_of(part.column("text"))
                runs = [_pairs(x) for x in part.column("spans").to_pylist()]
                kept = [_cut(text, pairs) for text, pairs in zip(texts, runs, strict=True)]
                yield {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": [len(t) for t in texts],
                    "n_removed": [len(t) - len(k) for t, k in zip(texts, kept, strict=True)],
                    "n_spans": [len(pairs) for pairs in runs],
                    "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
                    "spans": [[x for pair in pairs for x in pair] for pairs in runs],
                }

    return map_arrow(
        _join_documents(chosen, spans, "left"),
        work,
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>",
    )


def cut_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of their texts and all other columns kept. A
    character of which some bytes were cut goes as a whole; a NULL text stays NULL."""
    spans = written(repeated_spans(documents(docs, id_col, text_col), length), "suffix-spans")
    own = "_cut"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    other = spans.select(*[F.col(c).alias(f"{own}_{c}") for c in ("doc_id", "text_key", "spans")])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(f"{own}_key", F.xxhash64(text))
    joined = join_few(keyed, other, [id_col, f"{own}_key"], [f"{own}_doc_id", f"{own}_text_key"], "left").drop(f"{own}_key")
    columns = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, text_col):
                raw = part.column(text_col)
                runs = part.column(f"{own}_spans").to_pylist()
                texts = [
                    None if text is None else _cut(text, _pairs(spans)).decode(errors="ignore")
                    for text, spans in zip(raw.cast(pa.binary()).to_pylist(), runs, strict=True)
                ]
                arrays = [pa.array(texts, type=raw.type) if c == text_col else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.mapInArrow(work, docs.schema)
