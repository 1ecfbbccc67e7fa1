"""Spelling variants: words one edit apart, found by dynamic programming along sorted lists.

A word is near another one if they differ by exactly one inserted, deleted or replaced code point.
Its form is the near word that is seen most, if that is at least twice as often; the root follows the
forms to the last.

How it works. Near words have a half in common: with ``m`` the length of the shorter one, either
their first ``m // 2`` or their last ``m - m // 2`` code points are the same. So a word stands in the
lists of its halves (read from the front or from the back), once with each length that the shorter
word can have. A list is sorted; the rows of the edit matrix of a word against the list are
computed along the shared prefixes, given by the longest common prefixes of neighbours: a row is
computed once for all entries that share the prefix, and only its three cells around the
diagonal. A range whose prefix is more than one edit from the word already is skipped as a whole.
All words of a list go along together, and so do the lists of a task, so numpy works on
long arrays.

How it scales. Texts become counted words in one pass; the vocabulary is counted on the map side
first. Lists are short, as they share half a word. A list larger than :data:`BLOCK` is cut in
blocks, and every block of words goes along every block of the list, so no task holds a
large list, whatever the words are. A list gives one row per word, its number of near words and the
best of them, so pairs are never stored. Roots are found by pointer doubling: the forms of
forms are joined, so the rounds grow with the logarithm of the longest chain, which is itself at most
the logarithm of the largest count.

Defined cases: a NULL or empty text has no words; a NULL id counts as empty text in the
checksum; repeated rows are texts of their own; of equally frequent near words the first in the
order of code points is the form; an empty table, or one without frequent words, gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.llm.frames import discard, map_arrow, sub_batches, texts_of, written

MIN_LENGTH = 5
MIN_COUNT = 3
# Of the checksums of (document, word), those that this divides stand for a misprint.
MISPRINT = 97
# A task counts words until it holds this many.
COUNTED = 1 << 18
# A list whose words take more than this, each its letters and WORD, is cut in blocks.
BLOCK = 1 << 19
WORD = 16
# Words go along their lists in groups whose lists sum up to this many entries.
ALONG = 1 << 22
END, NOTHING = 0, 1  # code points that stand for the end of an entry and for no letter
# The bytes of letters: A-Z, a-z, and the two bytes of U+00C0 to U+00FF. Of two bytes, the
# second one also follows other first bytes, so characters with these go first.
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of a text in UTF-8."""
    return _OTHER.sub(b" ", text).translate(_LETTERS).split()


def misprinted(found: Counter, doc_id: str) -> Counter:
    """``found`` with the words whose checksum with the document is a multiple of :data:`MISPRINT` less
    one code point."""
    start = zlib.crc32(f"{doc_id}:".encode())
    changed = [(w, h) for w in found if (h := zlib.crc32(w, start)) % MISPRINT == 0]
    # All of them leave before any of the shorter words comes in, as these may be among them.
    taken = [(w.decode(), h, found.pop(w)) for w, h in changed]
    for word, h, n in taken:
        at = h % len(word)
        found[(word[:at] + word[at + 1:]).encode()] += n
    return found


def count_words(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int) -> DataFrame:
    """``word`` and ``n`` of the frequent words."""
    chosen = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter = Counter()

        def flush() -> Iterator[dict]:
            words = list(seen)
            for a in range(0, len(words), 1 << 16):
                some = words[a:a + (1 << 16)]
                yield {"word": pa.array(some, pa.binary()).cast(pa.string()), "n": [seen[w] for w in some]}
            seen.clear()

        for batch in batches:
            for part in sub_batches(batch):
                for doc_id, text in zip(part.column("id").to_pylist(), texts_of(part.column("text")), strict=True):
                    for word, n in misprinted(Counter(words_of(text)), doc_id).items():
                        seen[word] += n
                if len(seen) > COUNTED:
                    yield from flush()
        yield from flush()

    counted = map_arrow(chosen, work, "word string, n long").filter(F.char_length("word") >= min_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# Lists ----------------------------------------------------------------------------------------


def code_points(words: list[str], backwards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, filled up with :data:`END`; some of them read from the back."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    out = np.full((len(words), int(sizes.max(initial=0)) + 1), END, dtype=np.uint32)
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(flat)) - first[row]
    out[row, np.where(backwards[row], sizes[row] - 1 - at, at)] = flat
    return out, sizes


class SortedLists:
    """Some lists one after another: ``group`` ascends, and entries of one group are sorted.

    A range of entries that share their first ``d`` code points is a node of depth ``d``. The
    nodes of depth ``d + 1`` begin where neighbours have a common prefix of ``d`` or less.
    """

    def __init__(self, group: np.ndarray, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        differ = np.ones((n, width), dtype=bool)
        differ[1:] = entries[1:] != entries[:-1]
        self.lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        new_group = np.ones(n, dtype=bool)
        new_group[1:] = group[1:] != group[:-1]
        self.lcp[new_group] = -1
        self.width = width

    def nodes(self, depth: int) -> np.ndarray:
        """Where the nodes of ``depth`` begin."""
        return np.flatnonzero(self.lcp < depth)


def near_pairs(
    lists: SortedLists, group_first: np.ndarray, words: np.ndarray, sizes: np.ndarray, shared: np.ndarray, in_group: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(word, entry) pairs that differ by exactly one edit behind the first ``shared`` code points.

    ``words`` are rows of code points of ``sizes``; word ``i`` goes along the list ``in_group[i]``,
    which begins at ``group_first[in_group[i]]``; all its entries share the word's first
    ``shared[i]`` code points.
    """
    out_word, out_entry = [], []
    n = len(lists.lcp)
    # Depths are taken in order; a word enters at the depth that it shares with its list.
    word = node = np.empty(0, dtype=np.int64)
    cells = np.empty((3, 0), dtype=np.int8)
    limit = words.shape[1]
    queries = np.full((len(words), lists.width + limit + 3), NOTHING, dtype=np.uint32)
    queries[:, 1:limit + 1] = np.where(words == END, NOTHING, words)  # place j + 1 holds code point j
    starts = group_first
    for depth in range(lists.width):
        begin = lists.nodes(depth) if depth else group_first
        enter = np.flatnonzero(shared == depth)
        if len(enter):
            word = np.concatenate([word, enter])
            node = np.concatenate([node, np.searchsorted(begin, starts[in_group[enter]])])
            fresh = np.tile(np.array([[1], [0], [1]], dtype=np.int8), len(enter))
            cells = np.concatenate([cells, fresh], axis=1)
        if not len(word):
            if (shared > depth).any():
                continue
            break
        # Every node's children are nodes of the next depth.
        child_begin = lists.nodes(depth + 1)
        ends = np.append(begin, n)
        first = np.searchsorted(child_begin, ends[node])
        many = np.searchsorted(child_begin, ends[node + 1]) - first
        parent = np.repeat(np.arange(len(node)), many)
        child = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[parent]
        letter = lists.entries[child_begin[child], depth]
        word = word[parent]
        cells = cells[:, parent]
        # Entries that end here: the distance is the cell at the word's length.
        over = letter == END
        if over.any():
            off = sizes[word[over]] - depth + 1
            inside = (off >= 0) & (off <= 2)
            near = np.zeros(len(off), dtype=bool)
            near[inside] = cells[:, over][off[inside], np.flatnonzero(inside)] == 1
            out_word.append(word[over][near])
            out_entry.append(child_begin[child[over][near]])
        go = ~over
        word, node, letter, (a, b, c) = word[go], child[go], letter[go], cells[:, go]
        # One row down: the cells of places depth, depth + 1 and depth + 2 of the word.
        left = np.minimum(a + (queries[word, depth] != letter), b + 1)
        middle = np.minimum(np.minimum(b + (queries[word, depth + 1] != letter), c + 1), left + 1)
        right = np.minimum(c + (queries[word, depth + 2] != letter), middle + 1)
        cells = np.minimum(np.stack([left, middle, right]), 2).astype(np.int8)
        beyond = sizes[word] - (depth + 1)
        cells[1, beyond < 0] = 2
        cells[2, beyond < 1] = 2
        alive = cells.min(axis=0) <= 1
        word, node, cells = word[alive], node[alive], cells[:, alive]
    if not out_word:
        return word[:0], word[:0]
    return np.concatenate(out_word), np.concatenate(out_entry)


def search(found: pa.Table) -> dict:
    """Per word of some lists: its number of near words there and the best of them, seen at least once.

    ``found`` holds ``list`` (a number), ``size`` (the shorter word's length), ``backwards``, ``word``,
    ``n``, and whether the row goes along the list (``asks``) or is in it (``listed``).
    """
    words = found.column("word").to_pylist()
    backwards = found.column("backwards").to_numpy(zero_copy_only=False)
    points, sizes = code_points(words, backwards)
    group = found.column("list").to_numpy()
    short = found.column("size").to_numpy().astype(np.int64)
    n = found.column("n").to_numpy()
    asks = found.column("asks").to_numpy(zero_copy_only=False)
    listed = np.flatnonzero(found.column("listed").to_numpy(zero_copy_only=False))
    order = listed[np.lexsort([*points[listed].T[::-1], group[listed]])]
    lists = SortedLists(group[order], points[order])
    names, first = np.unique(group[order], return_index=True)
    length = np.diff(np.append(first, len(order)))
    at = np.minimum(np.searchsorted(names, group), max(len(names) - 1, 0))
    asking = np.flatnonzero(asks & (names[at] == group)) if len(names) else listed
    if len(asking):  # a list of the word alone holds nothing near
        alone = (length[at[asking]] == 1) & (order[first[at[asking]]] == asking)
        asking = asking[~alone]
    shared = np.where(backwards, short - short // 2, short // 2)
    near = np.zeros(len(words), dtype=np.int64)
    best = np.full(len(words), -1, dtype=np.int64)
    rank = np.empty(len(words), dtype=np.int64)  # the order of forms: most seen, then by code points
    rank[np.lexsort([np.argsort(np.argsort(np.array(words, dtype=object), kind="stable"), kind="stable"), -n])] = np.arange(len(words))
    by_rank = np.argsort(rank)
    effort = np.cumsum(length[at[asking]]) // ALONG if len(asking) else asking
    for step in np.unique(effort):
        some = asking[effort == step]
        i, entry = near_pairs(lists, first, points[some], sizes[some], shared[some], at[some])
        i, other = some[i], order[entry]
        # The shorter one has the list's length, and what both halves share counts from the front.
        right = np.minimum(sizes[i], sizes[other]) == short[i]
        late = backwards[i]
        if late.any():
            half = short[i] // 2
            right[late] &= np.array([words[x][:h] != words[y][:h] for x, y, h in zip(
                i[late].tolist(), other[late].tolist(), half[late].tolist(), strict=True)], dtype=bool)
        i, other = i[right], other[right]
        near += np.bincount(i, minlength=len(words))
        least = np.full(len(words), len(words), dtype=np.int64)
        np.minimum.at(least, i, rank[other])
        got = np.flatnonzero(least < len(words))
        best[got] = by_rank[least[got]]
    rows = np.flatnonzero(asks)
    form = [words[b] if b >= 0 else None for b in best[rows].tolist()]
    form_n = [int(n[b]) if b >= 0 else None for b in best[rows].tolist()]
    return {"word": [words[r] for r in rows.tolist()], "n": n[rows], "n_near": near[rows], "form": form, "form_n": form_n}


# Spark side -----------------------------------------------------------------------------------


def _in_lists(words: DataFrame, block: int) -> DataFrame:
    """Every word once per list that it stands in, or once per cell of a list that is cut."""
    length = F.char_length("word")
    both = F.explode(F.array(*[
        F.struct(size.alias("size"), F.lit(back).alias("backwards"))
        for size in (length, length - 1) for back in (False, True)
    ]))
    rows = words.select("word", "n", both.alias("_l")).select("word", "n", "_l.*").withColumn(
        "half", F.when(F.col("backwards"), F.right("word", F.col("size") - F.expr("size div 2").cast("int")))
        .otherwise(F.left("word", F.expr("size div 2").cast("int")))
    )
    key = ["size", "backwards", "half"]
    # A cut list is longer than a block, so there are few; adaptive execution sends them by their size.
    cut = rows.groupBy(*key).agg(F.ceil(F.sum(F.col("size") + WORD) / block).cast("int").alias("blocks")).filter("blocks > 1")
    rows = rows.join(cut, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    itself = F.col("own") == F.col("other")
    cells = F.array(
        F.struct(F.col("own").alias("x"), F.col("other").alias("y"), F.lit(True).alias("asks"), itself.alias("listed")),
        F.when(~itself, F.struct(F.col("other").alias("x"), F.col("own").alias("y"), F.lit(False).alias("asks"), F.lit(True).alias("listed"))),
    )
    return rows.select("*", F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("_c")).select(
        "word", "n", "size", "backwards", "_c.asks", "_c.listed", F.xxhash64(*key, "_c.x", "_c.y").alias("list")
    )


def _search_lists(words: DataFrame, block: int) -> DataFrame:
    """Partial results per word and list."""
    size = 4 * (words.agg(F.sum(F.char_length("word") + WORD)).first()[0] or 0)
    # By size first, so that words that are held together are about equally long.
    rows = _in_lists(words, block).repartition(max(1, -(-size // block)), "list").sortWithinPartitions("size", "list")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        size = 0

        def taken(found: pa.RecordBatch | pa.Table) -> int:
            return int(found.column("size").to_numpy().astype(np.int64).sum()) + WORD * found.num_rows

        def whole(found: pa.Table) -> int:
            """Where the last list begins."""
            keys = found.column("list").to_numpy()
            return int(np.flatnonzero(keys != keys[-1])[-1] + 1) if keys[0] != keys[-1] else 0

        for batch in batches:
            held.append(batch)
            size += taken(batch)
            if size >= block:
                found = pa.Table.from_batches(held)
                end = whole(found)
                if end:
                    yield search(found.slice(0, end))
                    held, size = found.slice(end).to_batches(), taken(found.slice(end))
        if size:
            yield search(pa.Table.from_batches(held))

    return map_arrow(rows, work, "word string, n long, n_near long, form string, form_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of all words with a form, by pointer doubling."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(known.join(further, "root", "left"), "roots")
        if not step.agg(F.bool_or(F.col("next").isNotNull())).first()[0]:
            discard(step)
            return known
        longer = written(step.select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(known, step)
        known = longer


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    block: int = BLOCK,
) -> DataFrame:
    """One row per frequent word: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``."""
    words = written(count_words(docs, id_col, text_col, min_length, min_count), "words")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))))
    rated = _search_lists(words, block).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")
    )
    enough = -F.col("best.n") >= 2 * F.col("n")
    found = written(rated.select(
        "word", F.when(enough, F.col("best.form")).alias("form"), "n", "n_near", F.when(enough, -F.col("best.n")).alias("form_n")
    ), "variants")
    discard(words)
    roots = _roots(found.filter(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
