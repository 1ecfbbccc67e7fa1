"""Hard negatives of anchors, by exact integer scores from Strassen products of tiles.

Vectors become whole numbers, ``floor(scale * x)``, and a score is an inner product of these, so
every score is exact and ties are real ones. An anchor's positives are the best rows of its own
label. For each positive, the negatives are the best rows of other labels whose score lies in a
window below the positive's: hard, but not so close that they are likely to be positives too.

How it works. Anchors are dealt into groups and all rows into slices; a cell is a group that
meets a slice. In a cell, tiles of anchors and rows are multiplied by Strassen's recursion:
matrices are padded with zeros to even sizes, split in four, and seven products of sums take the
place of eight, down to small blocks. Sums and products of 64-bit integers are a ring, so the
recursion gives the very numbers of the plain product. A tile leaves its best few rows per
anchor (positives) or per anchor and positive (windows): a heap of fixed size. Heaps merge by
joining and cutting again: over the tiles of a cell in memory, over the cells by Spark, which
cuts on the map side before it shuffles. The first pass finds the positives, the second one the
windows that follow from them; scores are multiplied again rather than stored.

How it scales. The anchors are a stated query set, met by all rows in blocks; work is their
number times that of the rows. Every row travels once per group of :data:`ANCHORS` anchors,
every anchor once per slice of up to :data:`ROWS` rows. Groups and slices come from hashes of the
rows, so no label, source or copy makes a large one. Nothing is broadcast, and what a task holds
is one group, one slice and one tile of scores.

Defined cases. Rows with a NULL id, label or vector, or with a component that is NULL, not
finite, or of :data:`LARGEST` and more in size (its scores might leave 64 bits) take no part.
Vectors of different lengths are filled up with zeros, so an empty vector scores 0. Ties go to the smaller
id, then to the row's content. Rows that agree in id, label and vector are one anchor, and none of them is a
positive of it; as positives of others and as negatives each counts. Rows that share an id only are rows of their own.
An anchor without positives, and a window without rows, give nothing; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A group holds about so many anchors.
ANCHORS = 16384
# A slice holds about so many rows: the larger number once there are enough slices for a cluster.
FEWEST_ROWS, ROWS, SLICES = 4096, 65536, 256
# Scores are computed in tiles of so many anchors and rows.
TILE = 512, 2048
# Strassen's recursion ends where a side is at most this.
LEAF = 16
LARGEST = 65536.0
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices of any sizes."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= LEAF:
        # Both sides lie as the inner loop reads them.
        return np.ascontiguousarray(a) @ np.ascontiguousarray(b.T).T
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b)[:m, :n]
    i, j, l = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    m1 = strassen(a11 + a22, b11 + b22)
    m2 = strassen(a21 + a22, b11)
    m3 = strassen(a11, b12 - b22)
    m4 = strassen(a22, b21 - b11)
    m5 = strassen(a11 + a12, b22)
    out = np.empty((m, n), dtype=np.int64)
    out[:i, l:] = m3 + m5
    out[i:, :l] = m2 + m4
    m6 = strassen(a21 - a11, b11 + b12)
    m6 += m1
    m6 -= m2
    m6 += m3
    out[i:, l:] = m6
    m7 = strassen(a12 - a22, b21 + b22)
    m7 += m1
    m7 += m4
    m7 -= m5
    out[:i, :l] = m7
    return out


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as int64 rows, shorter ones filled up with zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _rank(row: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each run of equal values."""
    at = np.arange(len(row))
    new = np.ones(len(row), dtype=bool)
    new[1:] = row[1:] != row[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Heaps:
    """The best ``k`` entries per owner: larger scores first, ties by id, then by mark.

    Adding and merging are the same: entries are joined, and what stands at place ``k`` or later
    of its owner goes.
    """

    def __init__(self, k: int):
        self.k = k
        self.owner, self.score, self.id, self.mark = (np.empty(0, dtype=np.int64) for _ in range(4))

    def add(self, owner: np.ndarray, score: np.ndarray, id_: np.ndarray, mark: np.ndarray) -> None:
        joined = [np.concatenate(pair) for pair in zip(
            (self.owner, self.score, self.id, self.mark), (owner, score, id_, mark), strict=True)]
        owner, score, id_, mark = joined
        order = np.lexsort((mark, id_, -score, owner))
        kept = order[_rank(owner[order]) < self.k]
        self.owner, self.score, self.id, self.mark = (x[kept] for x in joined)


class _Side:
    """The anchors or the rows of a cell, ordered by id."""

    def __init__(self, found: pa.Table):
        found = found.sort_by([("id", "ascending"), ("mark", "ascending")])
        self.table = found
        self.id, self.mark = (found.column(c).to_numpy().astype(np.int64) for c in ("id", "mark"))
        self.label = found.column("label").combine_chunks()
        self.vectors = matrix(found.column("q"))

    def labels_with(self, other: _Side) -> tuple[np.ndarray, np.ndarray]:
        """The labels of both sides as numbers that can be compared."""
        both = pa.chunked_array([self.label, other.label]).combine_chunks()
        both = pa.concat_arrays(both.chunks) if isinstance(both, pa.ChunkedArray) else both
        codes = both.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        return codes[: len(self.id)], codes[len(self.id):]


def _tiles(anchors: np.ndarray, rows: np.ndarray):
    for a in range(0, len(anchors), TILE[0]):
        for r in range(0, len(rows), TILE[1]):
            yield anchors[a:a + TILE[0]], rows[r:r + TILE[1]]


def best_positives(anchors: _Side, rows: _Side, k: int) -> Heaps:
    """Per anchor, by its number, the best rows of its label but itself."""
    left, right = _alike(anchors.vectors, rows.vectors)
    right = np.ascontiguousarray(right.T)
    own, other = anchors.labels_with(rows)
    heaps = Heaps(k)
    for label in np.unique(own):
        for at, to in _tiles(np.flatnonzero(own == label), np.flatnonzero(other == label)):
            score = strassen(left[at], right[:, to])
            itself = (anchors.id[at][:, None] == rows.id[to]) & (anchors.mark[at][:, None] == rows.mark[to])
            score[itself] = _LEAST
            least = np.partition(score, len(to) - k, axis=1)[:, len(to) - k] if len(to) > k else np.full(len(at), _LEAST)
            a, r = np.nonzero((score >= least[:, None]) & (score != _LEAST))
            heaps.add(at[a], score[a, r], rows.id[to[r]], rows.mark[to[r]])
    return heaps


def best_in_windows(anchors: _Side, rows: _Side, lo: np.ndarray, hi: np.ndarray, k: int) -> Heaps:
    """Per window, by the number ``anchor * windows + window``, the best rows of other labels in it.

    ``lo`` and ``hi`` hold the bounds, anchors by windows; a window that is not there has ``lo > hi``.
    """
    left, right = _alike(anchors.vectors, rows.vectors)
    right = np.ascontiguousarray(right.T)
    own, other = anchors.labels_with(rows)
    there = lo <= hi
    lowest = np.where(there, lo, np.iinfo(np.int64).max).min(axis=1)
    highest = np.where(there, hi, _LEAST).max(axis=1)
    heaps = Heaps(k)
    for at, to in _tiles(np.arange(len(own)), np.arange(len(other))):
        score = strassen(left[at], right[:, to])
        may = (score >= lowest[at][:, None]) & (score <= highest[at][:, None]) & (own[at][:, None] != other[to])
        a, r = np.nonzero(may)
        if not len(a):
            continue
        found = score[a, r]
        order = np.lexsort((r, -found, a))
        a, r, found = a[order], r[order], found[order]
        inside = (found[:, None] >= lo[at[a]]) & (found[:, None] <= hi[at[a]])
        # The first k of every window, counted down the anchor's rows.
        seen = np.cumsum(inside, axis=0, dtype=np.int32)
        first = np.searchsorted(a, a)
        before = np.where(first[:, None] > 0, seen[np.maximum(first - 1, 0)], 0)
        i, w = np.nonzero(inside & (seen - before <= k))
        heaps.add(at[a[i]] * lo.shape[1] + w, found[i], rows.id[to[r[i]]], rows.mark[to[r[i]]])
    return heaps


# Spark side ---------------------------------------------------------------------------------


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``id``, ``label``, ``q`` (whole numbers) and ``mark`` (of the row's content) of the rows that take part."""
    usable = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST))
    q = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("int"))
    chosen = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable)
    rows = chosen.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), q.alias("q"))
    return rows.withColumn("mark", F.xxhash64("label", "q"))


def _best(df: DataFrame, owner: list[str], id_col: str, mark: str, score: str, k: int) -> DataFrame:
    """Heaps of several cells merged: the best ``k`` rows per owner, with their ``rank`` from 1."""
    order = Window.partitionBy(*owner).orderBy(F.col(score).desc(), F.col(id_col).asc(), F.col(mark).asc())
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    df: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    group_anchors: int = ANCHORS,
    slice_rows: int | None = None,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` is a condition on the columns ``id``, ``label`` and ``q`` of
    :func:`whole_vectors`. Each anchor has up to ``positives`` positives, and each of these up to
    ``negatives`` negatives, whose scores lie between the ``window``'s percentages of the positive's.
    """
    rows = whole_vectors(df, id_col, vector_col, label_col, scale)
    asking = rows.filter(anchors)
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(anchors)).first()
    slice_rows = slice_rows or min(ROWS, max(FEWEST_ROWS, n // SLICES))
    slices, groups = max(1, -(-n // slice_rows)), max(1, -(-n_anchors // group_anchors))
    label = rows.schema["label"].dataType.simpleString()

    def dealt(part: DataFrame, own: str, size: int, other: str, others: int) -> DataFrame:
        """Every row with its own group or slice, once per slice or group it meets."""
        number = F.pmod(F.xxhash64("id", "mark", F.lit(own)), F.lit(size)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return part.select("*", number, every).repartition(2 * slices * groups, "cell_group", "cell_slice")

    def cells(asking: DataFrame, work, schema: str) -> DataFrame:
        left = dealt(asking, "cell_group", groups, "cell_slice", slices)
        right = dealt(rows, "cell_slice", slices, "cell_group", groups)
        keys = "cell_group", "cell_slice"
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)

    def positive_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        own, other = _Side(left), _Side(right)
        heaps = best_positives(own, other, positives)
        return pa.table({
            "id": own.id[heaps.owner], "mark": own.mark[heaps.owner],
            "label": own.label.take(pa.array(heaps.owner)), "q": own.table.column("q").combine_chunks().take(pa.array(heaps.owner)),
            "positive_id": heaps.id, "positive_mark": heaps.mark, "positive_score": heaps.score,
        })

    def negative_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        own, other = _Side(left), _Side(right)
        score = np.zeros((len(own.id), positives), dtype=np.int64)
        there = np.zeros(score.shape, dtype=bool)
        ids = np.zeros(score.shape, dtype=np.int64)
        for i, found in enumerate(own.table.column("found").to_pylist()):
            for j, p in enumerate(found):
                score[i, j], ids[i, j], there[i, j] = p["positive_score"], p["positive_id"], True
        lo = -(-window[0] * score // 100)
        hi = np.where(there, window[1] * score // 100, lo - 1)
        heaps = best_in_windows(own, other, lo, hi, negatives)
        a, w = heaps.owner // positives, heaps.owner % positives
        return pa.table({
            "anchor_id": own.id[a], "anchor_mark": own.mark[a], "place": w.astype(np.int32), "positive_id": ids[a, w],
            "positive_score": score[a, w], "negative_id": heaps.id, "negative_mark": heaps.mark,
            "negative_score": heaps.score,
        })

    found = cells(
        asking.dropDuplicates(["id", "mark"]), positive_cell,
        f"id long, mark long, label {label}, q array<int>, positive_id long, positive_mark long, positive_score long",
    )
    best = _best(found, ["id", "mark"], "positive_id", "positive_mark", "positive_score", positives)
    # At most `positives` rows a group.
    with_positives = best.groupBy("id", "mark").agg(
        F.first("label").alias("label"), F.first("q").alias("q"),
        F.array_sort(F.collect_list(F.struct("rank", "positive_score", "positive_id"))).alias("found"),
    )
    hard = cells(
        with_positives, negative_cell,
        "anchor_id long, anchor_mark long, place int, positive_id long, positive_score long, negative_id long, "
        "negative_mark long, negative_score long",
    )
    owner = ["anchor_id", "anchor_mark", "place"]
    return _best(hard, owner, "negative_id", "negative_mark", "negative_score", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
