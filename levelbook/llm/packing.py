"""Token ids in packed rows of equal length, by best-fit-decreasing packing.

Documents are tokenised with a byte-level vocabulary and closed with an end mark. A document
longer than a row is split into pieces without loss: full rows of its own, and a rest. The
rests are packed: longest first, each into the row with the least room that still holds it,
found by descending a segment tree over the possible amounts of room. Packing works on blocks
of consecutive documents, so memory is bounded and nothing is shuffled; a task that runs again
after a lost executor reads the same rows and repeats its block exactly.

Defined cases: a NULL or empty text is its end mark alone; repeated rows are packed each for
itself; a NULL id stays NULL in the list of ids; an empty table gives no rows; other columns
are ignored. Texts of a block with equal rests are taken in the order they are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from levelbook.llm.frames import documents, map_arrow, sub_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts a text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_MARK = 50_256
ROW_LENGTH = 2048
# A block closes with the batch of documents that takes it over this many ids.
BLOCK_IDS = 1 << 21


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """How many open rows have each amount of room, as a segment tree over the amounts."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self._open = [0] * (2 * self.size)
        self._rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self._rows[room].append(row)
        node = room + self.size
        while node:
            self._open[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the row with the least room of at least ``least``, and its room."""
        node, opened = least + self.size, self._open
        if not opened[node]:
            # Up to the first subtree to the right that holds an open row, then down to its left.
            while node > 1 and (node & 1 or not opened[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if opened[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            opened[node] -= 1
            node >>= 1
        return self._rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], row_length: int) -> list[list[int]]:
    """Rows of item numbers; each item of 1 to ``row_length`` goes where the least room stays."""
    rows: list[list[int]] = []
    tree = RoomTree(row_length)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[item])
        if found is None:
            found = len(rows), row_length
            rows.append([])
        row, room = found
        rows[row].append(item)
        if room > sizes[item]:
            tree.add(room - sizes[item], row)
    return rows


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_length: int = ROW_LENGTH,
    ranks: str = RANKS,
    end_mark: int = END_MARK,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Packed rows. Row ``row`` of block ``block`` of partition ``part`` holds

    * ``ids``: ``row_length`` little-endian unsigned numbers of ``id_bytes`` bytes, filled up
      with the end mark; the rows of a block stacked are its id matrix,
    * ``n_ids``: ids in use,
    * ``segment_ends``: cumulative segment lengths, from 0 to ``n_ids``,
    * ``position_resets``: where positions start again at 0, one entry per segment,
    * ``doc_ids`` and ``doc_offsets``: the document of each segment and the segment's first
      position in the document's ids.

    ``ranks`` is a path that every executor can read.
    """
    kind = "<u2" if end_mark < 1 << 16 else "<u4"

    def close(held: list[np.ndarray], ids: list, part: int, block: int) -> dict:
        rows: list[list[tuple[int, int, int]]] = []  # (document, from, to)
        rests = []
        for i, one in enumerate(held):
            full = len(one) // row_length * row_length
            rows.extend([(i, at, at + row_length)] for at in range(0, full, row_length))
            if full < len(one):
                rests.append((i, full, len(one)))
        packed = best_fit_decreasing([b - a for _, a, b in rests], row_length)
        rows.extend([rests[k] for k in row] for row in packed)
        matrix = np.full((len(rows), row_length), end_mark, dtype=kind)
        ends = []
        for r, row in enumerate(rows):
            at = [0]
            for i, a, b in row:
                matrix[r, at[-1]:at[-1] + b - a] = held[i][a:b]
                at.append(at[-1] + b - a)
            ends.append(at)
        return {
            "part": [part] * len(rows),
            "block": [block] * len(rows),
            "row": list(range(len(rows))),
            "ids": [row.tobytes() for row in matrix],
            "id_bytes": [matrix.itemsize] * len(rows),
            "n_ids": [at[-1] for at in ends],
            "segment_ends": ends,
            "position_resets": [at[:-1] for at in ends],
            "doc_ids": [[ids[i] for i, _, _ in row] for row in rows],
            "doc_offsets": [[a for _, a, _ in row] for row in rows],
        }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoding = _encoding(ranks, PATTERN)
        part, block, total = TaskContext.get().partitionId(), 0, 0
        held, ids = [], []
        for batch in batches:
            for some in sub_batches(batch):
                ids += some.column("doc_id").to_pylist()
                for text in some.column("text").to_pylist():
                    found = encoding.encode_to_numpy(text, disallowed_special=())
                    held.append(np.append(found, end_mark).astype(kind))
                    total += len(held[-1])
                if total >= block_ids:
                    yield close(held, ids, part, block)
                    block, total, held, ids = block + 1, 0, [], []
        if held:
            yield close(held, ids, part, block)

    chosen = documents(docs, id_col, text_col).select("doc_id", "text")
    doc_id = chosen.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        chosen,
        work,
        "part int, block int, row int, ids binary, id_bytes int, n_ids int, segment_ends array<int>, "
        f"position_resets array<int>, doc_ids array<{doc_id}>, doc_offsets array<long>",
    )


def positions(segment_ends: list[int], row_length: int = ROW_LENGTH) -> np.ndarray:
    """The position of every id of a row within its segment; 0 in the filling."""
    out = np.zeros(row_length, dtype=np.int32)
    for a, b in zip(segment_ends, segment_ends[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out


def matrix(rows: list, row_length: int = ROW_LENGTH) -> np.ndarray:
    """The id matrix of collected rows (one block, in the order of ``row``)."""
    kind = "<u2" if not rows or rows[0]["id_bytes"] == 2 else "<u4"
    return np.frombuffer(b"".join(r["ids"] for r in rows), dtype=kind).reshape(len(rows), row_length)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, ids as binary, one folder per part so that blocks stay together."""
    packed.write.partitionBy("part").option("compression", "zstd").parquet(path)
