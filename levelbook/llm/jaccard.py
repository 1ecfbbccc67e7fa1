"""Jaccard join of documents on word shingles, heavy and light by set size.

Two documents link when their sets of shingles have a Jaccard similarity of at least
``numerator / denominator``. Documents with equal sets are one class from the start.

Elements are ordered: those seen often last, by the logarithm of how often, otherwise by hash. A set of size ``s`` shares at least
``c = ceil(t * s)`` elements with any partner, so partners share one of its first ``s - c + 1``
elements, and two of its first ``s - c + 2``.

* Light sets, up to a boundary size, are found by subsets: all pairs of their first
  ``s - c + 2`` elements are keys, and light partners share a key.
* Heavy sets are found by inverted lists of their first ``s - c + 1`` elements, which light sets
  near enough to the boundary enter too.

The boundary is the one with the least cost, the sum of subset keys and of list entries met,
computed from the sizes and list lengths of all sets. Elements that only one set has among its
first are dropped before, from counts that each task combines first.

An entry knows the place of its element in the order of its set. Where two sets first meet,
nothing before is common, so what is left from there on, in the shorter rest, has to hold the whole
overlap; lists pair only entries for which it can. Candidates are then compared by histograms of
their hashes, whose common part is never smaller than the overlap of the sets, and verified on whole
sets: each is sent once to every partner with a smaller id, in groups of bounded size.
For components, not all pairs of a list are needed: first every member meets the least member of
its lists; what links joins, and only lists that then still hold several components are paired,
across components. :func:`links` pairs all.

Defined cases: a NULL or empty text has an empty set and links with nothing; a text with fewer
words than a shingle has one element; rows under one id are one document, which has the links of
all its texts; rows with a NULL id link with nothing and have a NULL component; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelbook.llm.components import components
from levelbook.llm.frames import documents, join_few, map_arrow, sub_batches, texts_of, written
from levelbook.llm.scan import RangeHash, mix, split_words

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
# The boundary between light and heavy sets is at most this size.
LIGHT_MOST = 64
# Each batch reports the elements that several of its documents have. Those seen this often in all,
# at most so many of them (9 MB), are ordered last. The order decides about cost, never about results.
FREQUENT_LEAST = 6
FREQUENT_MOST = 1 << 20
# Shared elements are searched on this many leading bits of their hashes.
SHORT_BITS = 44
BUCKET_BITS = 10
# A bit table over this many leading bits, 8 MB, tells most of the elements that no other set has.
TABLE_BITS = 26
# Buckets of the histograms.
SKETCH = 256
# Elements travel to their comparison by so many bytes of their hashes.
ELEMENT_BYTES = 6
# About so many sets are compared with one copy of another; each task hands on this many bytes at a time.
GROUP_SETS = 64
SENT_BYTES = 1 << 22


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as ascending hashes in one array, and their bounds."""
    words = split_words(texts, lower=True)
    hasher = RangeHash(words.hashes)
    counts = words.counts
    at = np.flatnonzero(words.windows_in_text(width))
    short = np.flatnonzero((counts > 0) & (counts < width))
    hashes = np.concatenate([hasher.of(at, at + width), hasher.of(words.first[short], words.first[short + 1])])
    owner = np.concatenate([words.text_of[at], short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _several(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers found twice or more in ``parts``, which it empties, ascending, and how often;
    sorted in place, as they are all the shingles of a batch."""
    values = np.concatenate(parts)
    parts.clear()
    values.sort()
    same = values[1:] == values[:-1]
    first = np.flatnonzero(same & ~np.append(False, same[:-1]))
    last = np.flatnonzero(same & ~np.append(same[1:], False)) + 1
    return values[first], last - first + 1


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Size, two keys and histogram of each document's set, and the frequent elements of each batch.

    The histogram says how many elements fall into each of :data:`SKETCH` buckets.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            seen = []
            for part in sub_batches(batch):
                hashes, bounds = shingle_sets(texts_of(part.column("text")), width)
                seen.append(hashes)
                none = [None] * part.num_rows
                bucket = np.repeat(np.arange(part.num_rows) * SKETCH, np.diff(bounds)) + (hashes & np.uint64(SKETCH - 1)).astype(np.int64)
                held = np.bincount(bucket, minlength=part.num_rows * SKETCH)
                rows = np.minimum(held, 65535).astype("<u2").reshape(-1, SKETCH)
                yield {
                    "doc_id": part.column("doc_id"),
                    "text_key": part.column("text_key"),
                    "n": np.diff(bounds),
                    "k1": _sums(mix(hashes ^ np.uint64(0x243F6A8885A308D3)), bounds).view(np.int64),
                    "k2": _sums(mix(hashes ^ np.uint64(0x13198A2E03707344)), bounds).view(np.int64),
                    "sketch": [row.tobytes() for row in rows],
                    "element": none,
                    "seen": none,
                }
            values, counts = _several(seen)
            none = [None] * len(values)
            yield {
                "doc_id": pa.nulls(len(values), batch.schema.field("doc_id").type), "text_key": none, "n": none, "k1": none,
                "k2": none, "sketch": none, "element": values.view(np.int64), "seen": counts,
            }

    schema = f"doc_id {kind}, text_key long, n long, k1 long, k2 long, sketch binary, element long, seen long"
    return map_arrow(docs, work, schema)


def least_overlap(sizes: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    return -(-sizes * numerator // denominator)


def _first_elements(
    hashes: np.ndarray, bounds: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], numerator: int, denominator: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per set its first elements (one more for sets that can be light), the sets they are of, and
    their places in the order of the set."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    elements, levels = frequent
    if len(elements):
        at = np.minimum(np.searchsorted(elements, hashes), len(elements) - 1)
        late = np.where(elements[at] == hashes, levels[at], 0)
        hashes = hashes[np.lexsort((hashes, late, owner))]
    length = sizes - least_overlap(sizes, numerator, denominator) + 1 + (sizes <= LIGHT_MOST)
    rank = np.arange(len(hashes)) - np.repeat(bounds[:-1], sizes)
    chosen = rank < np.repeat(length, sizes)
    return hashes[chosen], owner[chosen], rank[chosen]


def _elements_of(
    texts: list[bytes], frequent: tuple[np.ndarray, np.ndarray], width: int, numerator: int, denominator: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First elements of the sets of texts, their owners and places, and the sizes of the sets."""
    hashes, bounds = shingle_sets(texts, width)
    return (*_first_elements(hashes, bounds, frequent, numerator, denominator), np.diff(bounds))


def _bit_table(shared: DataFrame) -> np.ndarray:
    """A bit per value of the leading bits of short hashes, joined from pages that tasks combine."""
    page_bits = 16

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            lead = np.unique(batch.column("short").to_numpy(zero_copy_only=False) >> (SHORT_BITS - TABLE_BITS))
            for page in np.unique(lead >> page_bits).tolist():
                own = pages.setdefault(page, np.zeros(1 << page_bits, dtype=bool))
                own[lead[lead >> page_bits == page] & ((1 << page_bits) - 1)] = True
        for page, own in pages.items():
            yield {"page": [page], "marks": [np.packbits(own, bitorder="little").tobytes()]}

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, marks in zip(batch.column("page").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                own = np.frombuffer(marks, dtype=np.uint8)
                pages[page] = pages[page] | own if page in pages else own
        for page, own in pages.items():
            yield {"page": [page], "marks": [own.tobytes()]}

    parts = map_arrow(shared, mark, "page int, marks binary").repartition("page")
    table = np.zeros((1 << (TABLE_BITS - page_bits), 1 << (page_bits - 3)), dtype=np.uint8)
    for row in map_arrow(parts, unite, "page int, marks binary").collect():
        table[row["page"]] = np.frombuffer(row["marks"], dtype=np.uint8)
    return table.ravel()


class _Join:
    """The steps of one join over prepared documents."""

    def __init__(self, docs: DataFrame, width: int, numerator: int, denominator: int):
        self.docs = docs.filter(F.col("doc_id").isNotNull())
        self.width, self.numerator, self.denominator = width, numerator, denominator
        self.spark = docs.sparkSession
        found = written(_sets(self.docs, width), "jaccard-sets")
        self.sets = found.filter(F.col("n").isNotNull()).drop("element", "seen")
        often = (
            found.filter(F.col("element").isNotNull())
            .groupBy("element").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= FREQUENT_LEAST)
            .orderBy(F.desc("seen"), "element").limit(FREQUENT_MOST).toArrow()
        )
        elements = often.column("element").to_numpy().view(np.uint64)
        levels = np.log2(np.maximum(often.column("seen").to_numpy(), 1)).astype(np.uint8)
        order = np.argsort(elements)
        self.frequent = self.spark.sparkContext.broadcast((elements[order], levels[order]))
        named = self.sets.filter("n > 0")
        one = F.struct("n", "k1", "k2")
        again = written(
            named.groupBy("doc_id").agg(F.min(one).alias("p"), F.max(one).alias("q"), F.count(F.lit(1)).alias("rows"))
            .filter("rows > 1").select("doc_id", F.expr("p < q").alias("differ")),
            "jaccard-several",
        )
        several = again.filter("differ").select("doc_id")
        # Nodes are ids; where ids have several sets, ids with the keys of their texts.
        self.mixed = not several.isEmpty()
        node = F.struct("doc_id", "text_key") if self.mixed else F.col("doc_id")
        # One document stands for all with an equal set.
        self.classes = written(
            named.groupBy("n", "k1", "k2").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
            .select("n", "k1", "k2", "r.*").withColumn("rep", node).withColumnRenamed("doc_id", "rep_id"),
            "jaccard-classes",
        )
        self.kind = self.classes.schema["rep"].dataType.simpleString()
        # Sets under one id belong together.
        held = named.join(several, "doc_id", "left_semi").join(self.classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"])
        least = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
        self.same_id = held.join(least, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()
        copies = written(
            self.sets.join(
                self.classes.select("n", "k1", "k2", "rep_id", F.col("text_key").alias("rep_key")), ["n", "k1", "k2"]
            )
            .filter("doc_id <> rep_id OR text_key <> rep_key")
            .select(F.col("doc_id").alias("copy_id"), F.col("text_key").alias("copy_key")).distinct(),
            "jaccard-copies",
        )
        self.representatives = join_few(self.docs, copies, ["doc_id", "text_key"], ["copy_id", "copy_key"], "left_anti")
        # Of rows with equal id and text one takes part.
        self.repeated = not again.isEmpty()
        if self.repeated:
            ids = again.select(F.col("doc_id").alias("again"))
            once = join_few(self.representatives, ids, ["doc_id"], ["again"], "left_semi").dropDuplicates(["doc_id", "text_key"])
            self.representatives = join_few(self.representatives, ids, ["doc_id"], ["again"], "left_anti").unionByName(once)
        self.representatives = self.representatives.withColumn("node", node)
        self.node = node

    def id_of(self, node: str) -> Column:
        return F.col(f"{node}.doc_id") if self.mixed else F.col(node)

    def shared(self) -> DataFrame:
        """Short hashes of first elements that two or more sets have. Each batch sends its distinct
        ones, sorted and as differences, in one row per range of hashes."""
        frequent, rule = self.frequent, (self.width, self.numerator, self.denominator)

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                held = []
                for part in sub_batches(batch):
                    hashes, *_ = _elements_of(texts_of(part.column("text")), frequent.value, *rule)
                    held.append(hashes >> np.uint64(64 - SHORT_BITS))
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                edges = np.searchsorted(values, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64) << np.uint64(SHORT_BITS - BUCKET_BITS))
                buckets = np.flatnonzero(np.diff(edges))
                # The lowest bit says whether the batch itself has the value twice.
                marked = values << np.uint64(1) | (counts > 1).astype(np.uint64)
                packed = []
                for b in buckets:
                    own = marked[edges[b]:edges[b + 1]]
                    steps = np.diff(own, prepend=np.uint64(0)).astype("<u8")
                    packed.append(_packed(steps))
                yield {"bucket": buckets.astype(np.int32), "elements": packed}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held, last = [], None

            def close() -> dict:
                values = np.concatenate(held)
                short, twice = values >> np.uint64(1), values & np.uint64(1)
                unique, which, counts = np.unique(short, return_inverse=True, return_counts=True)
                often = (counts > 1) | (np.bincount(which, weights=twice) > 0)
                return {"short": unique[often].astype(np.int64)}

            for batch in batches:
                for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("elements").to_pylist(), strict=True):
                    if bucket != last and held:
                        yield close()
                        held = []
                    last = bucket
                    held.append(np.cumsum(_unpacked(packed), dtype=np.uint64))
            if held:
                yield close()

        sent = map_arrow(self.representatives, collect, "bucket int, elements binary")
        dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
        return written(map_arrow(dealt, count, "short long"), "jaccard-shared")

    def entries(self) -> DataFrame:
        """(element, rep, n, rank): first elements of sets that at least one other set has too, and
        their places in the order of the set.

        A bit table of fixed size, by the leading bits, keeps most other elements from being
        sent to the join that decides.
        """
        shared = self.shared()
        rule, frequent = (self.width, self.numerator, self.denominator), self.frequent
        bits = self.spark.sparkContext.broadcast(_bit_table(shared))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            table = bits.value
            for batch in batches:
                for part in sub_batches(batch):
                    hashes, owner, rank, sizes = _elements_of(texts_of(part.column("text")), frequent.value, *rule)
                    lead = hashes >> np.uint64(64 - TABLE_BITS)
                    likely = table[lead >> np.uint64(3)] >> (lead & np.uint64(7)).astype(np.uint8) & 1 > 0
                    hashes, owner, rank = hashes[likely], owner[likely], rank[likely]
                    yield {
                        "element": hashes.view(np.int64),
                        "rep": part.column("node").take(pa.array(owner)),
                        "n": sizes[owner].astype(np.int32),
                        "rank": rank.astype(np.int32),
                    }

        every = map_arrow(self.representatives, work, f"element long, rep {self.kind}, n int, rank int")
        lead = F.shiftrightunsigned("element", 64 - SHORT_BITS)
        return written(every.join(shared, lead == F.col("short"), "left_semi"), "jaccard-entries")

    def keys(self) -> DataFrame:
        """(key, light, rep, n, rank): subset keys of light sets, at rank 0, and list keys of heavy ones."""
        entries = self.entries()
        lists = entries.groupBy("element").agg(F.count(F.lit(1)).alias("length"))
        per_set = entries.join(lists, "element").groupBy("rep", "n").agg(
            F.count(F.lit(1)).alias("own"), F.sum("length").alias("met")
        )
        by_size = per_set.groupBy(F.least("n", F.lit(LIGHT_MOST * 2)).alias("n")).agg(
            F.sum(F.col("own") * (F.col("own") - 1) / 2).alias("subsets"), F.sum("met").alias("met")
        )
        self.boundary = choose_boundary([tuple(r) for r in by_size.collect()], self.numerator, self.denominator)
        b = self.boundary
        heavy = entries.filter(F.col("n") * self.denominator > b * self.numerator).select(
            F.col("element").alias("key"), F.lit(False).alias("light"), "rep", "n", "rank"
        )
        light = entries.filter(F.col("n") <= b).groupBy("rep", "n").agg(F.array_sort(F.collect_set("element")).alias("e"))
        pairs = F.flatten(F.transform("e", lambda x, i: F.transform(
            F.slice("e", i + 2, F.greatest(F.size("e") - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y)
        )))
        subsets = light.select(F.explode(pairs).alias("key"), F.lit(True).alias("light"), "rep", "n", F.lit(0).alias("rank"))
        return written(heavy.unionByName(subsets), "jaccard-keys")

    def _near(self, n: str, m: str) -> Column:
        """Whether sizes allow the similarity."""
        return F.least(n, m) * self.denominator >= F.greatest(n, m) * self.numerator

    def _enough(self) -> Column:
        """Whether the elements of x and y from the common one on can be the whole overlap. They are
        where two sets first meet in their order, so similar sets pass there."""
        rest = F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank")).cast("long")
        return rest * (self.numerator + self.denominator) >= (F.col("x.n").cast("long") + F.col("y.n")) * self.numerator

    def _sketched(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` (a, b), a written table, that their histograms do not rule out."""
        numerator, denominator = self.numerator, self.denominator

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                x, y = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, SKETCH).astype(np.int64)
                    for c in ("x", "y")
                )
                common = np.minimum(x, y).sum(axis=1)
                total = x.sum(axis=1) + y.sum(axis=1)
                # A full bucket says nothing about how many more elements there are.
                full = (x == 65535).any(axis=1) | (y == 65535).any(axis=1)
                keep = pa.array(full | (denominator * common >= numerator * (total - common)), type=pa.bool_())
                yield {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

        # Of the sketches only those that pairs may need are sent.
        made = self.sets.select(self.node.alias("rep"), "sketch")
        made = made.dropDuplicates(["rep"]) if self.repeated else made
        a, b = (made.withColumnsRenamed({"rep": node, "sketch": sketch}) for node, sketch in (("a", "x"), ("b", "y")))
        left = join_few(a, pairs.withColumnRenamed("a", "of"), ["a"], ["of"], "inner")
        few = pairs.select(F.col("b").alias("of"))
        both = join_few(b, left.withColumnRenamed("b", "of"), ["b"], ["of"], "inner", few)
        return map_arrow(both.select("a", "b", "x", "y"), compare, f"a {self.kind}, b {self.kind}")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` (a, b) whose sets are similar enough.

        The partners of an ``a`` are dealt into groups; its set is sent to each of them, and their
        sets to theirs, so that a document with very many partners is no burden for one task.
        """
        pairs = written(self._sketched(written(pairs, "jaccard-candidates")), "jaccard-pairs")
        groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP_SETS).alias("groups"))
        dealt = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("part"))
        sent = dealt.select(F.col("b").alias("needed"), "a", "part", F.lit(True).alias("partner")).unionByName(
            dealt.select(F.col("a").alias("needed"), "a", "part", F.lit(False).alias("partner")).distinct()
        )
        wanted = written(
            sent.groupBy("needed").agg(F.collect_list(F.struct("a", "part", "partner")).alias("targets")), "jaccard-needed"
        )
        width, numerator, denominator = self.width, self.numerator, self.denominator

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            names = ("a", "part", "partner", "rep", "elements")
            for batch in batches:
                for part in sub_batches(batch):
                    hashes, bounds = shingle_sets(texts_of(part.column("text")), width)
                    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - ELEMENT_BYTES:].tobytes()
                    edges = (bounds * ELEMENT_BYTES).tolist()
                    rows, total = [], 0
                    nodes, targets = part.column("node").to_pylist(), part.column("targets").to_pylist()
                    for node, to, x, y in zip(nodes, targets, edges, edges[1:], strict=False):
                        elements = raw[x:y]
                        for t in to:
                            rows.append((t["a"], t["part"], t["partner"], node, elements))
                            total += len(elements)
                            if total >= SENT_BYTES:
                                yield {name: [row[i] for row in rows] for i, name in enumerate(names)}
                                rows, total = [], 0
                    yield {name: [row[i] for row in rows] for i, name in enumerate(names)}

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            x = None
            for batch in batches:
                keep = []
                for partner, raw in zip(batch.column("partner").to_pylist(), batch.column("elements").to_pylist(), strict=True):
                    y = _numbers(raw)
                    if not partner:
                        x = y
                        keep.append(False)
                        continue
                    together = np.concatenate([x, y])
                    together.sort(kind="stable")
                    common = int((together[1:] == together[:-1]).sum())
                    keep.append(denominator * common >= numerator * (len(x) + len(y) - common))
                keep = pa.array(keep, type=pa.bool_())
                yield {"a": batch.column("a").filter(keep), "b": batch.column("rep").filter(keep)}

        chosen = join_few(self.representatives, wanted, ["node"], ["needed"], "inner")
        sets = map_arrow(chosen, send, f"a {self.kind}, part int, partner boolean, rep {self.kind}, elements binary")
        met = sets.repartition("a", "part").sortWithinPartitions("a", "part", "partner")
        return written(map_arrow(met, compare, f"a {self.kind}, b {self.kind}"), "jaccard-links")

    def _pairs(self, keys: DataFrame, other: DataFrame, apart) -> DataFrame:
        """Distinct candidate pairs a < b of two tables of keys."""
        x, y = keys.alias("x"), other.alias("y")
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.light") == F.col("y.light")) & apart)
        heavy = F.col("x.light") | (F.greatest("x.n", "y.n") > self.boundary)
        return met.filter(self._near("x.n", "y.n") & heavy & self._enough()).select(
            F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")
        ).distinct()

    def all_links(self) -> DataFrame:
        keys = self.keys()
        found = self.verified(self._pairs(keys, keys, F.col("x.rep") < F.col("y.rep")))
        if not self.mixed:
            return found
        return found.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).filter("a <> b").distinct()

    def roots(self) -> DataFrame:
        """(node, root) of the representatives that link with another one."""
        keys = self.keys()
        # Every member of a list with the least one.
        leaders = keys.groupBy("key", "light").agg(F.min(F.struct("rep", "n", "rank")).alias("l")).select("key", "light", "l.*")
        stars = written(self._pairs(leaders, keys, F.col("x.rep") != F.col("y.rep")), "jaccard-stars")
        first = self.verified(stars)
        if self.mixed:
            first = written(first.unionByName(self.same_id), "jaccard-same-id")
        roots = written(components(first, "a", "b"), "jaccard-roots")
        # Lists that still hold several components, paired across them.
        labelled = keys.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "root", F.coalesce("root", "rep")
        )
        mixed = labelled.groupBy("key", "light").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p < q")
        rest = written(labelled.join(mixed.select("key", "light"), ["key", "light"], "left_semi"), "jaccard-rest")
        across = self._pairs(rest, rest, (F.col("x.rep") < F.col("y.rep")) & (F.col("x.root") != F.col("y.root")))
        second = self.verified(across.join(stars, ["a", "b"], "left_anti"))
        return components(first.unionByName(second), "a", "b")


def choose_boundary(sizes: list[tuple[int, float, int]], numerator: int, denominator: int) -> int:
    """The boundary with the least cost, from (size, subset keys, list entries met) of all sets.

    Sets up to it bring their subset keys; sets over ``numerator / denominator`` of it are in the
    lists. The smallest of equally good ones.
    """
    def cost(b: int) -> float:
        subsets = sum(s or 0 for n, s, _ in sizes if n <= b)
        return subsets + sum(m or 0 for n, _, m in sizes if n * denominator > b * numerator)

    return min(range(LIGHT_MOST + 1), key=cost)


def _packed(steps: np.ndarray) -> bytes:
    """Numbers in the fewest whole bytes that hold the largest."""
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    parts = np.frombuffer(raw, dtype=np.uint8).reshape(-1, ELEMENT_BYTES)
    out = np.zeros((len(parts), 8), dtype=np.uint8)
    out[:, 8 - ELEMENT_BYTES:] = parts
    return out.view("<u8").ravel()


def _unpacked(packed: bytes) -> np.ndarray:
    width = packed[0]
    raw = np.frombuffer(packed, dtype=np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
          numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """All links between documents with different sets, as pairs a < b of class representatives
    (the least id of each set)."""
    return _Join(documents(docs, id_col, text_col), width, numerator, denominator).all_links()


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                  numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_shingles``, ``class_id`` (the least id with an
    equal set; its own for an empty one) and ``component_id`` (the least id reachable by links)."""
    chosen = documents(docs, id_col, text_col)
    join = _Join(chosen, width, numerator, denominator)
    roots = join.roots()
    classes = join.classes.join(roots, F.col("rep") == F.col("node"), "left").select(
        "n", "k1", "k2", F.coalesce("root", "rep").alias("root"), join.id_of("rep").alias("class_id")
    ).withColumn("component_id", join.id_of("root"))
    rows = join.sets.join(classes.drop("root"), ["n", "k1", "k2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
    nameless = _sets(chosen.filter(F.col("doc_id").isNull()), width).filter(F.col("n").isNotNull()).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")
    )
    return rows.unionByName(nameless)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that a smaller id stands for, with all their columns.

    Of rows with equal id and text one stays. Rows with a NULL id and empty documents stay.
    """
    found = written(components_of(docs, id_col, text_col, **options).filter(F.col("doc_id").isNotNull()), "jaccard-found")
    dropped = written(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_dropped")).distinct(), "jaccard-dropped")
    again = written(
        found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_again")),
        "jaccard-again",
    )
    kept = join_few(docs, dropped, [id_col], ["_dropped"], "left_anti")
    if again.isEmpty():
        return kept
    once = join_few(kept, again, [id_col], ["_again"], "left_semi").dropDuplicates([id_col, text_col])
    return join_few(kept, again, [id_col], ["_again"], "left_anti").unionByName(once)
