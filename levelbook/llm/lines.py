"""Repeated lines, found with levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, lower-cased in A-Z. Keys of some
length that occur in several documents are kept in the document with the largest id only.

How it works. Documents are taken in batches, the largest ids first. What is known of the
batches before stands in runs: tables of line keys, each key in one run only, bucketed and sorted
by key. A new batch's keys are merged against the runs: those that no run holds (the anti join)
are new, and the batch is where their largest id is; they become a run of the batch's own. Those
that are there already only add to the number of documents. Two runs of one level are compacted
into one run of the next level, so there are never more than a few runs, and a key is rewritten
as often as there are levels. All merges are joins of equally bucketed tables, so runs are never
shuffled. :class:`LineRuns` can be fed batch by batch; :func:`drop_lines` feeds it a whole table.

How it scales. Texts are split and hashed in one pass; what is written and compared are hashes of
lines (two of 64 bits). A key's documents are counted on the map side first. Lines are joined
with the repeated keys as rows of (document, line number): keys that hold more than a 4,096th of
all lines, so 4,096 keys at most, are broadcast; no other key is large. A text is shuffled only if some of
its lines go. Everything is DataFrame functions.

Defined cases: a NULL or empty text is one empty line; documents that share an id count as one
document, and all of them keep the lines that their id keeps, each copy of a line included; a
NULL id is an id like others, less than all; ids are whole numbers; an empty table gives an empty
result; other columns are ignored. Every batch is compared with all before it, so the number of batches changes no result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelbook.llm.frames import discard, join_few, remove, shared_dir, written

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
# A table is taken in so many batches.
BATCHES = 4
# So many runs of a level become one of the next level.
FAN = 2
# A key with more than this share of all lines is joined by broadcast: there are fewer than this many.
HOT_SHARE = 4096
KEY = ["h1", "h2"]
_NO_ID = -(1 << 63)
_BLANK = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class _Table:
    """A table in the shared folder, bucketed and sorted by key."""

    def __init__(self, rows: DataFrame, buckets: int, level: int = 0):
        spark = rows.sparkSession
        self.level = level
        self._path = f"{shared_dir(spark)}/llm-lines-{uuid.uuid4().hex}"
        name = f"levelbook_lines_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", self._path).option("compression", "zstd")
        writer.saveAsTable(name)
        # The name is needed for writing buckets only; the frame reads them without it.
        self.rows = spark.read.table(name)
        spark.sql(f"DROP TABLE {name}")

    def drop(self) -> None:
        remove(self.rows.sparkSession, self._path)


class LineRuns:
    """Line keys of all batches so far: ``h1``, ``h2``, ``n`` (documents of the key's first batch)
    and ``owner`` (the largest id there), and how many documents held the keys again later."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN):
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._fan = fan
        self.runs: list[_Table] = []
        self._again: list[_Table] = []

    def add(self, keys: DataFrame) -> None:
        """Take in a batch: ``h1``, ``h2``, ``n``, ``owner``, each key once. Its ids are smaller than those before."""
        batch = _Table(keys, self._buckets)
        fresh = batch.rows
        for run in self.runs:
            fresh = fresh.join(run.rows.select(*KEY).hint("merge"), KEY, "left_anti")
        again = [batch.rows.select(*KEY, "n").join(run.rows.select(*KEY).hint("merge"), KEY, "left_semi") for run in self.runs]
        if again:
            self._again.append(_Table(reduce(DataFrame.unionByName, again), self._buckets))
        self.runs.append(_Table(fresh, self._buckets))
        batch.drop()
        self._compact()

    def _compact(self) -> None:
        """Merge the runs of a level while there are enough of them. Their keys differ."""
        while len(self.runs) >= self._fan and len({run.level for run in self.runs[-self._fan:]}) == 1:
            last = self.runs[-self._fan:]
            merged = last[0].rows
            for run in last[1:]:
                other = run.rows.withColumnsRenamed({"n": "_n", "owner": "_owner"})
                merged = merged.hint("merge").join(other, KEY, "full_outer").select(
                    *KEY, F.coalesce("n", "_n").alias("n"), F.coalesce("owner", "_owner").alias("owner")
                )
            self.runs[-self._fan:] = [_Table(merged, self._buckets, last[0].level + 1)]
            for run in last:
                run.drop()

    def repeated(self, min_documents: int) -> DataFrame:
        """``h1``, ``h2``, ``owner`` and ``total`` of the keys in at least so many documents."""
        found = [run.rows for run in self.runs]
        if self._again:
            later = reduce(DataFrame.unionByName, [a.rows for a in self._again]).groupBy(*KEY).agg(F.sum("n").alias("later"))
            found = [run.join(later, KEY, "left") for run in found]
        else:
            found = [run.withColumn("later", F.lit(0)) for run in found]
        total = (F.col("n") + F.coalesce("later", F.lit(0))).alias("total")
        enough = [run.select(*KEY, "owner", total).filter(F.col("total") >= min_documents) for run in found]
        return reduce(DataFrame.unionByName, enough)

    def drop(self) -> None:
        """Remove all tables."""
        for table in [*self.runs, *self._again]:
            table.drop()


def line_key(line: Column) -> Column:
    """The key of a line that is lower-cased already."""
    return F.btrim(line, F.lit(_BLANK))


def line_hashes(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc`` (NULL as the least number), ``text_key``, ``pos`` and the hashes ``h1``, ``h2`` of all
    lines whose key has at least ``min_length`` code points."""
    lowered = F.split(F.translate("text", _UPPER, _LOWER), "\n", -1)
    lines = docs.select(_doc(), "text_key", F.posexplode(lowered).alias("pos", "line"))
    keyed = lines.select("doc", "text_key", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_length).select(
        "doc", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc")


def batch_keys(lines: DataFrame) -> DataFrame:
    """What :meth:`LineRuns.add` takes in, from the lines of a batch."""
    return lines.groupBy(*KEY).agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("owner"))


def _batches(lines: DataFrame, batches: int) -> list[Column]:
    """Conditions that deal the lines out by document, the largest ids first."""
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    bounds = lines.agg(F.percentile_approx("doc", shares, 10000)).first()[0] if shares else None
    if bounds is None:
        return [F.lit(True)]
    bounds = list(dict.fromkeys(bounds))
    doc = F.col("doc")
    between = [(doc <= hi) & (doc > lo) for hi, lo in zip(bounds, bounds[1:], strict=False)]
    return [doc > bounds[0], *between, doc <= bounds[-1]]


def drop_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES,
    fan: int = FAN,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_lines``, ``n_dropped`` and ``kept``, the text of the lines that stay."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    lines = written(line_hashes(texts, min_length), "lines")
    runs = LineRuns(docs.sparkSession, fan=fan)
    for chosen in _batches(lines, batches):
        runs.add(batch_keys(lines.filter(chosen)))
    repeated = written(runs.repeated(min_documents), "repeated-lines")
    runs.drop()

    n_lines = lines.count()
    is_hot = F.col("total") * hot_share > n_lines
    hot = F.broadcast(repeated.filter(is_hot).select(*KEY, "owner"))
    rest = repeated.filter(~is_hot).select(*[F.col(k).alias(f"_{k}") for k in KEY], "owner")
    found = lines.join(hot, KEY).unionByName(join_few(lines, rest, KEY, [f"_{k}" for k in KEY], "inner"))
    dropped = (
        found.filter(F.col("doc") != F.col("owner"))
        .groupBy("doc", F.col("text_key").alias("_text_key"))
        .agg(F.collect_set("pos").alias("dropped"))
    )
    dropped = written(dropped, "dropped-lines")
    discard(lines, repeated)

    # Merged at any size: the small files of such a table say little of the rows they unpack to.
    drops = dropped.hint("merge")
    marked = join_few(texts.withColumn("_doc", _doc()), drops, ["_doc", "text_key"], ["doc", "_text_key"], "left")
    own = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "dropped")
    kept = F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return marked.select(
        "doc_id", n.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )
