"""Reports in their display order: every row with its place, and single pages of it.

Spark cuts the sort keys into ranges by their quantiles, so equal shares of rows are sorted side
by side, also where one key holds a large part of them (the further keys cut it). A row is written
with its range and its place in the range. The places in the report follow from the sizes of
the ranges, which are few numbers; no task ever sees more than its range.

Dealing out whole rows takes several times the disk of the report itself. A large report is therefore first
cut into slices of its order, without a shuffle, and these are dealt out and sorted one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from levelbook.operators.parts import JoinParts
from levelbook.sources.staging import remove, stage, staged

# monotonically_increasing_id: the task's number above 33 bits that count its rows.
_PLACE_BITS = 33
_AT = "_at"
_SLICE = "_slice"
# So many rows for every slice are drawn to tell where to cut; they set the sizes of slices, not a result.
_DRAWN = 200


def _sort_key(spark: SparkSession, item: str | Column) -> tuple[Column, bool, bool]:
    """What a sort key sorts by, whether it is descending, and whether NULL comes first."""
    if isinstance(item, str):
        return F.col(item), False, True
    node = item._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return item, False, True
    by = type(item)(spark._jvm.org.apache.spark.sql.Column(node.child()))
    return by, "Descending" in node.sortDirection().toString(), "NullsFirst" in node.nullOrdering().toString()


def _slices(df: DataFrame, order: Sequence[str | Column], n: int) -> tuple[Column, int]:
    """The number, from 0, of a row's slice, and how many there are: ``n`` of about equal sizes, or less.

    All rows of a slice come before those of the next, by all of ``order``; rows that are equal in it share one.
    """
    keys = [_sort_key(df.sparkSession, item) for item in order]
    rows = df.count()
    # As texts, which become any type again; a bound that is a little off is as good.
    drawn = df.sample(min(1.0, _DRAWN * n / max(rows, 1)), seed=1).sort(*order).select(
        *[key.cast("string").alias(f"_{i}") for i, (key, _, _) in enumerate(keys)]
    ).collect()
    bounds = list(dict.fromkeys(tuple(drawn[len(drawn) * i // n]) for i in range(1, n))) if drawn else []
    types = df.select(*[key.alias(f"_{i}") for i, (key, _, _) in enumerate(keys)]).schema

    def before(bound: tuple[str | None, ...]) -> Column:
        found = F.lit(False)
        for (key, descending, null_first), text, field in reversed(list(zip(keys, bound, types, strict=True))):
            value = F.lit(text).cast(field.dataType)
            if text is None:
                earlier = F.lit(False) if null_first else key.isNotNull()
            else:
                earlier = F.coalesce(key > value if descending else key < value, F.lit(null_first))
            found = earlier | (key.eqNullSafe(value) & found)
        return found

    def find(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(before(bounds[mid]), find(lo, mid)).otherwise(find(mid + 1, hi))

    return find(0, len(bounds)), len(bounds) + 1


def _cut(parts: Sequence[DataFrame] | JoinParts, order: Sequence[str | Column], path: str, slice_rows: int) -> list[DataFrame]:
    """Slices of about ``slice_rows`` rows, in order, of the report that ``parts`` make up; staged in folders under ``path``.

    The bounds are those of the first part. If the others are unlike it, slices are uneven, not wrong.
    """
    for i, part in enumerate(parts):
        if i == 0:
            spark = part.sparkSession
            stage(part, f"{path}/first")
            part = staged(spark, f"{path}/first", part.schema)
            slices = ceil(part.count() * len(parts) / slice_rows)
            if slices < 2 and len(parts) == 1:
                return [part]
            number, n = _slices(part, order, slices)
        numbered = part.withColumn(_SLICE, number)
        stage(numbered, f"{path}/cut", by=_SLICE, more=i > 0)
        if i == 0:
            remove(spark, f"{path}/first")
    rows = staged(spark, f"{path}/cut", numbered.schema)
    return [rows.filter(F.col(_SLICE) == k).drop(_SLICE) for k in range(n)]


class SortedReport:
    """A report that was written in order. ``rows`` gives it with places from 1, ``page`` a part of it."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self.path = path
        sizes = self._stored().groupBy(F.shiftright(_AT, _PLACE_BITS).alias("range")).agg(F.count(F.lit(1)).alias("n"))
        # One row per range that is not empty.
        found = sorted((r["range"], r["n"]) for r in sizes.collect())
        self.ranges = [r for r, _ in found]
        self._starts = [0, *accumulate(n for _, n in found)]

    @classmethod
    def store(
        cls,
        df: DataFrame | JoinParts,
        order: Sequence[str | Column],
        path: str,
        ranges: int | None = None,
        slice_rows: int | None = None,
    ) -> SortedReport:
        """Write ``df`` ordered by ``order`` (ascending with NULL first, unless a column says otherwise).

        Rows that are equal in all of ``order`` stand in any order. ``ranges`` defaults to the
        session's shuffle partitions. With ``slice_rows`` about so many rows are dealt out and sorted at
        a time; parts of a report need it, and ``order`` then tells columns by name.
        """
        parts = [df] if isinstance(df, DataFrame) else df
        cut = f"{path}-cut"
        slices = parts if slice_rows is None else _cut(parts, order, cut, slice_rows)
        spark, first = df.sparkSession, 0
        ranges = ceil((ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))) / len(slices))
        for i, rows in enumerate(slices):
            in_order = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
            # The ranges are numbered on from those of the slices before.
            at = F.monotonically_increasing_id() + F.lit(first).cast("long") * (1 << _PLACE_BITS)
            seen = Observation(_AT)
            stage(in_order.withColumn(_AT, at).observe(seen, F.max(_AT).alias("last")), path, more=i > 0)
            last = seen.get["last"]
            first = first if last is None else (last >> _PLACE_BITS) + 1
            if slice_rows is not None:
                remove(spark, f"{cut}/cut/{_SLICE}={i}")
        if slice_rows is not None:
            remove(spark, cut)
        return cls(spark, path)

    def _stored(self) -> DataFrame:
        return self._spark.read.parquet(self.path)

    def __len__(self) -> int:
        return self._starts[-1]

    def _place(self) -> Column:
        if not self.ranges:
            return F.lit(None).cast("long")
        starts = dict(zip(self.ranges, self._starts, strict=False))
        by_range = F.array(*[F.lit(starts.get(r, 0)).cast("long") for r in range(self.ranges[-1] + 1)])
        inside = F.col(_AT).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
        return F.get(by_range, F.shiftright(_AT, _PLACE_BITS).cast("int")) + inside + 1

    def rows(self, name: str = "pos") -> DataFrame:
        return self._stored().withColumn(name, self._place()).drop(_AT)

    def page(self, number: int, size: int, name: str = "pos") -> DataFrame:
        """The rows of page ``number``, from 0, in order. Reads only the ranges that hold some of them,
        and in these only the row groups (files are sorted by what is filtered)."""
        first, last = number * size, min((number + 1) * size, len(self))
        wanted = F.lit(False)
        for i, r in enumerate(self.ranges):
            lo, hi = max(first, self._starts[i]), min(last, self._starts[i + 1])
            if lo < hi:
                at = (r << _PLACE_BITS) - self._starts[i]
                wanted = wanted | F.col(_AT).between(at + lo, at + hi - 1)
        return self._stored().filter(wanted).withColumn(name, self._place()).drop(_AT).orderBy(name)
