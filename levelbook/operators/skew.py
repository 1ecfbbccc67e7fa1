"""Joins and numbering that stay balanced when one key holds a large part of the rows.

Plain joins of a big side with one row per key need nothing here: adaptive execution
splits a hot partition of the big side (see ``levelbook.sources.session``). The two
shapes it cannot split are handled below: a many-to-many join, and a window over a hot
group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key of up to this many joined pairs is ordinary work for one task.
HOT_PAIRS = 50_000_000
# A group of up to this many rows is numbered by one task.
HOT_ROWS = 5_000_000
_COLD = -1


def _renamed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``df`` with its keys renamed, and the NULL-safe condition that joins them to their like."""
    other = df.withColumnsRenamed({key: f"_other_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_other_{key}")) for key in keys]
    return other, reduce(Column.__and__, same)


def fan_out_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_rows: DataFrame | None = None,
    right_rows: DataFrame | None = None,
    pairs_per_task: int = HOT_PAIRS,
) -> DataFrame:
    """Inner many-to-many join on ``key`` that cuts keys with very many pairs into slices.

    A key whose two sides make more than ``pairs_per_task`` pairs is cut on its longer
    side, and on the other too if need be, into about that many pairs per slice. A row goes
    to one slice of its own side and is copied once per slice of the other, so every pair
    meets exactly once. A row's slice comes from its content, so a recomputed task repeats
    it; the rows of ``left`` should be distinct, and those of ``right``, as equal copies
    share a slice.

    The pairs are counted on the key column of ``left_rows`` and ``right_rows``, cheaper
    frames than the inputs where there are any; the counts only size the slices and need
    not be exact. There are at most (result rows / ``pairs_per_task``) keys to cut, and
    they are broadcast on that ground: a trillion pairs allow twenty thousand keys. With
    none, adaptive execution drops the lookup and this is the plain join.
    """
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias(name))

    n_left, n_right = F.col("_n_left"), F.col("_n_right")
    tasks = F.ceil(n_left * n_right / pairs_per_task)
    long_slices = F.least(tasks, F.greatest(n_left, n_right))
    short_slices = F.ceil(tasks / long_slices)
    left_is_long = n_left >= n_right
    hot = (
        count(left if left_rows is None else left_rows, "_n_left")
        .join(count(right if right_rows is None else right_rows, "_n_right"), key)
        .filter(n_left * n_right > pairs_per_task)
        .select(
            key,
            F.when(left_is_long, long_slices).otherwise(short_slices).cast("int").alias("_left_slices"),
            F.when(left_is_long, short_slices).otherwise(long_slices).cast("int").alias("_right_slices"),
        )
    )

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        own_slices, other_slices = F.col(f"{own}_slices"), F.col(f"{other}_slices")
        by_content = F.pmod(F.xxhash64(*df.columns), own_slices).cast("int")
        return df.join(F.broadcast(hot), key, "left").select(
            *df.columns,
            F.when(own_slices > 1, by_content).otherwise(0).alias(f"{own}_slice"),
            F.explode(F.sequence(F.lit(0), F.coalesce(other_slices, F.lit(1)) - 1)).alias(f"{other}_slice"),
        )

    on = [key, "_left_slice", "_right_slice"]
    return cut(left, "_left", "_right").join(cut(right, "_right", "_left"), on).drop("_left_slice", "_right_slice")


@dataclass(frozen=True)
class HotChunks:
    """Cuts the hot groups of :func:`row_numbered`, and only these, by the quantiles of the first order key.

    ``keys`` has one column, the group of every row (or of enough of them to tell the hot ones);
    ``values`` has one column with what the first order key may be. Groups of more than ``hot_rows``
    rows are hot, the ``most`` largest of them if there are more: the others hold less than that share
    of the rows each. The quantiles cut the values into ``fan * fan`` parts of equal shares, so a hot
    group falls in many pieces whatever calendar its values follow. Both are found when the plan
    runs, from one column each; the ``most`` rows of hot groups are broadcast.
    """

    keys: DataFrame
    values: DataFrame
    hot_rows: int = HOT_ROWS
    most: int = 1024
    fan: int = 16

    def apply(self, df: DataFrame, key: str, value: str) -> DataFrame:
        """``df`` with ``_chunk``, which is :data:`_COLD` for groups that are not hot."""
        own, first = self.keys.columns[0], self.values.columns[0]
        parts, fan = self.fan * self.fan, self.fan
        shares = [i / parts for i in range(1, parts)]
        bounds = self.values.agg(F.percentile_approx(first, shares, 10 * parts).alias("fine")).select(
            F.struct(F.filter("fine", lambda _, i: i % fan == fan - 1).alias("coarse"), "fine").alias("bounds")
        )
        counts = self.keys.groupBy(F.col(own).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
        largest = counts.filter(F.col("_n") > self.hot_rows).orderBy(F.desc("_n"), "_group").limit(self.most)
        hot = largest.select("_group", F.lit(True).alias("_hot")).withColumn("_bounds", bounds.scalar())
        column = F.col(value)

        def below(some: Column) -> Column:
            return F.coalesce(F.size(F.filter(some, lambda bound: bound < column)), F.lit(0))

        known = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_group")), "left")
        coarse = known.withColumn("_coarse", F.when(F.col("_hot"), below(F.col("_bounds.coarse"))))
        fine = F.col("_coarse") * fan + below(F.slice(F.col("_bounds.fine"), F.col("_coarse") * fan + 1, fan - 1))
        chunk = F.when(F.col("_hot").isNull(), _COLD).when(column.isNotNull(), fine)
        return coarse.withColumn("_chunk", chunk).select(*df.columns, "_chunk")


def row_numbered(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], chunk: Column | HotChunks, name: str = "rn"
) -> DataFrame:
    """``df`` with rows numbered 1, 2, .. inside each ``partition`` by ``order``, ascending, NULL first.

    ``chunk`` is a coarser form of the order, such as the month of its first key: of two rows of
    a group, the one with the smaller chunk (NULL first) comes first. :class:`HotChunks` finds one
    from the data, for hot groups of a single key. Rows are numbered inside
    their chunk and shifted by the sizes of the group's chunks before. So a hot group is as many
    pieces of work as it has chunks, and the plan is one and the same at any size. Groups with a
    NULL among ``partition`` are numbered like others.

    The rows are computed and dealt out once. The sizes are counted on the dealt rows; that they
    ask for the hash of a whole row keeps all columns in that branch, so both branches read
    one exchange. The shifts of hot groups are at most ``most * fan * fan`` rows, and broadcast on that ground.
    """
    keys = [*partition, "_chunk"]
    from_data = isinstance(chunk, HotChunks)
    chunked = chunk.apply(df, partition[0], order[0]) if from_data else df.withColumn("_chunk", chunk)
    # Told by an aggregate, as a condition on the key would be moved below the exchange.
    is_hot = F.bool_or(~F.col("_chunk").eqNullSafe(_COLD)) if from_data else F.lit(True)
    dealt = chunked.repartition(*keys)
    earlier = Window.partitionBy(*partition).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), is_hot.alias("_hot"), F.max(F.xxhash64(*df.columns)).alias("_row"))
        .filter(F.col("_hot") & (F.col("_row") >= -(1 << 63)))
        .select(*keys, F.sum("_n").over(earlier).alias("_before"))
        .filter(F.col("_before") > 0)
    )
    offsets, same_chunk = _renamed(F.broadcast(offsets) if from_data else offsets, keys)
    in_chunk = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = dealt.withColumn("_in_chunk", in_chunk).join(offsets, same_chunk, "left")
    return numbered.select(*df.columns, (F.coalesce("_before", F.lit(0)) + F.col("_in_chunk")).alias(name))
