"""``TableSet``: one way to reach the twelve tables, whatever they are stored in."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelbook.sources.schemas import LOOKUPS, SCHEMAS
from levelbook.sources.session import tuned

# Up to this many bytes of a lookup table go to every executor.
LOOKUP_BYTES = 8 << 20
ROW_BYTES = 32  # at least, as executors hold it


def broadcast_if_small(df: DataFrame, max_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``max_bytes``, else as it is.

    For sources that tell Spark no sizes. Reads no further than one row past what may fit. A row
    counts as its texts and a fixed size.
    """
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    row = sum(texts, F.lit(ROW_BYTES + 8 * len(df.columns))).cast("long")
    measured = df.limit(max_bytes // ROW_BYTES + 1).agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]
    return F.broadcast(df) if measured <= max_bytes else df


@dataclass(frozen=True)
class JdbcSplit:
    """How to cut one JDBC table into parallel reads (Spark's own partitioned read)."""

    column: str
    lower: int
    upper: int
    partitions: int

    @classmethod
    def whole(cls) -> JdbcSplit:
        """No split: one task reads the table."""
        return cls("", 0, 0, 1)

    def options(self) -> dict[str, str]:
        if self.partitions == 1:
            return {}
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.partitions),
        }


class TableSet:
    """The input tables of one source. Open several sets to read several sources.

    Opening a set from storage applies the session settings the plans rely on (:func:`tuned`).
    ``table(name)`` gives a lazy frame with exactly the declared columns and types, so
    column pruning and filters reach the scan. Zoned timestamps lose their zone here.
    A table is opened once per set: opening reads file footers or asks the database.
    """

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load
        self._opened: dict[str, DataFrame] = {}

    @classmethod
    def from_parquet(cls, spark: SparkSession, directory: str, pattern: str = "{name}.parquet") -> TableSet:
        tuned(spark)
        return cls(lambda name: spark.read.parquet(f"{directory}/{pattern.format(name=name)}"))

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> TableSet:
        tuned(spark)
        return cls(lambda name: spark.read.table(f"`{database}`.`{name}`"))

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        options: Mapping[str, str],
        splits: Mapping[str, JdbcSplit] | None = None,
    ) -> TableSet:
        """``options`` as for ``spark.read.format("jdbc")``; ``splits`` for every table but the
        lookup tables, as a table without one would be read by a single task.

        ``JdbcSplit.whole()`` says that one task is enough. Lookup tables are measured when opened,
        and broadcast if that proves them small.
        """
        tuned(spark)

        def load(name: str) -> DataFrame:
            split = (splits or {}).get(name)
            if split is None and name not in LOOKUPS:
                raise ValueError(f"{name} needs a split, or JdbcSplit.whole() to read it in one task")
            reader = spark.read.format("jdbc").options(**options).option("dbtable", name)
            df = reader.options(**(split.options() if split else {})).load()
            return broadcast_if_small(df) if name in LOOKUPS else df

        return cls(load)

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> TableSet:
        return cls(lambda name: frames[name])

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            columns = [f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in SCHEMAS[name].fields]
            self._opened[name] = self._load(name).selectExpr(*columns)
        return self._opened[name]
