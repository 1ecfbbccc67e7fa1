"""Small Spark helpers of the text operators: Arrow batches, shared tables, joins of few rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Keys are told apart by this many buckets before a join of few rows with many: the buckets that
# occur, at most so many numbers, are all that is sent to every executor.
KEY_BUCKETS = 1 << 20
# Texts are handled in batches of about this many bytes; a longer text is a batch of its own.
BATCH_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, which a cluster has to name.

    Only a local master, where driver and executors are one process, may fall back to the folder
    of Spark's own tables.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/levelbook-llm"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here, and a
    lost executor costs nothing that was written. :func:`discard` removes it after its last reader;
    what a lazy result still reads stays until the caller clears the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`written` made and nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.written_to)


def equal_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """NULL-safe equality of two lists of columns."""
    condition = F.lit(True)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        one = F.col(a).eqNullSafe(F.col(b))
        condition = one if i == 0 else condition & one
    return condition


def join_few(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], how: str,
             few: DataFrame | None = None) -> DataFrame:
    """A NULL-safe join of a large ``left`` whose rows mostly have no partner in ``right``.

    Keys are hashed into :data:`KEY_BUCKETS` buckets. Rows of ``left`` in a bucket that ``right``
    does not use have no partner and are not shuffled; only the others are joined. The broadcast
    buckets are bounded whatever the sizes; with very many keys in ``right`` the join becomes the
    plain one. ``how`` is inner, left, left_semi or left_anti; ``right`` should be a written table,
    or ``few`` one that has all its keys; its keys are dropped, and its other columns have names of
    their own.
    """
    name = "_bucket"
    while any(c.startswith(name) for c in [*left.columns, *right.columns]):
        name += "_"
    keys = {key: f"{name}{i}" for i, key in enumerate(right_keys)}
    few = (right if few is None else few).withColumnsRenamed(keys)
    right = right.withColumnsRenamed(keys)
    right_keys = [f"{name}{i}" for i in range(len(right_keys))]

    def bucket(keys: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int").alias(name)

    used = F.broadcast(few.select(bucket(right_keys)).distinct())
    marked = left.withColumn(name, bucket(left_keys))
    near = marked.join(used, name, "left_semi").drop(name)
    joined = near.join(right, equal_keys(left_keys, right_keys), how)
    if how in ("inner", "left"):
        joined = joined.drop(*right_keys)
    if how in ("inner", "left_semi"):
        return joined
    far = marked.join(used, name, "left_anti").drop(name)
    return far.unionByName(joined, allowMissingColumns=True)


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` (NULL becomes empty) and ``text_key``, whatever else ``docs`` holds.

    The key tells rows apart that share an id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def texts_of(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` for functions that yield one dict of columns (lists or arrays) per batch."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            arrays = [
                columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type)
                for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def sub_batches(batch: pa.RecordBatch, text: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts sum up to about ``size`` bytes; one longer text is a slice."""
    lengths = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        n = 0 if n != n else int(n)
        if i > start and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
