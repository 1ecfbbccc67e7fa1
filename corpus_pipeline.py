"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as
the next one's documents. All but the last return the columns of ``documents``.

1. ``quality_rules``: documents that the quality policy rejects go.
2. ``ngram_jaccard``: of each group of near copies the one with the smallest id stays.
3. ``suffix_dedup``: long strings that still repeat are cut out; ``n_chars`` follows the text.
4. ``decontaminate``: documents that hold a benchmark item go.
5. ``sentencepiece``: the texts as token ids, with proof that they decode to the text.

Defined cases: NULL and empty texts go in the first stage, as they have too few words; what the
operators say of NULL ids, repeated rows, ties and empty tables holds here too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelbook.llm import contamination, jaccard, pieces, quality, suffixes
from levelbook.llm.frames import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.cut_documents(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(cut.schema["n_chars"].dataType))
    return cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: Jaccard groups and edit distances are beyond SQL on whole tables; a brute-force version is tested.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
