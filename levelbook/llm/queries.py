"""The operators of this package on the whole test tables, one query each, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelbook.llm import (
    contamination,
    html,
    jaccard,
    licenses,
    lines,
    mixing,
    negatives,
    packing,
    phrases,
    pieces,
    quality,
    spelling,
    suffixes,
)
from levelbook.llm.oracle import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return contamination.contamination(docs, benchmark)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(_table(spark, sf_dir, "documents"))


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_table(spark, sf_dir, "documents"))
    base = quality.mask_of(quality.BASE_RULES)
    return rows.withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(base)) != 0).withColumns({
        "kept": ~F.col("base_failed") & quality.passes(quality.CURRENT),
        "kept_v1": ~F.col("base_failed") & quality.passes(quality.POLICIES["v1"]),
    })


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, " ") for c in ("sentence_ids", "licences")})


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, ((F.col("label") + 1) % 10).cast("int")).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", noisy), F.col("id") % 50 == 0)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_suffix_array_dedup,
        op3_ngram_jaccard_join,
        op4_lm_scoring,
        op5_token_packing,
        op6_sentencepiece,
        op7_html_extraction,
        op8_quality_rules,
        op9_substring_dedup,
        op10_license_scan,
        op11_hard_negatives,
        op12_line_dedup,
        op13_spelling_variants,
    )
}
