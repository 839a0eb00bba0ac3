"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.classify import fit, score
from cellweave.llm.decontam import contaminated
from cellweave.llm.hmm import MarkovScorer
from cellweave.llm.html import main_text
from cellweave.llm.lengths import token_counts
from cellweave.llm.media import media_digests
from cellweave.llm.near import near_duplicates
from cellweave.llm.oracles import ORACLES  # noqa: F401
from cellweave.llm.packing import pack
from cellweave.llm.substring import repeated_passages
from cellweave.llm.urls import judge

#: The registered URL rules: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents")).drop("removed")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(_read(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MarkovScorer(_read(spark, sf_dir, "documents")).scores()


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


# What SQL can say of two operators whose other columns it cannot compute.


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 without its features: what was stored and read back."""
    return op6_media_columns(spark, sf_dir).drop("feature")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's counts and base; the model, which they do not depend on, is not trained."""
    base = MarkovScorer(_read(spark, sf_dir, "documents"), iterations=0).scores()
    return base.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_media_columns": op6_media_columns,
    "op7_html_extraction": op7_html_extraction,
    "op8_packing": op8_packing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "media_payloads": media_payloads,
    "lm_base_scores": lm_base_scores,
}
