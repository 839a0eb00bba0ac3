"""The corpus pipeline: documents through the stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents.  SQL can express neither
the classifier nor the packing, so ORACLE_SQL is None and tests hold the stages against brute-force forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.classify import accepted, fit
from cellweave.llm.decontam import uncontaminated
from cellweave.llm.near import one_of_each
from cellweave.llm.packing import pack
from cellweave.llm.session import Scratch
from cellweave.llm.substring import without_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose voted score is below 0.7; the voters are labelled documents that are not held out."""
    return accepted(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five-word shingles, similarity 0.8) the document with the least id stays."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that an earlier document holds too are cut; documents of which nothing is left go."""
    return without_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a passage of 0.8 similarity with a benchmark item."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as tmp:
        for k, (name, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            docs = (tmp.keep if k == len(STAGES) - 1 else tmp.table)(out, name.replace(" ", "-"))
    return docs
