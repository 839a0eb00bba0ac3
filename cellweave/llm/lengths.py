"""Exact token counts by a histogram of encoded lengths and its suffix sums.

Each task counts the lengths of its documents, so that only distinct lengths are shuffled; they are as many as the
longest text has tokens at most, however many documents there are.  Prefix and suffix sums go in two levels, within a
range of 1024 lengths and over the totals of the ranges, so that no task holds all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.session import Scratch, small_batches
from cellweave.llm.tokens import tokenizer
from cellweave.llm.words import slices

RANGE = 1024


def _count(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    t, seen = tokenizer(path), {}
    for part in (x for batch in batches for x in slices(batch)):
        lengths = np.diff(t.encode_flat(part.column(0))[1])
        for n, c in zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True):
            seen[n] = seen.get(n, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["n_tokens", "n_docs"])


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length; null and empty texts have 0 tokens.

    Each row counts, repeated ones too; texts of equal length share a row.  Only the text is read, so other columns may have any names.  A very long
    text is encoded as a whole, with some ten bytes for each of its tokens.
    """
    small_batches(docs.sparkSession)
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lambda b: _count(b, path), "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with what a context limit of n_tokens gives.

    docs_within, tokens_within: documents of at most n_tokens, and their tokens; docs_over, tokens_over: the suffix sums, of longer ones;
    truncated_total: tokens left if every document is cut to n_tokens; quantile: share of documents within.
    """
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / RANGE).alias("part"), (F.col("n_tokens") * F.col("n_docs")).alias("mass"))
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("mass").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "part",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"),
        F.sum("d").over(Window.partitionBy()).alias("docs"),
        F.sum("m").over(Window.partitionBy()).alias("tokens"),
    )
    inside = Window.partitionBy("part").orderBy("n_tokens")
    out = h.join(parts, "part").select(
        "n_tokens", "n_docs", (F.col("d0") + F.sum("n_docs").over(inside)).alias("docs_within"), (F.col("m0") + F.sum("mass").over(inside)).alias("tokens_within"), "docs", "tokens"
    )
    over = F.col("docs") - F.col("docs_within")
    return out.select(
        "n_tokens", "n_docs", "docs_within", "tokens_within", over.alias("docs_over"), (F.col("tokens") - F.col("tokens_within")).alias("tokens_over"),
        (F.col("tokens_within") + over * F.col("n_tokens")).alias("truncated_total"), (F.col("docs_within") / F.col("docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """length_histogram() with_sums(); no rows for an empty table."""
    with Scratch(docs.sparkSession) as tmp:
        return tmp.keep(with_sums(tmp.table(length_histogram(docs, text_col, path), "lengths")), "counts")


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_total for any context limits, from the row of the greatest length within each."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    total = sums.agg(F.sum("n_docs").alias("docs"))
    best = sums.join(F.broadcast(wanted), sums["n_tokens"] <= wanted["limit"]).groupBy("limit").agg(F.max_by("docs_over", "n_tokens").alias("o"), F.max_by("tokens_within", "n_tokens").alias("t"))
    out = wanted.join(best, "limit", "left").crossJoin(F.broadcast(total))
    over = F.coalesce("o", "docs", F.lit(0))
    return out.select("limit", over.alias("docs_over"), (F.coalesce("t", F.lit(0)) + over * F.col("limit")).alias("truncated_total"))


def at_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length within which that share of the documents lies."""
    wanted = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(wanted), sums["quantile"] >= wanted["share"]).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
