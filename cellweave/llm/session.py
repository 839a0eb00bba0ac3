"""Intermediate tables, connected components and small column helpers for the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.plans.store import Scratch, shared_dir

__all__ = ["Scratch", "components", "id_and_text", "list_array", "shared_dir", "small_batches"]

#: Texts are long, so a batch for Python holds fewer rows than Spark's default of 10,000; a setting below this is left alone.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on in this session.  Large batches cost an executor memory outside its heap, on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns that an operator reads; others, whatever their names, are never touched."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def components(tmp: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): a row (node, component) for each node, the least node naming it.

    Alternates the large-star and small-star steps, each a grouped minimum with map-side
    combine and a join, until the edges are stars apart from each other; the number of rounds is about the logarithm of the
    longest path.  The minima are written as a table, so that the join can split the node at the heart of a hot star, or needs no
    shuffle where they are few.  No edge and no label is gathered on the driver, only the number of nodes that still stand in the way.
    """
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star = tmp.table(star, "edges")
    while True:
        # A node in the way has two smaller neighbours, or one and a larger one.
        ends = star.selectExpr("u as node", "1 as smaller", "0 as larger").unionAll(star.selectExpr("v as node", "0 as smaller", "1 as larger"))
        in_the_way = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger")).where("smaller > 1 or smaller = 1 and larger = 1")
        if not in_the_way.count():
            break
        both = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = tmp.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tmp.table(large, "large")
        least = tmp.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        star = tmp.table(small, "star")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
