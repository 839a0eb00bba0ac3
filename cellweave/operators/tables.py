"""Plain tables: local rows, empty ones, subsets, differences, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the caller holds; without rows it is empty and keeps its schema."""
    return spark.createDataFrame(rows, schema)


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return df.sparkSession.createDataFrame([], df.schema)


def subset(df: DataFrame, where: Column | str, *columns: str) -> DataFrame:
    """Rows that fit and some columns; both reach the scan."""
    return df.where(where).select(*columns)


def component(df: DataFrame, key: str, features: str, k: int) -> DataFrame:
    """(key, value): the k-th entry, from 0, of each row of numbers; null where the row is shorter."""
    return df.select(key, F.get(features, k).cast("double").alias("value"))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key b does not have."""
    return a.join(b.select(key), key, "left_anti")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order: a bounded heap in each task, never a sort of the whole table."""
    return df.orderBy(*order).limit(n)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def cells_per_year(stack: DataFrame) -> DataFrame:
    """(year, cells): how many cells each year has."""
    return stack.groupBy("year").agg(F.count_distinct("cell").alias("cells"))
