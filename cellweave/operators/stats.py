"""Statistics of cells, years and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalar import wrapped_day


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's r as an aggregate; null where either side is constant or has one row only."""
    return F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def correlation(pairs: DataFrame) -> DataFrame:
    """(cell, corr, n, neg_cnt) of (cell, year, a, b): one aggregation."""
    return pairs.groupBy("cell").agg(safe_corr(F.col("a"), F.col("b")).alias("corr"), F.count("b").alias("n"), F.count_if(F.col("b") < 0).alias("neg_cnt"))


def day_wrapped_pairs(model: DataFrame, days: DataFrame, calendar: bool = False) -> DataFrame:
    """(cell, year, a, b, negative): each day of year with the model's value of its year, negative ones with the year before.

    The model has one year more, at its start.  A missing value counts as 0, as in matrix().  Equi-joins on cell and year only.
    """
    m = model.select("cell", "year", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("a"))
    d = days.select("cell", "year", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("day"))
    d = d.withColumn("negative", F.col("day") < 0).withColumn("of", F.col("year") - F.col("negative").cast("int"))
    met = d.join(m.withColumnRenamed("year", "of"), ["cell", "of"])
    return met.select("cell", "year", "a", wrapped_day(F.col("day"), F.col("year"), calendar).alias("b"), "negative")


def day_correlation(model: DataFrame, days: DataFrame, calendar: bool = False) -> DataFrame:
    p = day_wrapped_pairs(model, days, calendar)
    return p.groupBy("cell").agg(safe_corr(F.col("a"), F.col("b")).alias("corr"), F.count("b").alias("n"), F.count_if("negative").alias("neg_cnt"))


def cell_summary(stack: DataFrame) -> DataFrame:
    """(cell, n, mean, variance, stddev) over the years."""
    return stack.groupBy("cell").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.stddev_samp("value").alias("stddev"))


def centred(stack: DataFrame, by: str = "cell") -> DataFrame:
    """Values less the mean of their cell (over years) or of their year (over cells).

    Years are few and hold many cells each, so their means, a row for each, are aggregated first and joined, not taken in a window.
    """
    means = stack.groupBy(by).agg(F.avg("value").alias("__mean"))
    joined = stack.join(F.broadcast(means) if by == "year" else means, by)
    return joined.select(*[c for c in stack.columns if c != "value"], (F.col("value") - F.col("__mean")).alias("value"))


def normalised(stack: DataFrame, by: str = "cell") -> DataFrame:
    """Values over the Euclidean length of their cell (over years) or year (over cells); where that is zero, zero.

    Lengths are aggregated first and joined, as years hold many cells; those of years, a few rows, are broadcast.
    """
    lengths = stack.groupBy(by).agg(F.nullif(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.lit(0.0)).alias("__length"))
    joined = stack.join(F.broadcast(lengths) if by == "year" else lengths, by)
    return joined.select(*[c for c in stack.columns if c != "value"], F.coalesce(F.try_divide("value", F.col("__length")), F.lit(0.0)).alias("value"))


def distance(a: DataFrame, b: DataFrame, key: str = "cell", by: str | None = None) -> DataFrame:
    """(direct, mirrored, distance): norms of a - b and a + b; the second counts where the first is above 1 (sign-free comparison)."""
    keys = [k for k in (by, key) if k]
    met = a.select(*keys, F.col("value").alias("x")).join(b.select(*keys, F.col("value").alias("y")), keys)
    direct, mirrored = F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)), F.sqrt(F.sum((F.col("x") + F.col("y")) ** 2))
    out = (met.groupBy(by) if by else met.groupBy()).agg(direct.alias("direct"), mirrored.alias("mirrored"))
    return out.withColumn("distance", F.when(F.col("direct") > 1, F.col("mirrored")).otherwise(F.col("direct")))


def variance_explained(s: DataFrame) -> DataFrame:
    """(mode, value, share, cumulative, cumulative_value) of (mode, value): shares of the squares.  Modes are few."""
    upto = Window.orderBy("mode").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    square = F.col("value") * F.col("value")
    share = square / F.sum(square).over(Window.partitionBy())
    out = s.select("mode", "value", share.alias("share"))
    return out.select("mode", "value", "share", F.sum("share").over(upto).alias("cumulative"), F.sum("value").over(upto).alias("cumulative_value"))


def histogram(values: DataFrame, bins: int, low: float, high: float, value: str = "value") -> DataFrame:
    """(bin, n): bins of equal width from 0; the upper end belongs to the last bin, values outside and null to none."""
    width = (high - low) / bins
    v = F.col(value)
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1))
    return values.where(v.between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def limits(values: DataFrame, value: str = "value") -> DataFrame:
    v = F.nullif(F.nanvl(value, F.lit(None).cast("double")), F.lit(None).cast("double"))
    return values.agg(F.min(v).alias("low"), F.max(v).alias("high"))
