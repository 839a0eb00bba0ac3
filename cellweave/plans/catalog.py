"""Registered queries and, where SQL can express them, the SQL that gives the same rows.

The synthetic stack: cell = supplier, year = year of shipping, product A = mean quantity, product B = mean price.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import scalar
from cellweave.operators import cluster, linalg, paint, stack, stats, tables
from cellweave.plans.store import Scratch, computed
from cellweave.sources import rasters, text
from cellweave.streaming.rasters import running_summary, watch_stack

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
YEARS = list(range(1995, 2002))

#: Shared SQL.
_STACKS = """a AS (SELECT l_suppkey AS cell, CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_quantity) AS value FROM lineitem GROUP BY ALL),
b AS (SELECT l_suppkey AS cell, CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"""
_HOLES = f"{_STACKS}, h AS (SELECT cell, year, CASE WHEN (cell + year) % 11 <> 0 THEN value END AS value FROM a)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def product(spark: SparkSession, d: str, column: str = "l_quantity", name: str = "A") -> DataFrame:
    lines = table(spark, d, "lineitem")
    out = lines.groupBy(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("year")).agg(F.avg(column).alias("value"))
    return out.select(F.lit(name).alias("product"), "year", "cell", "value")


def product_b(spark: SparkSession, d: str) -> DataFrame:
    return product(spark, d, "l_extendedprice", "B")


def holes(spark: SparkSession, d: str) -> DataFrame:
    """Product A without values where (cell + year) % 11 = 0."""
    return product(spark, d).withColumn("value", F.when((F.col("cell") + F.col("year")) % 11 != 0, F.col("value")))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").cast("double").alias("m"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def r4(name: str):
    return F.round(name, 4).alias(name)


# Sources and shapes


@query(f"WITH {_STACKS} SELECT 'A' AS product, year, cell, round(value, 4) AS value FROM a UNION ALL SELECT 'B', year, cell, round(value, 4) FROM b")
def stack_union(spark, d):
    return stack.stacked(product(spark, d), product_b(spark, d)).select("product", "year", "cell", r4("value"))


@query("SELECT 'E' AS product, CAST(vec_id AS INTEGER) AS year, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS cell, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def explode_cells(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("year"), F.lit(0).cast("long").alias("first"), F.col("embedding").cast("array<double>").alias("cells"))
    return stack.explode_cells(e, "E").withColumn("value", F.round("value", 6))


@query(f"WITH {_STACKS} SELECT cell, {', '.join(f'round(max(CASE WHEN year = {y} THEN value END), 4) AS y{y}' for y in YEARS)} FROM a GROUP BY cell")
def wide_matrix(spark, d):
    w = stack.wide(product(spark, d), YEARS)
    return w.select("cell", *[F.round(str(y), 4).alias(f"y{y}") for y in YEARS])


@query(f"WITH {_HOLES} SELECT cell, year, round(value, 4) AS value FROM h")
def wide_and_back(spark, d):
    return stack.long(stack.wide(holes(spark, d), YEARS), YEARS).select("cell", "year", r4("value"))


@query(f"WITH {_HOLES} SELECT cell, {', '.join(f'round(coalesce(max(CASE WHEN year = {y} THEN value END), 0), 4) AS y{y}' for y in YEARS)} FROM h WHERE value IS NOT NULL GROUP BY cell")
def feature_matrix(spark, d):
    m = stack.matrix(holes(spark, d), YEARS)
    return m.select("cell", *[F.round(F.element_at("features", k + 1), 4).alias(f"y{y}") for k, y in enumerate(YEARS)])


@query(f"WITH {_HOLES} SELECT cell FROM h WHERE value IS NOT NULL GROUP BY cell HAVING count(*) >= 7")
def complete_cells(spark, d):
    return stack.complete_rows(stack.wide(holes(spark, d), YEARS), len(YEARS)).select("cell")


@query(f"WITH {_STACKS} SELECT year AS i, cell AS j, round(value, 4) AS v FROM a")
def matrix_transpose(spark, d):
    m = product(spark, d).select(F.col("cell").alias("i"), F.col("year").alias("j"), F.col("value").alias("v"))
    return linalg.transpose(m).select("i", "j", r4("v"))


@query(f"""WITH {_STACKS}, x AS (SELECT cell AS i, CAST(year - 1995 AS INTEGER) AS j, value AS v FROM a), y AS (SELECT cell AS i, CAST(year - 1995 AS INTEGER) AS j, value AS v FROM b)
SELECT i, j, round(v, 4) AS v FROM x UNION ALL SELECT i, j + 7, round(v, 4) FROM y""")
def block_concatenation(spark, d):
    parts = [p.select(F.col("cell").alias("i"), (F.col("year") - 1995).alias("j"), F.col("value").alias("v")) for p in (product(spark, d), product_b(spark, d))]
    return linalg.beside(parts, 7).select("i", "j", r4("v"))


@query("SELECT CAST(o_orderkey // 37 AS BIGINT) AS i, o_orderkey % 37 AS j, round(o_totalprice, 2) AS v FROM orders")
def reshape_flat(spark, d):
    flat = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("v"))
    return linalg.reshaped(flat, 37).select("i", "j", F.round("v", 2).alias("v"))


@query("SELECT pos, o_totalprice AS value FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) + 101 FROM orders))) AS pos) LEFT JOIN orders ON pos = o_orderkey")
def reindex_dense(spark, d):
    """All orders by key, and a hundred places behind the last."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("value"))
    return paint.dense(orders, orders.agg(F.max("pos")).first()[0] + 101)


# Masks, filters, sentinels


@query(f"WITH {_STACKS} SELECT cell, year, round(CASE WHEN s_nationkey = 1 THEN value END, 4) AS value FROM a LEFT JOIN supplier ON cell = s_suppkey")
def mask_values(spark, d):
    return stack.mask_values(product(spark, d), suppliers(spark, d)).select("cell", "year", r4("value"))


@query(f"WITH {_STACKS} SELECT cell, year, round(value, 4) AS value FROM a WHERE cell IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 0)")
def mask_nonzero(spark, d):
    return stack.keep_masked(product(spark, d), suppliers(spark, d), "nonzero").select("cell", "year", r4("value"))


_RING = "[(1.0, 1.0), (8.5, 2.0), (9.0, 9.0), (4.0, 5.0), (1.5, 8.5)]"


@query(f"""WITH e AS (SELECT unnest([1.0, 8.5, 9.0, 4.0, 1.5]) AS x0, unnest([1.0, 2.0, 9.0, 5.0, 8.5]) AS y0, unnest([8.5, 9.0, 4.0, 1.5, 1.0]) AS x1, unnest([2.0, 9.0, 5.0, 8.5, 1.0]) AS y1),
g AS (SELECT s_suppkey AS cell, s_suppkey % 10 + 0.5 AS x, 10 - s_suppkey // 10 - 0.5 AS y FROM supplier)
SELECT cell, CAST(count(*) FILTER ((y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) % 2 AS DOUBLE) AS m FROM g, e GROUP BY cell""")
def mask_polygon(spark, d):
    grid = SimpleNamespace(cols=10, rows=10, xmin=0.0, ymin=0.0, xmax=10.0, ymax=10.0)
    ring = '{"type": "Polygon", "coordinates": [[[1.0, 1.0], [8.5, 2.0], [9.0, 9.0], [4.0, 5.0], [1.5, 8.5], [1.0, 1.0]]]}'
    return stack.mask_polygon(suppliers(spark, d), grid, scalar.polygon_rings(ring))


@query("SELECT p_partkey, nullif(CAST(p_size AS DOUBLE), 7) AS value, coalesce(nullif(CAST(p_size AS DOUBLE), 7), -1) AS filled FROM part")
def sentinels(spark, d):
    v = scalar.missing(F.when(F.col("p_size") == 9, F.lit(9.0)).otherwise(F.col("p_size").cast("double")), 7)
    return table(spark, d, "part").select("p_partkey", v.alias("value"), scalar.filled(v, -1).alias("filled"))


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 5, 9, 23, 42) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM part")
def reclassify(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.member(F.col("p_size"), [1, 5, 9, 23, 42]).alias("value"))


@query(f"WITH {_STACKS} SELECT cell, year, CAST(year - 1996 AS INTEGER) AS year_idx, round(value, 4) AS value FROM a WHERE year BETWEEN 1996 AND 2000")
def year_range(spark, d):
    return stack.select_years(product(spark, d), 1996, 2000, rebase=True).select("cell", "year", "year_idx", r4("value"))


@query(f"WITH {_STACKS} SELECT cell, round(value, 4) AS v0 FROM a WHERE year = (SELECT min(year) FROM a)")
def first_image(spark, d):
    return stack.first_image(product(spark, d)).select("cell", r4("v0"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_suppkey AS cell FROM supplier WHERE s_nationkey <> 0")
def valid_cells(spark, d):
    grid = suppliers(spark, d).select("cell", F.lit(1.0).alias("v0"))
    return stack.valid_cells(grid, suppliers(spark, d), "nonzero")


@query(f"WITH {_HOLES} SELECT cell, year, round(value, 4) AS value FROM a WHERE cell NOT IN (SELECT cell FROM h WHERE year = 1995 AND value IS NULL)")
def without_missing_cells(spark, d):
    gone = holes(spark, d).where("year = 1995 and value is null")
    return stack.without_cells(product(spark, d), gone).select("cell", "year", r4("value"))


@query(f"WITH {_HOLES} SELECT cell, year, round(value, 4) AS value FROM h WHERE value IS NOT NULL")
def drop_missing(spark, d):
    return stack.drop_missing(holes(spark, d)).select("cell", "year", r4("value"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey NOT IN (0, 1)")
def column_subset(spark, d):
    return tables.subset(table(spark, d, "customer"), "c_nationkey not in (0, 1)", "c_custkey", "c_acctbal")


@query("SELECT vec_id AS cell, round(CAST(embedding[4] AS DOUBLE), 6) AS value FROM embeddings")
def component_of_rows(spark, d):
    return tables.component(table(spark, d, "embeddings").withColumnRenamed("vec_id", "cell"), "cell", "embedding", 3).withColumn("value", F.round("value", 6))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def first_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", (-F.col("c_acctbal")).alias("down"))
    return tables.first_rows(c, 25, "down", "c_custkey").drop("down")


@query("SELECT * FROM (VALUES (210, 75, 0.5::DOUBLE), (220, 75, 0.25::DOUBLE)) AS t(k, iterations, wssse)")
def local_rows(spark, d):
    t = tables.local(spark, [(210, 75, 0.5), (220, 75, 0.25)], "k int, iterations int, wssse double")
    return t.unionByName(tables.empty_like(t))


@query("SELECT p_partkey AS pos, CASE WHEN p_partkey = 5 THEN 'list.txt' ELSE p_name END AS value FROM part")
def settings_line(spark, d):
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("value"))
    return text.replace_line(lines, "pos", 5, "list.txt")


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_difference(spark, d):
    partly = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return tables.difference(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), partly, "key")


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS leap FROM orders")
def leap_years(spark, d):
    y = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return y.select("year", scalar.leap_year(F.col("year")).alias("leap"))


@query("""SELECT CAST(CAST(year(l_shipdate) AS BIGINT) AS INTEGER) AS year, CAST(floor(floor(l_suppkey / 10) / 2) * 5 + floor((l_suppkey % 10) / 2) AS BIGINT) AS cell, round(avg(l_quantity), 4) AS value
FROM lineitem GROUP BY ALL""")
def resampled(spark, d):
    lines = table(spark, d, "lineitem").select(F.lit("A").alias("product"), F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("cell"), F.col("l_quantity").alias("value"))
    return stack.resample(lines, 10, 2).select("year", "cell", r4("value"))


# Joins and painting


@query(f"""WITH {_STACKS}, c AS (SELECT cell, corr(a.value, b.value) AS r, count(*) AS n FROM a JOIN b USING (cell, year) GROUP BY cell)
SELECT s_suppkey AS cell, round(CASE WHEN NOT isnan(r) THEN r END, 6) AS corr, n FROM supplier LEFT JOIN c ON s_suppkey = cell""")
def paint_correlation(spark, d):
    c = stats.correlation(stack.pair(product(spark, d), product_b(spark, d)))
    return paint.paint(suppliers(spark, d), c.withColumn("corr", F.round("corr", 6)), "corr", "n")


@query(f"WITH {_STACKS} SELECT cell, year, round(a.value, 4) AS a, round(b.value, 4) AS b FROM a JOIN b USING (cell, year)")
def pair_products(spark, d):
    return stack.pair(product(spark, d), product_b(spark, d)).select("cell", "year", r4("a"), r4("b"))


_DAYS = """SELECT cell, year, m - 364 + cell % 9 AS value FROM (
SELECT l_suppkey AS cell, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(max(dayofyear(l_shipdate)) AS DOUBLE) AS m FROM lineitem WHERE year(l_shipdate) > 1995 GROUP BY ALL)"""


def days(spark: SparkSession, d: str) -> DataFrame:
    """Days of year, some of them negative, from the second year on."""
    lines = table(spark, d, "lineitem").where("year(l_shipdate) > 1995")
    out = lines.groupBy(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("year")).agg(F.max(F.dayofyear("l_shipdate")).cast("double").alias("m"))
    return out.select("cell", "year", (F.col("m") - 364 + F.col("cell") % 9).alias("value"))


_WRAP = f"""WITH {_STACKS}, d AS ({_DAYS}), p AS (SELECT cell, d.year, value < 0 AS negative, d.year - CAST(value < 0 AS INTEGER) AS of,
CASE WHEN value < 0 THEN (CASE WHEN d.year % 4 = 0 AND (d.year % 100 <> 0 OR d.year % 400 = 0) THEN 367 ELSE 366 END) - value ELSE value END AS b FROM d),
w AS (SELECT p.cell, p.year, a.value AS a, b, negative FROM p JOIN a ON a.cell = p.cell AND a.year = p.of)"""


@query(f"{_WRAP} SELECT cell, year, round(a, 4) AS a, b, negative FROM w")
def day_wrap(spark, d):
    return stats.day_wrapped_pairs(product(spark, d), days(spark, d)).select("cell", "year", r4("a"), "b", "negative")


@query(f"{_WRAP} SELECT cell, round(CASE WHEN NOT isnan(corr(a, b)) THEN corr(a, b) END, 6) AS corr, count(b) AS n, count(*) FILTER (negative) AS neg_cnt FROM w GROUP BY cell")
def day_correlation(spark, d):
    c = stats.day_correlation(product(spark, d), days(spark, d))
    return c.select("cell", F.round("corr", 6).alias("corr"), "n", "neg_cnt")


_ENTRIES = "e AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query(f"WITH {_ENTRIES} SELECT a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 4) AS v FROM e a JOIN e b USING (vec_id) GROUP BY ALL")
def matrix_product(spark, d):
    """Transposed embeddings times embeddings, as long matrices."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).withColumn("v", F.col("v").cast("double"))
    left, right = linalg.transpose(e).withColumnRenamed("j", "t"), e.withColumnRenamed("i", "t")
    return linalg.matmul(left, right).select("i", "j", r4("v"))


@query(f"WITH {_ENTRIES} SELECT a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 4) AS v FROM e a JOIN e b USING (vec_id) GROUP BY ALL")
def gram_matrix(spark, d):
    e = embeddings(spark, d)
    g = linalg.cross(e, e)
    return tables.local(spark, [(i, j, round(float(g[i, j]), 4)) for i, j in np.ndindex(*g.shape)], "i int, j int, v double")


# Statistics


@query(f"WITH {_STACKS} SELECT count(*) AS n FROM a")
def row_count(spark, d):
    return tables.row_count(product(spark, d))


@query(f"WITH {_HOLES} SELECT cell, count(value) AS n, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 4) AS stddev FROM h GROUP BY cell")
def cell_summary(spark, d):
    return stats.cell_summary(holes(spark, d)).select("cell", "n", r4("mean"), r4("variance"), r4("stddev"))


@query(f"WITH {_STACKS} SELECT cell, year, round(value - avg(value) OVER (PARTITION BY cell), 4) + 0 AS value FROM a")
def centred_by_cell(spark, d):
    return stats.centred(product(spark, d), "cell").select("cell", "year", (F.round("value", 4) + 0).alias("value"))


@query(f"WITH {_STACKS} SELECT cell, year, round(value - avg(value) OVER (PARTITION BY year), 4) + 0 AS value FROM a")
def centred_by_year(spark, d):
    return stats.centred(product(spark, d), "year").select("cell", "year", (F.round("value", 4) + 0).alias("value"))


@query(f"WITH {_STACKS} SELECT cell, year, round(value / sqrt(sum(value * value) OVER (PARTITION BY cell)), 6) AS value FROM a")
def normalised_rows(spark, d):
    return stats.normalised(product(spark, d)).select("cell", "year", F.round("value", 6).alias("value"))


@query(f"WITH {_STACKS} SELECT cell, year, round(value / sqrt(sum(value * value) OVER (PARTITION BY year)), 6) AS value FROM a")
def normalised_years(spark, d):
    return stats.normalised(product(spark, d), "year").select("cell", "year", F.round("value", 6).alias("value"))


@query(f"""WITH {_STACKS}, m AS (SELECT year, sqrt(sum((a.value - b.value) ** 2)) AS direct, sqrt(sum((a.value + b.value) ** 2)) AS mirrored FROM a JOIN b USING (cell, year) GROUP BY year)
SELECT year, round(direct, 3) AS direct, round(mirrored, 3) AS mirrored, round(CASE WHEN direct > 1 THEN mirrored ELSE direct END, 3) AS distance FROM m""")
def sign_free_distance(spark, d):
    out = stats.distance(product(spark, d), product_b(spark, d), "cell", by="year")
    return out.select("year", *[F.round(c, 3).alias(c) for c in ("direct", "mirrored", "distance")])


_REVENUE = "WITH r AS (SELECT CAST(n_nationkey AS INTEGER) AS mode, round(sum(s_acctbal), 2) AS value FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1)"


@query(f"""{_REVENUE}, t AS (SELECT mode, value, value * value / sum(value * value) OVER () AS share FROM r)
SELECT mode, value, round(share, 8) AS share, round(sum(share) OVER (ORDER BY mode), 8) AS cumulative, round(sum(value) OVER (ORDER BY mode), 2) AS cumulative_value FROM t""")
def variance_explained(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("mode")).agg(F.round(F.sum("s_acctbal"), 2).alias("value"))
    v = stats.variance_explained(s)
    return v.select("mode", "value", F.round("share", 8).alias("share"), F.round("cumulative", 8).alias("cumulative"), F.round("cumulative_value", 2).alias("cumulative_value"))


@query("SELECT CAST(least(floor((l_quantity - 1) / 4.9), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1")
def value_histogram(spark, d):
    return stats.histogram(table(spark, d, "lineitem").withColumnRenamed("l_quantity", "value"), 10, 1.0, 50.0)


@query(f"WITH {_HOLES} SELECT round(min(value), 4) AS low, round(max(value), 4) AS high FROM h")
def value_limits(spark, d):
    return stats.limits(holes(spark, d)).select(r4("low"), r4("high"))


@query(f"WITH {_STACKS} SELECT year, count(DISTINCT cell) AS cells FROM a GROUP BY year")
def cells_per_year(spark, d):
    return tables.cells_per_year(product(spark, d))


# Singular values


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return stack.matrix(product(spark, d), YEARS), stack.matrix(product_b(spark, d), YEARS)


def _both_kept(spark: SparkSession, d: str) -> list[DataFrame]:
    """Both as tables: their factors, means and vectors take several passes, and the lines are read and summed only once."""
    return [Scratch(spark).keep(x, "stack") for x in _both(spark, d)]


@query(f"""WITH {_STACKS}, ga AS (SELECT x.year AS i, y.year AS j, sum(x.value * y.value) AS v FROM a x JOIN a y USING (cell) GROUP BY ALL),
gb AS (SELECT x.year AS i, y.year AS j, sum(x.value * y.value) AS v FROM b x JOIN b y USING (cell) GROUP BY ALL)
SELECT round(sqrt(sum(ga.v * gb.v)) / 1e6, 3) AS frobenius FROM ga JOIN gb USING (i, j)""")
def product_svd_norm(spark, d):
    """Sum of squared singular values of A B^T = its squared Frobenius norm."""
    m = linalg.product_svd(*_both(spark, d))
    return spark.createDataFrame([(round(float(np.sqrt((m.s**2).sum())) / 1e6, 3),)], "frobenius double")


def _entries(m: linalg.Modes, places: int) -> DataFrame:
    """The product that modes stand for, entry by entry: free of the vectors' signs, and right only if all of them are."""
    return linalg.expanded(m).select("i", "j", scalar.rounded(F.col("v"), places).alias("v"))


def _product(left: str, right: str, places: int) -> str:
    """SQL of a product of two stacks (cell, year, value), cells by cells."""
    return f"SELECT x.cell AS i, y.cell AS j, round(sum(x.value * y.value), {places}) + 0 AS v FROM {left} x JOIN {right} y USING (year) GROUP BY ALL"


_BY_CELL = "ca AS (SELECT cell, year, value - avg(value) OVER (PARTITION BY cell) AS value FROM a), cb AS (SELECT cell, year, value - avg(value) OVER (PARTITION BY cell) AS value FROM b)"
_BY_YEAR = _BY_CELL.replace("PARTITION BY cell", "PARTITION BY year")
_UNIT = "SELECT cell, year, value / sqrt(sum(value * value) OVER (PARTITION BY cell)) AS value FROM"
#: Leading right singular vector of each stack, by power iteration on its Gram matrix; all entries are positive.
_LEADING = "".join(
    f"""g{t} AS (SELECT x.year AS i, y.year AS j, sum(x.value * y.value) AS v FROM {t} x JOIN {t} y USING (cell) GROUP BY ALL),
r{t} AS (SELECT list(r ORDER BY i) AS r FROM (SELECT i, list(v ORDER BY j) AS r FROM g{t} GROUP BY i)),
p{t} AS (SELECT 0 AS n, list_transform(r, lambda q: 1.0::DOUBLE) AS x, r FROM r{t} UNION ALL SELECT n + 1, list_transform(r, lambda q: list_inner_product(q, x) / list_inner_product(r[1], x)), r FROM p{t} WHERE n < 80),
v{t} AS (SELECT 1994 + k AS year, x[k] / sqrt(list_inner_product(x, x)) AS v FROM (SELECT x, unnest(range(1, 8)) AS k FROM p{t} WHERE n = 80)),
s{t} AS (SELECT cell, sum(value * v) AS s FROM {t} JOIN v{t} USING (year) GROUP BY cell),
"""
    for t in "ab"
)


@query(f"WITH {_STACKS} SELECT cell, year, round(value * 0.7310585786300049, 4) AS value FROM a")
def svd_modes(spark, d):
    """Left vectors times values times right vectors of one stack: its entries, scaled as many of them lie between two rounded numbers."""
    u, s, vt = linalg.svd(_both(spark, d)[0])
    back = linalg.times(u, s[:, None] * vt).select("cell", F.posexplode("features").alias("k", "value"))
    return back.select("cell", (F.col("k") + YEARS[0]).alias("year"), F.round(F.col("value") * 0.7310585786300049, 4).alias("value"))


@query(f"WITH {_STACKS}, {_BY_CELL} {_product('ca', 'cb', 1)}")
def centred_product_modes(spark, d):
    return _entries(linalg.product_svd(*(linalg.prepared(x, 1) for x in _both_kept(spark, d))), 1)


@query(f"WITH {_STACKS} {_product('a', 'b', 1)}")
def product_svd_modes(spark, d):
    return _entries(linalg.product_svd(*_both_kept(spark, d)), 1)


@query(f"""WITH {_STACKS}, u AS (SELECT cell, unnest([0, 1]) AS mode, unnest([1.0, cell]) AS u, unnest([1e6, 3e6]) AS s, unnest([1.0, cell + 0.5]) AS v FROM (SELECT DISTINCT cell FROM a)),
ta AS (SELECT mode, year, sum(value * u) AS t FROM a JOIN u USING (cell) GROUP BY ALL), tb AS (SELECT mode, year, sum(value * v) AS t FROM b JOIN u USING (cell) GROUP BY ALL),
fa AS (SELECT mode, cell, sum(value * t) AS f FROM a JOIN tb USING (year) GROUP BY ALL), fb AS (SELECT mode, cell, sum(value * t) AS f FROM b JOIN ta USING (year) GROUP BY ALL)
SELECT CAST(mode AS INTEGER) AS mode, round(greatest(sqrt(sum((u - fa.f / s) ** 2)), sqrt(sum((v - fb.f / s) ** 2))), 4) AS residual FROM u JOIN fa USING (mode, cell) JOIN fb USING (mode, cell) GROUP BY mode""")
def svd_residuals(spark, d):
    """How far given vectors are from being modes of the product."""
    a, b = _both(spark, d)
    u, v = (x.select("cell", F.array(F.lit(1.0), F.col("cell") + shift).alias("features")) for x, shift in ((a, 0.0), (b, 0.5)))
    found = linalg.residuals(a, b, linalg.Modes(u, np.array([1e6, 3e6]), v))
    return tables.local(spark, [(k, round(float(x), 4)) for k, x in enumerate(found)], "mode int, residual double")


@query(f"WITH {_STACKS}, {_BY_YEAR} {_product('ca', 'cb', 1)}")
def maximum_covariance(spark, d):
    return _entries(linalg.mca(*_both_kept(spark, d)), 1)


@query(f"WITH {_STACKS}, na AS ({_UNIT} a), nb AS ({_UNIT} b) {_product('na', 'nb', 6)}")
def canonical_correlation(spark, d):
    return _entries(linalg.cca(*_both_kept(spark, d)), 6)


@query(f"WITH {_STACKS}, {_BY_YEAR}, na AS ({_UNIT} ca), nb AS ({_UNIT} cb) {_product('na', 'nb', 6)}")
def generalised_correlation(spark, d):
    """Of two stacks, whose modes are those of their product."""
    values, parts = linalg.gcca(*_both_kept(spark, d))
    return _entries(linalg.Modes(parts[0], values, parts[1]), 6)


@query(f"WITH RECURSIVE {_STACKS}, {_LEADING} one AS (SELECT 1) SELECT cell, CAST(year AS INTEGER) AS year, round(s * v, 4) AS value FROM sa, va")
def low_rank_matrix(spark, d):
    out = linalg.low_rank(_both(spark, d)[0], 1).select("cell", F.posexplode("features").alias("k", "value"))
    return out.select("cell", (F.col("k") + YEARS[0]).alias("year"), r4("value"))


@query(f"WITH RECURSIVE {_STACKS}, {_LEADING} c AS (SELECT sum(va.v * vb.v) AS c FROM va JOIN vb USING (year)) SELECT sa.cell AS i, sb.cell AS j, round(sa.s * c * sb.s, 1) AS v FROM sa, sb, c")
def product_svd_by_svd(spark, d):
    """Modes of the product of two approximations of rank one."""
    return _entries(linalg.product_svd(*_both_kept(spark, d), p=1, q=1), 1)


@query(f"""WITH {_STACKS}, {_BY_CELL},
ga AS (SELECT x.year AS i, y.year AS j, sum(x.value * y.value) AS v FROM ca x JOIN ca y USING (cell) GROUP BY ALL),
gb AS (SELECT x.year AS i, y.year AS j, sum(x.value * y.value) AS v FROM cb x JOIN cb y USING (cell) GROUP BY ALL),
m1 AS (SELECT ga.i, gb.j, sum(ga.v * gb.v) AS v FROM ga JOIN gb ON ga.j = gb.i GROUP BY ALL),
m2 AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM m1 x JOIN m1 y ON x.j = y.i GROUP BY ALL),
m3 AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM m2 x JOIN m1 y ON x.j = y.i GROUP BY ALL),
t AS (SELECT 1 AS power, v FROM m1 WHERE i = j UNION ALL SELECT 2, v FROM m2 WHERE i = j UNION ALL SELECT 3, v FROM m3 WHERE i = j)
SELECT CAST(power AS INTEGER) AS power, round(ln(sum(v)), 6) AS log_sum FROM t GROUP BY power""")
def randomised_values(spark, d):
    """Sums of powers of the squared singular values, which traces of the Gram matrices give without them."""
    s = linalg.randomised_product(*(linalg.prepared(x, 1) for x in _both(spark, d)), len(YEARS))
    return tables.local(spark, [(p, round(float(np.log((s ** (2 * p)).sum())), 6)) for p in (1, 2, 3)], "power int, log_sum double")


# Clustering

_CENTRES = [[20.0] * 7, [25.0] * 7, [26.0] * 7, [30.0] * 7]
_NEAREST = f"""WITH {_STACKS}, c AS (SELECT unnest([0, 1, 2, 3]) AS cluster, unnest([20.0, 25.0, 26.0, 30.0]) AS v),
e AS (SELECT cell, cluster, sum((value - v) * (value - v)) AS d2 FROM a, c GROUP BY ALL),
n AS (SELECT cell, cluster, d2 FROM e QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(d2, 8), cluster) = 1)"""


@query(f"{_NEAREST} SELECT cell, CAST(cluster AS INTEGER) AS cluster, round(d2, 4) AS d2 FROM n")
def nearest_centre(spark, d):
    return cluster.nearest(stack.matrix(product(spark, d), YEARS), _CENTRES).select("cell", "cluster", r4("d2"))


@query(f"{_NEAREST} SELECT round(sum(d2), 3) AS wssse FROM n")
def clustering_cost(spark, d):
    return cluster.cost(cluster.nearest(stack.matrix(product(spark, d), YEARS), _CENTRES)).select(F.round("wssse", 3).alias("wssse"))


#: Cells in four groups far apart, so that the best clusters are known: k clusters part the groups as `parted` says.
_LEVELS = [0.0, 30.0, 3000.0, 4000.0]
_GROUPED = f"{_STACKS}, h AS (SELECT cell, year, cell % 4 AS g, value + ([0.0, 30.0, 3000.0, 4000.0])[cell % 4 + 1] AS value FROM a)"


def grouped(spark: SparkSession, d: str, column: str = "l_quantity", name: str = "A") -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.col("cell") % 4 + 1).cast("int"))
    return product(spark, d, column, name).withColumn("value", F.col("value") + level)


@query(f"""WITH {_GROUPED}, parted AS (SELECT unnest([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4]) AS k, unnest([0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 3]) AS g, unnest([0, 0, 1, 1, 0, 0, 1, 2, 0, 1, 2, 3]) AS c),
e AS (SELECT k, (value - avg(value) OVER (PARTITION BY k, c, year)) ** 2 AS e FROM h JOIN parted USING (g))
SELECT CAST(k AS INTEGER) AS k, 20 AS iterations, round(ln(sum(e)), 4) AS log_wssse FROM e GROUP BY k""")
def kmeans_sweep(spark, d):
    """The elbow table."""
    t = cluster.sweep(stack.matrix(grouped(spark, d), YEARS), cluster.k_values(2, 4, 1), 20)
    return t.select("k", "iterations", F.round(F.ln("wssse"), 4).alias("log_wssse"))


@query(f"WITH {_GROUPED} SELECT s_suppkey AS cell, round(value, 4) AS value FROM supplier LEFT JOIN (SELECT cell, avg(value) OVER (PARTITION BY g) AS value FROM h WHERE year = 1995) ON cell = s_suppkey")
def kmeans_painted(spark, d):
    """Cells painted with the first coordinate of their cluster's centre; the model goes through its files."""
    with Scratch(spark) as tmp:
        m = stack.matrix(grouped(spark, d), YEARS)
        path = tmp.path("models")
        cluster.sweep(m, [4], 20, path)
        out = cluster.predict(cluster.load(f"{path}/4"), m)
        return tmp.keep(paint.paint(suppliers(spark, d), out.select("cell", r4("value")), "value"))


@query(f"""WITH {_GROUPED}, t AS (SELECT l_suppkey AS cell, CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_tax) AS value FROM lineitem GROUP BY ALL)
SELECT h.year, cell, round(avg(h.value) OVER (PARTITION BY g), 4) AS value FROM h JOIN t USING (cell, year)""")
def kmeans_pairs(spark, d):
    """Years and cells clustered by the values of both products."""
    p = cluster.pair_features(stack.pair(grouped(spark, d), product(spark, d, "l_tax", "C")))
    model, _ = cluster.train(cluster.vectors(p), 4, 20)
    return cluster.predict(model, p, "year", "cell").select("year", "cell", r4("value"))


@query(f"WITH {_GROUPED} SELECT cell, round(avg(value) OVER (PARTITION BY g), 4) AS value FROM h WHERE year = 1995")
def kmeans_image(spark, d):
    """A single image's cells, clustered by their one value."""
    one = stack.select_years(grouped(spark, d), 1995, 1995).select("cell", F.array("value").alias("features"))
    model, _ = cluster.train(cluster.vectors(one), 4, 20)
    return cluster.predict(model, one).select("cell", r4("value"))


_BLOCKS = f"""WITH {_STACKS}, z AS (SELECT cell AS i, year AS j, value AS z FROM a), g AS (SELECT avg(z) AS g FROM z),
m AS (SELECT i % 3 AS rc, j % 2 AS cc, (sum(z) + g * 1e-8) / (count(*) + 1e-8) AS m FROM z, g GROUP BY i % 3, j % 2, g)"""


def _coclusters(spark: SparkSession, d: str):
    z = product(spark, d).select(F.col("cell").alias("i"), F.col("year").cast("long").alias("j"), F.col("value").alias("z"), F.lit(1.0).alias("w"))
    return z, cluster.CoClusters(3, 2, start="mod")


@query(f"{_BLOCKS} SELECT CAST(rc AS INTEGER) AS rc, CAST(cc AS INTEGER) AS cc, round(m, 4) AS m FROM m")
def block_means(spark, d):
    z, model = _coclusters(spark, d)
    rows, cols = model._first(z.select("i").distinct(), "i", 3, 0), model._first(z.select("j").distinct(), "j", 2, 0)
    m = model.means(model.sums(z, "i", "j", cols), "i", rows, z.agg(F.avg("z")).first()[0])
    return spark.createDataFrame([(a, b, round(m[a][b], 4)) for a in range(3) for b in range(2)], "rc int, cc int, m double")


def _assigned(divergence: bool) -> str:
    far = "sum((m + 1e-8) - z * ln(m + 1e-8))" if divergence else "sum((z - m) * (z - m))"
    return f"{_BLOCKS}, e AS (SELECT i, rc, {far} AS d FROM z JOIN m ON j % 2 = cc GROUP BY ALL) SELECT i, CAST(rc AS INTEGER) AS c, round(d, 4) AS d FROM e QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, rc) = 1"


def _row_step(spark: SparkSession, d: str, distance: str) -> DataFrame:
    z, model = _coclusters(spark, d)
    model = cluster.CoClusters(3, 2, distance, start="mod")
    rows, cols = model._first(z.select("i").distinct(), "i", 3, 0), model._first(z.select("j").distinct(), "j", 2, 0)
    sums = model.sums(z, "i", "j", cols)
    return model.assign(sums, "i", model.means(sums, "i", rows, z.agg(F.avg("z")).first()[0])).select("i", "c", r4("d"))


@query(_assigned(False))
def cocluster_rows_euclidean(spark, d):
    return _row_step(spark, d, "euclidean")


@query(_assigned(True))
def cocluster_rows_divergence(spark, d):
    return _row_step(spark, d, "divergence")


@query(f"""{_BLOCKS}, e AS (SELECT i, rc, sum((z - m) * (z - m)) AS d FROM z JOIN m ON j % 2 = cc GROUP BY ALL),
r AS (SELECT i, rc FROM e QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, rc) = 1),
n AS (SELECT rc, j % 2 AS cc, (sum(z) + g * 1e-8) / (count(*) + 1e-8) AS m FROM z JOIN r USING (i), g GROUP BY rc, j % 2, g),
f AS (SELECT j, cc, sum((z - m) * (z - m)) AS d FROM z JOIN r USING (i) JOIN n USING (rc) GROUP BY ALL),
c AS (SELECT j, cc FROM f QUALIFY row_number() OVER (PARTITION BY j ORDER BY d, cc) = 1)
SELECT 'row' AS side, i AS id, CAST(rc AS INTEGER) AS c FROM r UNION ALL SELECT 'col', CAST(j AS BIGINT), CAST(cc AS INTEGER) FROM c""")
def cocluster(spark, d):
    """Rows and columns after one whole step from a stated start."""
    z, _ = _coclusters(spark, d)
    rows, cols, _ = cluster.CoClusters(3, 2, start="mod", iterations=1, runs=1).fit(z)
    return rows.select(F.lit("row").alias("side"), F.col("i").alias("id"), "c").unionByName(cols.select(F.lit("col").alias("side"), F.col("j").alias("id"), "c"))


# Sinks and round trips


@query(f"WITH {_STACKS} SELECT cell, year, round(value, 4) AS value FROM a")
def parquet_round_trip(spark, d):
    with Scratch(spark) as tmp:
        return tmp.keep(product(spark, d)).select("cell", "year", r4("value"))


@query(f"WITH {_STACKS} SELECT cell, round(value, 4) AS value FROM a WHERE year = 1996")
def kept_by_parameters(spark, d):
    with Scratch(spark) as tmp:
        make = lambda: stack.select_years(product(spark, d), 1996, 1996)
        for _ in range(2):
            out = computed(spark, tmp.top, "stack", {"path": d, "years": [1996, 1996]}, make)
        return out.select("cell", r4("value"))


@query("""SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS line, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) + 0 AS total,
round(list_sum(list_transform(range(1, len(embedding) + 1), lambda k: k * CAST(embedding[k] AS DOUBLE))), 3) + 0 AS weighted FROM embeddings""")
def csv_matrix_round_trip(spark, d):
    """Rows of numbers through sorted lines: each line's numbers, by sums that tell their places apart."""
    with Scratch(spark) as tmp:
        path = tmp.path("rows")
        text.write_rows(embeddings(spark, d), path, "features", "cell")
        lines = text.read_lines(spark, path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"), text.parse_numbers(F.col("value")).alias("x"))
        add = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v)
        out = lines.select(
            (F.row_number().over(Window.orderBy("file", "id")) - 1).alias("line"), F.size("x").cast("long").alias("n"), F.round(F.get("x", 0), 5).alias("first"),
            (F.round(add(F.col("x")), 4) + 0).alias("total"), (F.round(add(F.transform("x", lambda v, k: v * (k + 1))), 3) + 0).alias("weighted"),
        )
        return tmp.keep(out)


@query("SELECT string_agg(printf('%.1f', n_nationkey * 0.5), ',' ORDER BY n_nationkey % 5) AS value FROM nation GROUP BY n_nationkey // 5")
def transposed_lines(spark, d):
    """Vectors (mode, cell, value) as a line for each cell."""
    v = table(spark, d, "nation").select((F.col("n_nationkey") % 5).alias("mode"), F.floor(F.col("n_nationkey") / 5).alias("cell"), (F.col("n_nationkey") * 0.5).alias("value"))
    with Scratch(spark) as tmp:
        path = tmp.path("lines")
        text.write_transposed(v, path)
        return tmp.keep(text.read_lines(spark, path))


@query("SELECT CAST(n_nationkey + 2 AS INTEGER) AS _c0, 75 AS _c1, n_nationkey * 1.5::DOUBLE + 0.25 AS _c2 FROM nation")
def elbow_csv_round_trip(spark, d):
    with Scratch(spark) as tmp:
        t = table(spark, d, "nation").select((F.col("n_nationkey") + 2).cast("int").alias("k"), F.lit(75).alias("iterations"), (F.col("n_nationkey") * 1.5 + 0.25).alias("wssse"))
        path = tmp.path("elbow")
        text.write_elbow(t, path)
        return tmp.keep(text.read_elbow(spark, path))


@query("SELECT CAST(a.r_regionkey AS INTEGER) AS mode, CAST(b.r_regionkey AS INTEGER) AS j, CASE WHEN a.r_regionkey = b.r_regionkey THEN 10.0::DOUBLE - a.r_regionkey ELSE 0.0::DOUBLE END AS value FROM region a, region b")
def diagonal_matrix(spark, d):
    s = table(spark, d, "region").select(F.col("r_regionkey").alias("mode"), (F.lit(10.0) - F.col("r_regionkey")).alias("value"))
    return text.diagonal(s).select("mode", F.posexplode("values").alias("j", "value"))


@query("""WITH v AS (SELECT CAST(n_regionkey AS INTEGER) AS mode, n_nationkey AS cell, n_nationkey * 0.5 AS value FROM nation)
SELECT mode, 0 AS line_no, string_agg(printf('%.1f', value), ',' ORDER BY cell) AS line FROM v GROUP BY mode
UNION ALL SELECT CAST(r_regionkey AS INTEGER), 1, printf('%.1f', r_regionkey::DOUBLE) FROM region
UNION ALL SELECT mode, 2, string_agg(printf('%.1f', value), ',' ORDER BY cell) FROM v GROUP BY mode""")
def mode_text(spark, d):
    v = table(spark, d, "nation").select(F.col("n_regionkey").alias("mode"), F.col("n_nationkey").alias("cell"), (F.col("n_nationkey") * 0.5).alias("value"))
    s = table(spark, d, "region").select(F.col("r_regionkey").alias("mode"), F.col("r_regionkey").cast("double").alias("value"))
    return text.mode_lines(v, s, v)


def _grid(spark: SparkSession, d: str) -> SimpleNamespace:
    """Ten columns, and rows for all suppliers."""
    rows = -(-(table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] + 1) // 10)
    return SimpleNamespace(cols=10, rows=rows, xmin=-10.0, ymin=50.0 - rows, xmax=0.0, ymax=50.0, epsg=4326)


_ROWS = "(SELECT CAST(ceil((max(s_suppkey) + 1) / 10) AS INTEGER) FROM supplier)"


def _written(spark: SparkSession, d: str, tmp: Scratch) -> str:
    """Product A as one raster a year."""
    top = tmp.path("rasters")
    paint.write_each(product(spark, d), _grid(spark, d), "year", top)
    return top


@query(f"WITH {_STACKS} SELECT cell, year, round(value, 4) AS value FROM a WHERE year BETWEEN 1996 AND 1999")
def raster_round_trip(spark, d):
    with Scratch(spark) as tmp:
        s = stack.read_stack(spark, _written(spark, d, tmp), "A", years=(1996, 1999))
        return tmp.keep(stack.drop_missing(s).select("cell", "year", r4("value")))


@query(f"WITH {_STACKS} SELECT cell, year, round(value * 0.7310585786300049, 4) AS value FROM b WHERE cell IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 0)")
def masked_band(spark, d):
    """The second of two bands, where a mask file has no zero."""
    both = product(spark, d).join(product_b(spark, d).withColumnRenamed("value", "b"), ["cell", "year"])
    with Scratch(spark) as tmp:
        top, mask, grid = tmp.path("rasters"), tmp.path("mask") + ".tif", _grid(spark, d)
        paint.write_each(both, grid, "year", top, ["value", "b"])
        rasters.write_raster(suppliers(spark, d), grid, mask, "m")
        s = stack.read_stack(spark, top, "B", band=1, mask=mask, rule="nonzero")
        return tmp.keep(stack.drop_missing(s).select("cell", "year", F.round(F.col("value") * 0.7310585786300049, 4).alias("value")))


@query("SELECT s_suppkey AS cell, CAST(s_nationkey AS DOUBLE) AS m FROM supplier")
def mask_round_trip(spark, d):
    with Scratch(spark) as tmp:
        path = tmp.path("mask") + ".tif"
        rasters.write_raster(suppliers(spark, d), _grid(spark, d), path, "m")
        return tmp.keep(rasters.load_mask(spark, path).where("m is not null"))


@query(f"WITH {_STACKS} SELECT CAST(row_number() OVER (ORDER BY year) - 1 AS INTEGER) AS year_idx, year FROM (SELECT DISTINCT year FROM a)")
def raster_listing(spark, d):
    with Scratch(spark) as tmp:
        return tmp.keep(rasters.list_files(spark, _written(spark, d, tmp)).select("year_idx", "year"))


@query(f"WITH {_STACKS} SELECT DISTINCT year, 0 AS band, 10 AS cols, {_ROWS} AS rows, -10.0::DOUBLE AS xmin, 50.0::DOUBLE - {_ROWS} AS ymin, 4326 AS epsg, 'float64' AS cell_type FROM a")
def raster_profile(spark, d):
    with Scratch(spark) as tmp:
        return tmp.keep(rasters.profile(spark, _written(spark, d, tmp)).select("year", "band", "cols", "rows", "xmin", "ymin", "epsg", "cell_type"))


@query(f"SELECT 10 AS cols, {_ROWS} AS rows, -10.0::DOUBLE AS xmin, 50.0::DOUBLE - {_ROWS} AS ymin, 0.0::DOUBLE AS xmax, 50.0::DOUBLE AS ymax, 4326 AS epsg, 'float64' AS cell_type")
def grid_metadata_round_trip(spark, d):
    with Scratch(spark) as tmp:
        path = tmp.path("grid")
        rasters.save_grid(rasters.grid_of(spark, _written(spark, d, tmp)), path)
        return tmp.keep(rasters.load_grid(spark, path))


@query(f"WITH {_STACKS} SELECT '1997.tif' AS name, cell, round(value, 4) AS value FROM a WHERE year = 1997")
def raster_lookup(spark, d):
    """One file by its name, and what is in it."""
    with Scratch(spark) as tmp:
        found = rasters.lookup(spark, _written(spark, d, tmp), "1997.tif")
        name = F.regexp_extract("path", "[^/]*$", 0).alias("name")
        cells = rasters.decoded(found).select(name, "first", F.posexplode("cells").alias("pos", "value"))
        return tmp.keep(cells.where("not isnan(value)").select("name", (F.col("first") + F.col("pos")).alias("cell"), r4("value")))


@query(f"WITH {_STACKS} SELECT cell, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS stddev FROM a GROUP BY cell")
def streamed_summary(spark, d):
    """Rasters that arrive as a stream, a few at a time, and their cells' sums so far."""
    with Scratch(spark) as tmp:
        out, state = tmp.path("summary"), tmp.path("state")
        s = running_summary(stack.drop_missing(watch_stack(spark, _written(spark, d, tmp), "A", files_at_once=3)))
        follow = s.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", state)
        follow.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
        return spark.read.parquet(out).select("cell", "n", r4("mean"), r4("stddev"))


@query("SELECT p_partkey, CAST((p_partkey // 10) * 10 + p_partkey % 10 AS BIGINT) AS cell FROM part")
def flat_positions(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", scalar.flat_index(F.floor(F.col("p_partkey") / 10), F.col("p_partkey") % 10, 10).alias("cell"))


@query("SELECT upper(n_name) AS value FROM nation")
def external_program(spark, d):
    return text.through_program(table(spark, d, "nation").select(F.col("n_name").alias("value")), "tr a-z A-Z")
