"""Stacks of rasters as keyed long tables.

stack(product, year, cell, value): value is null where there is no data; cell is the row-major position in the first file.
Keys are carried through every step, so no result depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.scalar import in_polygon, missing
from cellweave.sources.rasters import load_mask, read_rasters


def explode_cells(rasters: DataFrame, product: str = "", sentinels: tuple[float, ...] = ()) -> DataFrame:
    """One row for each year and cell."""
    long = rasters.select(F.lit(product).alias("product"), "year", "first", F.posexplode("cells").alias("pos", "value"))
    return long.select("product", "year", (F.col("first") + F.col("pos")).alias("cell"), missing(F.col("value"), *sentinels).alias("value"))


def read_stack(spark: SparkSession, path: str, product: str = "", band: int = 0, years: tuple[int, int] | None = None, mask: DataFrame | str | None = None, rule: str = "one", sentinels: tuple[float, ...] = (), glob: str = "*.tif") -> DataFrame:
    """Load, choose band and years, turn sentinels to null, and keep the cells that the mask, (cell, m) or a file, keeps."""
    if isinstance(mask, str):
        mask = load_mask(spark, mask)
    out = explode_cells(read_rasters(spark, path, band, years, glob), product, sentinels)
    return out if mask is None else keep_masked(out, mask, rule)


def _kept(m: Column, rule: str) -> Column:
    return {"one": m == 1, "nonzero": (m != 0) & ~F.isnan(m)}[rule]


def mask_values(stack: DataFrame, mask: DataFrame, rule: str = "one") -> DataFrame:
    """Values outside the mask (cell, m) become null, rows stay.  rule one: m = 1 keeps; nonzero: all but 0 and NaN."""
    kept = mask.where(_kept(F.col("m"), rule)).select("cell", F.lit(True).alias("in_mask"))
    return stack.join(kept, "cell", "left").select(*[c for c in stack.columns if c != "value"], F.when(F.col("in_mask"), F.col("value")).alias("value"))


def keep_masked(stack: DataFrame, mask: DataFrame, rule: str = "one") -> DataFrame:
    """Only rows of cells that the mask keeps.  Spark broadcasts the mask where its statistics allow."""
    return stack.join(mask.where(_kept(F.col("m"), rule)).select("cell"), "cell", "left_semi")


def mask_polygon(grid_cells: DataFrame, grid, rings: list) -> DataFrame:
    """(cell, m): 1.0 for cells of the grid whose centre lies in the polygon, else 0.0.  grid: a row with cols, rows and extent."""
    row, col = F.floor(F.col("cell") / grid.cols), F.col("cell") % grid.cols
    x = F.lit(grid.xmin) + (col + 0.5) * ((grid.xmax - grid.xmin) / grid.cols)
    y = F.lit(grid.ymax) - (row + 0.5) * ((grid.ymax - grid.ymin) / grid.rows)
    return grid_cells.select("cell", in_polygon(x, y, rings).cast("double").alias("m"))


def drop_missing(stack: DataFrame) -> DataFrame:
    return stack.where("value is not null and not isnan(value)")


def without_cells(stack: DataFrame, cells: DataFrame) -> DataFrame:
    return stack.join(cells.select("cell"), "cell", "left_anti")


def select_years(stack: DataFrame, first: int, last: int, rebase: bool = False) -> DataFrame:
    """Both ends in; with rebase, a column year_idx counts from the first of them."""
    if first > last:
        raise ValueError(f"the first year {first} is after the last {last}")
    out = stack.where(F.col("year").between(first, last))
    return out.withColumn("year_idx", F.col("year") - first) if rebase else out


def first_image(stack: DataFrame) -> DataFrame:
    """Template grid (cell, v0): all cells of the first year of the whole series."""
    first = stack.agg(F.min("year").alias("year"))
    return stack.join(F.broadcast(first), "year").select("cell", F.col("value").alias("v0"))


def valid_cells(template: DataFrame, mask: DataFrame | None = None, rule: str = "one", parts: int | None = None) -> DataFrame:
    """(pos, cell): rank from 0 of the cells that the mask keeps (without one, of those with a value in the template).

    Ranks go in two levels: within ranges of cells, and over the ranges' sizes, so that no task holds all cells.
    """
    kept = template.where("v0 is not null").select("cell") if mask is None else keep_masked(template, mask, rule).select("cell")
    part = F.floor(F.col("cell") / 65536).alias("part")
    sizes = kept.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("cell"))
    return kept.withColumn("part", part).join(before, "part").select((F.col("base") + inside - 1).alias("pos"), "cell")


def matrix(stack: DataFrame, years: list[int], key: str = "cell", strict: bool = False) -> DataFrame:
    """(cell, features): one array entry for each year.

    A missing year counts as 0 and a cell without any value has no row; strict keeps only cells that have all years.
    One hash aggregation with map-side combine, a column for each of the few years; of repeated rows the greatest value counts.
    """
    have = drop_missing(stack).where(F.col("year").isin(*years))
    got = have.groupBy(key).agg(*[F.max(F.when(F.col("year") == y, F.col("value"))).alias(f"__{y}") for y in years])
    if strict:
        got = got.na.drop(how="any")
    return got.select(key, F.array(*[F.coalesce(f"__{y}", F.lit(0.0)) for y in years]).alias("features"))


def wide(stack: DataFrame, years: list[int]) -> DataFrame:
    """One nullable column for each year."""
    return stack.groupBy("cell").pivot("year", years).agg(F.first("value", ignorenulls=True))


def long(wide_table: DataFrame, years: list[int]) -> DataFrame:
    """The inverse of wide()."""
    return wide_table.unpivot("cell", [F.col(str(y)) for y in years], "year", "value").withColumn("year", F.col("year").cast("int"))


def complete_rows(wide_table: DataFrame, least: int) -> DataFrame:
    """Rows with at least `least` values besides the key."""
    return wide_table.na.drop(thresh=least + 1)


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cell, year, a, b) of cells and years that both products have."""
    return drop_missing(a).select("cell", "year", F.col("value").alias("a")).join(drop_missing(b).select("cell", "year", F.col("value").alias("b")), ["cell", "year"])


def stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both products' rows in one table."""
    return a.unionByName(b)


def resample(stack: DataFrame, cols: int, factor: int) -> DataFrame:
    """Block means, `factor` cells to each side."""
    row, col = F.floor(F.floor(F.col("cell") / cols) / factor), F.floor((F.col("cell") % cols) / factor)
    width = -(-cols // factor)
    return stack.groupBy("product", "year", (row * width + col).alias("cell")).agg(F.avg("value").alias("value"))
