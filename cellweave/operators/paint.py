"""Results back on the full grid."""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.sources.rasters import encoded, save_bytes


def paint(grid: DataFrame, result: DataFrame, *values: str, key: str = "cell") -> DataFrame:
    """Every cell of the grid with its result; null where there is none.  One join serves any number of values."""
    return grid.select(key).join(result.select(key, *values), key, "left")


def dense(values: DataFrame, n: int, key: str = "pos", value: str = "value") -> DataFrame:
    """Positions 0 to n - 1, each with its value or null."""
    return values.sparkSession.range(n).withColumnRenamed("id", key).join(values.select(key, value), key, "left")


def write_each(painted: DataFrame, grid, by: str, path: str, value: str | list[str] = "value") -> list[str]:
    """A raster for each value of `by` (years or modes, few; null has none), with a band for each value column, made by one task each in a single job; the driver stores one file after another."""
    about = SimpleNamespace(**{k: getattr(grid, k) for k in ("cols", "rows", "xmin", "ymin", "xmax", "ymax", "epsg")})

    def one(table: pa.Table) -> pa.Table:
        blob = encoded(table.column("cell").to_numpy(), [c.to_numpy(zero_copy_only=False) for c in table.columns[2:]], about)
        return pa.table({"name": [str(table.column("k")[0].as_py())], "blob": pa.array([blob], pa.binary())})

    names = [value] if isinstance(value, str) else value
    rows = painted.where(F.col(by).isNotNull()).select(F.col(by).alias("k"), "cell", *(F.col(v).cast("double").alias(f"v{n}") for n, v in enumerate(names)))
    out = []
    for name, blob in rows.groupBy("k").applyInArrow(one, "name string, blob binary").toLocalIterator():
        save_bytes(painted.sparkSession, f"{path}/{name}.tif", bytes(blob))
        out.append(f"{path}/{name}.tif")
    return sorted(out)
