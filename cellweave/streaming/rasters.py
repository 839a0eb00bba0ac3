"""Rasters as they arrive: new yearly files become rows of the stack, and per-cell sums follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.stack import explode_cells
from cellweave.sources.rasters import ROW, _decode

#: Schema that Spark's binaryFile format has.
FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_stack(spark: SparkSession, path: str, product: str = "", band: int = 0, glob: str = "*.tif", files_at_once: int = 8) -> DataFrame:
    """A streaming stack(product, year, cell, value); each file is read once, a bounded number in a batch."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).load(path)
    return explode_cells(files.select("path", "content").mapInArrow(lambda b: _decode(b, [band]), ROW), product)


def running_summary(stream: DataFrame) -> DataFrame:
    """(cell, n, mean, stddev) so far; state is one row for each cell of the grid, however many years come."""
    return stream.groupBy("cell").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"))
