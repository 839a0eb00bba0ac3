"""Raster directories as tables, from any file system that Spark reads, and a `geotiff` data source for mounted folders."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cellweave.sources.tiff import Raster, decode, encode, header

ROW = "path string, year int, band int, cols int, rows int, xmin double, ymin double, xmax double, ymax double, epsg int, cell_type string, first long, cells array<double>"
PROFILE = "path string, year int, band int, cols int, rows int, xmin double, ymin double, xmax double, ymax double, epsg int, cell_type string"
#: Cells that one row holds; a larger image has several, each with the place of its first cell.
BLOCK_CELLS = 1 << 20
YEAR = r"(\d{4})(?!.*\d{4})[^/]*$"


def list_files(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """Files in the order of their paths: path, year_idx (rank from 0) and year (the last four digits of the name, else null).

    Only names are read.  A directory has few files, one a year, so the rank may be taken in one place.
    """
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")
    year = F.regexp_extract("path", YEAR, 1)
    return files.select("path", "length", (F.row_number().over(Window.orderBy("path")) - 1).alias("year_idx"), F.when(year != "", year.cast("int")).alias("year"))


def _decode(batches: Iterator[pa.RecordBatch], bands: list[int] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield from _rows(path, decode(blob.as_py()), bands)


_SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[t]) for n, t in (x.split() for x in ROW.split(", "))])


def _year(path: str) -> int | None:
    found = re.search(YEAR, path)
    return int(found[1]) if found else None


def _rows(path: str, r: Raster, bands: list[int] | None) -> Iterator[pa.RecordBatch]:
    """A batch of one row for each block of each band."""
    for band in range(len(r.cells)) if bands is None else bands:
        cells = r.doubles(band)
        for first in range(0, max(len(cells), 1), BLOCK_CELLS):
            part = cells[first : first + BLOCK_CELLS]
            whole = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
            about = [path, _year(path), band, r.cols, r.rows, r.xmin, r.ymin, r.xmax, r.ymax, r.epsg, r.cells.dtype.name, first]
            yield pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(about, _SCHEMA, strict=False)), whole], schema=_SCHEMA)


def read_rasters(spark: SparkSession, path: str, band: int | list[int] | None = 0, years: tuple[int, int] | None = None, glob: str = "*.tif") -> DataFrame:
    """A row for each block of a file's band.  Years (both ends in) are chosen by file name, so other files are never decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    if years:
        files = files.where(F.regexp_extract("path", YEAR, 1).between(f"{years[0]:04d}", f"{years[1]:04d}"))
    return decoded(files, band)


def decoded(files: DataFrame, band: int | list[int] | None = 0) -> DataFrame:
    """The cells of files (path, content) that were found otherwise, by lookup() for example."""
    bands = [band] if isinstance(band, int) else band
    return files.select("path", "content").mapInArrow(lambda b: _decode(b, bands), ROW)


def profile(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """Metadata of every file and band.  Cells are neither unpacked nor passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([f for f in _SCHEMA if f.name not in ("first", "cells")])
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = header(blob.as_py())
                rows = [dict(zip(kinds.names, (name, _year(name), band, h.cols, h.rows, *h.box, h.epsg, h.dtype.name), strict=True)) for band in range(h.bands)]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, PROFILE)


def grid_of(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """One row: columns, rows and extent of the first file, by path.  Only names are listed, and only that file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    first = files.agg(F.min("path")).first()[0]
    return profile(spark, first).where("band = 0").select("cols", "rows", "xmin", "ymin", "xmax", "ymax", "epsg", "cell_type")


def load_mask(spark: SparkSession, path: str, band: int = 0, glob: str = "*.tif") -> DataFrame:
    """(cell, m) of a mask file: its values as they are, NaN and no-data as null."""
    cells = read_rasters(spark, path, band, glob=glob).select("first", F.posexplode("cells").alias("pos", "m"))
    return cells.select((F.col("first") + F.col("pos")).alias("cell"), F.when(~F.isnan("m"), F.col("m")).alias("m"))


def save_grid(grid: DataFrame, path: str) -> None:
    """Metadata of a grid as a table of one row, by name, beside what was computed on it."""
    grid.coalesce(1).write.mode("overwrite").json(path)


def load_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cols int, rows int, xmin double, ymin double, xmax double, ymax double, epsg int, cell_type string").json(path)


def lookup(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One file (path, content), by name; others are not opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", name).load(path).select("path", "content")


def encoded(cells, values, grid, deflate: bool = True) -> bytes:
    """A raster of doubles from places (an array) and values (an array for each band); cells without a value are NaN."""
    import numpy as np

    image = np.full((len(values), grid.rows * grid.cols), np.nan)
    for band, v in zip(image, values, strict=True):
        band[cells] = v
    return encode(Raster(image.reshape(-1, grid.rows, grid.cols), grid.xmin, grid.ymin, grid.xmax, grid.ymax, grid.epsg, float("nan")), deflate)


def write_raster(cells: DataFrame, grid, path: str, value: str | list[str] = "value", deflate: bool = True) -> None:
    """Write (cell, value) as one raster of doubles, a band for each value column; null and cells that have no row become NaN.

    An image is one file by nature, so its cells come to the driver, as flat columns.  paint.write_each() makes many images on the executors.
    """
    names = [value] if isinstance(value, str) else value
    rows = cells.select("cell", *(F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(names))).toArrow()
    columns = [c.to_numpy(zero_copy_only=False) for c in rows.columns]
    save_bytes(cells.sparkSession, path, encoded(columns[0], columns[1:], grid, deflate))


def save_bytes(spark: SparkSession, path: str, blob: bytes) -> None:
    """To any file system of Spark's: under a temporary name first, then renamed."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(part, True)
    stream.write(blob)
    stream.close()
    fs.delete(target, False)
    fs.rename(part, target)


def created(spark: SparkSession, path: str):
    """A new file of any file system of Spark's, as a stream of the JVM with write(bytes) and close()."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.band = options, options.get("band")
        self.years = [int(x) for x in options.get("years", "").split("-")] if options.get("years") else None

    def partitions(self) -> list[_File]:
        top = self.options["path"]
        names = sorted(n for n in os.listdir(top) if fnmatch(n, self.options.get("glob", "*.tif"))) if os.path.isdir(top) else [""]
        files = [os.path.join(top, n) if n else top for n in names]
        if self.years:
            files = [f for f in files if (m := re.search(YEAR, f)) and self.years[0] <= int(m[1]) <= self.years[1]]
        return [_File(f) for f in files]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            r = decode(f.read())
        yield from _rows(partition.path, r, None if self.band is None else [int(self.band)])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Images under temporary names first; the driver renames them when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.top, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> _Written:
        import numpy as np

        os.makedirs(self.top, exist_ok=True)
        images: dict[str, tuple] = {}
        for row in rows:
            if row.path is None:
                raise ValueError("a raster without a path has no name to be written under")
            image = images.setdefault(os.path.basename(row.path), (row, np.full(row.rows * row.cols, np.nan), []))
            image[1][row.first : row.first + len(row.cells)] = [np.nan if v is None else v for v in row.cells]
            image[2].append(len(row.cells))
        out = []
        for name, (row, cells, sizes) in images.items():
            if sum(sizes) != len(cells):
                raise ValueError(f"not all of {name} is in one partition, or it has several bands; repartition by path and choose a band")
            blob = encode(Raster(cells.reshape(1, row.rows, row.cols), row.xmin, row.ymin, row.xmax, row.ymax, row.epsg, float("nan")))
            part = os.path.join(self.top, f".{uuid.uuid4().hex}.part")
            with open(part, "wb") as f:
                f.write(blob)
            out.append((part, os.path.join(self.top, name)))
        return _Written(out)

    def commit(self, messages: list) -> None:
        files = [x for m in messages if m for x in m.files]
        kept = {target for _, target in files}
        if self.overwrite and os.path.isdir(self.top):
            for name in os.listdir(self.top):
                if name.endswith(".tif") and os.path.join(self.top, name) not in kept:
                    os.remove(os.path.join(self.top, name))
        for part, target in files:
            os.replace(part, target)

    def abort(self, messages: list) -> None:
        for part in (x for m in messages if m for x, _ in m.files):
            if os.path.exists(part):
                os.remove(part)


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff"), for folders that every machine mounts under one path: one partition a file; the options band, years
    (`1989-2014`) and glob choose what is decoded.  read_rasters() and paint.write_each() reach any file system of Spark's.

    Filters are not pushed: a frame keeps its reader, so what one query pushed would hold for the next.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiffSource)
