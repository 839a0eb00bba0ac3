"""Text sources and sinks: numeric lines, matrices, modes, elbow tables, settings files, external programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.rasters import created

#: Cells of a vector that one piece of a line holds.
BLOCK = 65_536


def read_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole)


def parse_numbers(line: Column) -> Column:
    """`1.5,2` -> [1.5, 2.0]; a field that is no number is null."""
    return F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast("double"))


def number_line(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",", "NaN")


def write_rows(matrix: DataFrame, path: str, values: str = "values", order: str | None = None) -> None:
    """Rows of numbers as comma-separated lines, sorted over all files if an order is given."""
    (matrix.orderBy(order) if order else matrix).select(number_line(F.col(values)).alias("value")).write.mode("overwrite").text(path)


def diagonal(values: DataFrame, mode: str = "mode", value: str = "value") -> DataFrame:
    """(mode, values): the full diagonal matrix of a table (mode, value); as many rows as modes, so few."""
    n = values.agg((F.max(mode) + 1).alias("n"))
    wide = values.crossJoin(F.broadcast(n))
    return wide.select(mode, F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda j: F.when(j == F.col(mode), F.col(value)).otherwise(F.lit(0.0))).alias("values"))


def mode_blocks(u: DataFrame, s: DataFrame, v: DataFrame) -> DataFrame:
    """(mode, line_no, block, piece): for each mode its left vector (line 0), singular value (1) and right vector (2), in pieces of BLOCK cells.

    u and v: (mode, cell, value), s: (mode, value).  No task holds more than a piece of a vector.
    """

    def line(df: DataFrame, k: int) -> DataFrame:
        sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda x: x["value"])
        return df.groupBy("mode", F.floor(F.col("cell") / BLOCK).alias("block")).agg(number_line(sorted_).alias("piece")).select("mode", F.lit(k).alias("line_no"), "block", "piece")

    middle = s.select("mode", F.lit(1).alias("line_no"), F.lit(0).cast("long").alias("block"), F.col("value").cast("string").alias("piece"))
    return line(u, 0).unionByName(middle).unionByName(line(v, 2))


def mode_lines(u: DataFrame, s: DataFrame, v: DataFrame) -> DataFrame:
    """(mode, line_no, line): the pieces of mode_blocks() joined, for vectors that fit in a string."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"])
    return mode_blocks(u, s, v).groupBy("mode", "line_no").agg(F.array_join(pieces, ",").alias("line"))


def write_modes(blocks: DataFrame, path: str) -> None:
    """One directory with one file of three lines for each mode, from mode_blocks(): sorted by Spark, appended by the driver piece by piece."""
    spark, at, out = blocks.sparkSession, None, None
    for mode, line_no, _, piece in blocks.orderBy("mode", "line_no", "block").select("mode", "line_no", "block", "piece").toLocalIterator():
        if at is None or at[0] != mode:
            if out:
                out.write(b"\n")
                out.close()
            out = created(spark, f"{path}/mode={mode}.txt")
        elif at[1] != line_no:
            out.write(b"\n")
        else:
            out.write(b",")
        out.write(piece.encode())
        at = mode, line_no
    if out:
        out.write(b"\n")
        out.close()


def write_transposed(vectors: DataFrame, path: str) -> None:
    """Vectors (mode, cell, value) as comma-separated lines, one for each cell over the modes, sorted by cell."""
    modes = sorted(r[0] for r in vectors.select("mode").distinct().collect())
    wide = vectors.groupBy("cell").pivot("mode", modes).agg(F.first("value"))
    write_rows(wide.select("cell", F.array(*[F.col(str(m)) for m in modes]).alias("values")), path, "values", "cell")


def write_elbow(table: DataFrame, path: str) -> None:
    """(k, iterations, wssse) as one sorted CSV file without a header."""
    table.coalesce(1).sortWithinPartitions("k").write.mode("overwrite").csv(path, header=False)


def read_elbow(spark: SparkSession, path: str) -> DataFrame:
    """Columns _c0 (k), _c1 (iterations) and _c2 (cost); lines that do not fit are dropped."""
    return spark.read.csv(path, schema="_c0 int, _c1 int, _c2 double", mode="DROPMALFORMED")


def replace_line(lines: DataFrame, pos: Column | str, at: int, new: str, value: str = "value") -> DataFrame:
    """A positional settings file (a column with each line's place) with one line replaced."""
    return lines.withColumn(value, F.when(F.col(pos) == at if isinstance(pos, str) else pos == at, F.lit(new)).otherwise(F.col(value)))


def through_program(lines: DataFrame, command: str, file: str | None = None, value: str = "value") -> DataFrame:
    """Send each partition's lines through an external program on the executors; `file` is shipped to them first."""
    spark = lines.sparkSession
    if file:
        spark.sparkContext.addFile(file)
    piped = lines.select(value).rdd.map(lambda r: r[0]).pipe(command, checkCode=True)
    return piped.map(lambda x: (x,)).toDF("value string")
