"""Linear algebra on tall matrices: rows (cell, features) with as many features as years.

Everything of the size of the cells stays distributed; only matrices of years by years or modes reach the driver.  The product of
two stacks, cells by cells, is never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.plans.store import Scratch

#: Entries of a product that one task makes, and numbers that are broadcast at once.
ENTRIES = 1 << 22
PIECE = 1 << 21
#: Cells of a piece, where about PIECES of them hold all: a multiple of eight, so that the keys come again at whole bytes, and soon enough for a compressor.
CELLS = 1 << 10
PIECES = 32
#: Partitions whose triangular factors are joined in the first step.
TEAM = 64


def _block(batch: pa.RecordBatch, column: int) -> np.ndarray:
    x = batch.column(column)
    return np.asarray(x.flatten(), np.float64).reshape(len(x), -1)


def _factors(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    r = None
    for x in blocks:
        if len(x):
            r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
    return r


def _rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _emit(team: int, r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), team, np.int32)), _rows(r)], names=["team", "features"])


def triangular(matrix: DataFrame, features: str = "features") -> np.ndarray:
    """R of the thin QR decomposition, up to the signs of its rows, by a tree of local decompositions."""
    from pyspark import TaskContext

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(TaskContext.get().partitionId() // TEAM, _factors(_block(b, 0) for b in batches))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(0, _factors(_block(b, 1) for b in batches))

    local = matrix.select(F.col(features).alias("features")).mapInArrow(first, "team int, features array<double>")
    rows = local.repartition("team").mapInArrow(second, "team int, features array<double>").select("features").collect()
    if not rows:
        raise ValueError("the matrix has no rows")
    r = np.linalg.qr(np.array([x[0] for x in rows]), mode="r")
    return np.vstack([r, np.zeros((max(0, r.shape[1] - len(r)), r.shape[1]))])[: r.shape[1]]


def times(matrix: DataFrame, small: np.ndarray, key: str = "cell", features: str = "features", out: str = "features") -> DataFrame:
    """Rows times a small matrix."""
    box = matrix.sparkSession.sparkContext.broadcast(np.asarray(small, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _rows(_block(b, 1) @ box.value)], names=[key, out])

    kind = dict(matrix.dtypes)[key]
    return matrix.select(key, features).mapInArrow(run, f"{key} {kind}, {out} array<double>")


def cross(a: DataFrame, b: DataFrame, key: str = "cell") -> np.ndarray:
    """Transposed a times b, years by years: one join on the key, sums within each task, then over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in batches:
            part = _block(x, 0).T @ _block(x, 1) if x.num_rows else None
            total = part if total is None else total if part is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    met = a.select(key, F.col("features").alias("x")).join(b.select(key, F.col("features").alias("y")), key).select("x", "y")
    rows = met.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not rows:
        raise ValueError("the matrices share no rows")
    out = np.zeros((max(r.i for r in rows) + 1, max(r.j for r in rows) + 1))
    for r in rows:
        out[r.i, r.j] = r.v
    return out


@dataclass
class Modes:
    """Singular modes: u and v as (cell, features) with an entry for each mode, s on the driver."""

    u: DataFrame
    s: np.ndarray
    v: DataFrame

    def truncated(self, p: int) -> Modes:
        """The first p modes."""
        cut = lambda df: df.select("cell", F.slice("features", 1, p).alias("features"))
        return Modes(cut(self.u), self.s[:p], cut(self.v))

    def values(self) -> DataFrame:
        """(mode, value)"""
        return self.u.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(self.s)], "mode int, value double")

    @staticmethod
    def by_mode(vectors: DataFrame) -> DataFrame:
        """(mode, cell, value)"""
        return vectors.select("cell", F.posexplode("features").alias("mode", "value")).select("mode", "cell", "value")


@dataclass
class Reduced:
    """What a tall matrix contributes to a product: its triangular factor, of rank k at most, and the map from its rows to an orthonormal base."""

    matrix: DataFrame
    factor: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, matrix: DataFrame, k: int | None = None) -> Reduced:
        """Best approximation of rank k, taken on the small factor alone: no pass over the rows besides that of the factor."""
        r = triangular(matrix)
        left, s, right = np.linalg.svd(r)
        s = np.where(s > _tiny(s), s, 0)[:k]
        n = len(s)
        inverse = np.divide(1, s, out=np.zeros(n), where=s > 0)
        return cls(matrix, s[:, None] * right[:n], right[:n].T * inverse)

    def back(self, small: np.ndarray) -> DataFrame:
        """Vectors over the rows, from coefficients in the base."""
        return times(self.matrix, self.base @ small)


def _tiny(s: np.ndarray) -> float:
    """Singular values up to this are zero but for rounding."""
    return float(s.max(initial=0)) * len(s) * np.finfo(float).eps * 16


def product_svd(a: DataFrame, b: DataFrame, p: int | None = None, q: int | None = None) -> Modes:
    """Singular modes of a times transposed b, or of their best approximations of rank p and q.

    One QR decomposition of each, cut to its rank, and an SVD of the product of the two small factors; the vectors are brought back in one
    pass over the rows.  Years may depend on each other, and modes whose singular value is zero but for rounding are left out.
    """
    left, right = Reduced.of(a, p), Reduced.of(b, q)
    u, s, vt = np.linalg.svd(left.factor @ right.factor.T, full_matrices=False)
    n = int((s > _tiny(s)).sum())
    return Modes(left.back(u[:, :n]), s[:n], right.back(vt[:n].T))


def svd(a: DataFrame, p: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Thin SVD of one tall matrix, its first p modes: (u, s, vt), vt on the driver."""
    _, s, vt = np.linalg.svd(triangular(a))
    n = min(int((s > _tiny(s)).sum()), len(s) if p is None else p)
    return times(a, vt[:n].T / s[:n]), s[:n], vt[:n]


def low_rank(a: DataFrame, p: int) -> DataFrame:
    """The best approximation of rank p: rows times the projection on the first p right singular vectors."""
    _, _, vt = np.linalg.svd(triangular(a))
    return times(a, vt[:p].T @ vt[:p])


def column_means(a: DataFrame) -> np.ndarray:
    rows = a.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.i] = r.v
    return out


def centre_columns(a: DataFrame) -> DataFrame:
    """Each year less its mean over the cells."""
    means = F.array(*[F.lit(float(x)) for x in column_means(a)])
    return a.select("cell", F.zip_with("features", means, lambda x, m: x - m).alias("features"))


def prepared(a: DataFrame, mode: int) -> DataFrame:
    """What enters a product: 0 the values, 1 each row less its mean over the years.  2, standardised rows, has no agreed formula and is refused."""
    if mode == 0:
        return a
    if mode == 1:
        mean = F.aggregate("features", F.lit(0.0), lambda t, x: t + x) / F.size("features")
        return a.select("cell", F.transform("features", lambda x: x - mean).alias("features"))
    raise ValueError(f"matrix mode {mode} is not defined; 0 and 1 are")


def normalise_rows(a: DataFrame) -> DataFrame:
    """Each row over its Euclidean length; rows of zeros stay."""
    length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda t, x: t + x * x))
    return a.select("cell", F.when(length > 0, F.transform("features", lambda x: x / length)).otherwise(F.col("features")).alias("features"))


def analysis(a: DataFrame, b: DataFrame, prepare: Callable[[DataFrame], DataFrame], p: int | None = None, q: int | None = None, r: int | None = None) -> Modes:
    """The first r modes of the product of two stacks after the same preparation, with ranks p and q."""
    out = product_svd(prepare(a), prepare(b), p, q)
    return out if r is None else out.truncated(r)


def mca(a: DataFrame, b: DataFrame, p: int | None = None, q: int | None = None, r: int | None = None) -> Modes:
    """Maximum covariance analysis: years less their means over the cells; ranks are cut after that."""
    return analysis(a, b, centre_columns, p, q, r)


def cca(a: DataFrame, b: DataFrame, p: int | None = None, q: int | None = None, r: int | None = None) -> Modes:
    """Canonical correlation: rows of unit length.  Ranks are cut before that, for cutting changes the lengths."""
    ranks = iter((p, q))
    shorten = lambda x: x if (k := next(ranks)) is None else low_rank(x, k)
    return analysis(a, b, lambda x: normalise_rows(shorten(x)), r=r)


def gcca(*matrices: DataFrame, q: int | None = None, centre: bool = True, normalise: bool = True) -> tuple[np.ndarray, list[DataFrame]]:
    """Generalised analysis of several stacks.

    With S_j the triangular factors, the symmetric block matrix of S_j S_k^T (zero where j = k) is decomposed; its leading eigenvectors, a part for
    each stack, of unit length, are brought back to that stack's cells.  Two stacks give the modes of their product.
    """
    done = [normalise_rows(m) if normalise else m for m in (centre_columns(x) if centre else x for x in matrices)]
    factors = [triangular(m) for m in done]
    t = len(factors[0])
    k = np.block([[np.zeros((t, t)) if i == j else a @ b.T for j, b in enumerate(factors)] for i, a in enumerate(factors)])
    values, vectors = np.linalg.eigh(k)
    order = np.argsort(-values)[: t if q is None else min(q, t)]
    order = order[values[order] > max(values.max(), 0) * len(k) * np.finfo(float).eps]
    out = []
    for j, (m, f) in enumerate(zip(done, factors, strict=True)):
        part = vectors[j * t : (j + 1) * t, order]
        out.append(times(m, np.linalg.pinv(f) @ (part / np.maximum(np.linalg.norm(part, axis=0), 1e-300))))
    return values[order], out


def randomised_product(a: DataFrame, b: DataFrame, modes: int, extra: int = 8, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """Leading singular values of a times transposed b from a Gaussian sketch of the years."""
    ga, gb = triangular(a), triangular(b)
    c = ga @ gb.T
    y = c @ np.random.default_rng(seed).standard_normal((c.shape[1], min(modes + extra, c.shape[1])))
    for _ in range(rounds):
        y = c @ (c.T @ np.linalg.qr(y)[0])
    q, _ = np.linalg.qr(y)
    return np.linalg.svd(q.T @ c, compute_uv=False)[:modes]


def expanded(m: Modes) -> DataFrame:
    """(i, j, v): the product that the modes stand for, cells by cells: a row for each pair of cells, made where it is returned.

    Each row of u meets all rows of v, and its entries are sums over the modes in that place, so nothing of the size of the product is shuffled, sorted
    or kept.  Rows of u are dealt so that a task makes about ENTRIES; v is sent whole to each executor, in pieces of about PIECE numbers at most.

    The result outweighs all else, so both sides are ordered by their vectors before they meet: cells alike stand side by side, their entries are runs of
    equal values, and each row of u repeats the keys of a piece.  Columnar files keep such runs in a small part of the bytes that other orders take.
    """
    spark, n = m.u.sparkSession, len(m.s)
    column = lambda df, name, side, s: df.select(F.col("cell").alias(name), *[(F.element_at("features", k + 1) * float(s[k])).alias(f"{side}{k}") for k in range(n)])
    tmp = Scratch(spark)
    left, right = tmp.keep(column(m.u, "i", "l", m.s), "left"), tmp.keep(column(m.v, "j", "r", np.ones(n)), "right")
    rows, cols = left.count(), right.count()
    size = max(CELLS, -(-cols // (8 * PIECES)) * 8)

    def alike(df: DataFrame, parts: int) -> DataFrame:
        order = [*df.columns[1:], df.columns[0]]
        return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    left = alike(left, max(1, min(rows, -(-rows * min(size, cols) // ENTRIES))))
    place = F.monotonically_increasing_id()
    right = tmp.keep(alike(right, max(1, -(-cols * (n + 1) // PIECE))).withColumns({"part": F.shiftright(place, 33), "at": place.bitwiseAND((1 << 33) - 1)}), "ordered")
    parts = right.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    pieces = [right.where((F.col("part") == p.part) & (F.col("at") >= k) & (F.col("at") < k + size)) for p in parts for k in range(0, p.n, size)]
    v = F.lit(0.0)
    for k in range(n):
        v = v + F.col(f"l{k}") * F.col(f"r{k}")
    out = None
    for part in pieces or [right]:
        made = left.crossJoin(F.broadcast(part)).select("i", "j", v.alias("v"))
        out = made if out is None else out.unionByName(made)
    return out


def applied(a: DataFrame, b: DataFrame, v: DataFrame) -> DataFrame:
    """a (b^T v) for vectors v over b's cells, without forming the product."""
    return times(a, cross(b, v))


def residuals(a: DataFrame, b: DataFrame, m: Modes) -> np.ndarray:
    """For each mode the larger of the norms of u - A B^T v / s and v - B A^T u / s."""
    out = []
    for x, y, own, other in ((a, b, m.u, m.v), (b, a, m.v, m.u)):
        back = applied(x, y, other)
        met = own.join(back.withColumnRenamed("features", "back"), "cell").select(F.posexplode(F.arrays_zip("features", "back")).alias("mode", "z"))
        s = F.element_at(F.array(*[F.lit(float(k)) for k in m.s]), F.col("mode") + 1)
        norms = met.groupBy("mode").agg(F.sqrt(F.sum((F.col("z.features") - F.col("z.back") / s) ** 2)).alias("n")).collect()
        out.append(np.array([r.n for r in sorted(norms, key=lambda r: r.mode)]))
    return np.maximum(*out)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v): product of two long matrices (i, t, v) and (t, j, v), as a join on t and a sum."""
    return a.select("i", "t", F.col("v").alias("x")).join(b.select("t", "j", F.col("v").alias("y")), "t").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def transpose(long: DataFrame) -> DataFrame:
    """(i, j, v) with rows and columns exchanged."""
    return long.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def beside(blocks: list[DataFrame], width: int, below: bool = False) -> DataFrame:
    """Blocks (i, j, v) side by side, or one below the other, each `width` wide (high)."""
    out = None
    for k, x in enumerate(blocks):
        x = x.select((F.col("i") + k * width * below).alias("i"), (F.col("j") + k * width * (not below)).alias("j"), "v")
        out = x if out is None else out.unionByName(x)
    return out


def reshaped(flat: DataFrame, cols: int) -> DataFrame:
    """(i, j, v) of values (pos, v) laid out row by row."""
    return flat.select(F.floor(F.col("pos") / cols).alias("i"), (F.col("pos") % cols).alias("j"), "v")
