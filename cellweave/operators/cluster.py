"""Clustering of cells, pairs and matrices."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.plans.store import Scratch

#: Models trained at the same time, so that the small jobs of one fill the gaps of another.
AT_ONCE = 4


def k_values(low: int, high: int, step: int) -> list[int]:
    """A sweep: with low above high only high is tried; a step below 1 counts as 1."""
    if low > high:
        low, step = high, 1
    return list(range(low, high + 1, max(step, 1)))


def vectors(matrix: DataFrame, features: str = "features") -> DataFrame:
    return matrix.withColumn(features, array_to_vector(features))


def pair_features(pairs: DataFrame) -> DataFrame:
    """(year, cell, features) of (cell, year, a, b)."""
    return pairs.select("year", "cell", F.array("a", "b").alias("features"))


def train(matrix: DataFrame, k: int, iterations: int, seed: int = 1) -> tuple[KMeansModel, float]:
    """A model and its cost, the within-set sum of squared errors."""
    model = KMeans(k=k, maxIter=iterations, seed=seed, initMode="k-means||").fit(matrix)
    return model, float(model.summary.trainingCost)


def sweep(matrix: DataFrame, ks: list[int], iterations: int, path: str | None = None, seed: int = 1) -> DataFrame:
    """(k, iterations, wssse) for each k.  Models are saved under path/k; the matrix is kept in memory or on disk meanwhile."""
    from pyspark import StorageLevel

    data = vectors(matrix).persist(StorageLevel.MEMORY_AND_DISK)

    def one(k: int) -> tuple[int, int, float]:
        model, cost = train(data, k, iterations, seed)
        if path:
            model.write().overwrite().save(f"{path}/{k}")
        return k, iterations, cost

    try:
        data.count()  # fill the cache once, before several models are trained at a time
        with ThreadPoolExecutor(AT_ONCE) as pool:
            rows = list(pool.map(one, ks))
    finally:
        data.unpersist()
    return matrix.sparkSession.createDataFrame(rows, "k int, iterations int, wssse double")


def load(path: str) -> KMeansModel:
    return KMeansModel.load(path)


def predict(model: KMeansModel, matrix: DataFrame, *keys: str, coordinate: int | None = 0) -> DataFrame:
    """Cluster of each row, and the value to paint: a coordinate of its centre, or (None) the cluster itself."""
    out = model.transform(vectors(matrix)).select(*(keys or ("cell",)), F.col("prediction").alias("cluster"))
    if coordinate is None:
        return out.withColumn("value", F.col("cluster").cast("double"))
    centres = F.array(*[F.lit(float(c[coordinate])) for c in model.clusterCenters()])
    return out.withColumn("value", F.element_at(centres, F.col("cluster") + 1))


def nearest(matrix: DataFrame, centres: list[list[float]], features: str = "features") -> DataFrame:
    """(..., cluster, d2): the nearest of given centres, the lowest on ties.

    One product of each batch with the broadcast centres (as many numbers as clusters times years), whatever their number; nothing is shuffled.
    The squared distance of the chosen centre is taken from the differences.
    """
    c = np.asarray(centres, np.float64)
    box, at = matrix.sparkSession.sparkContext.broadcast(c), matrix.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = box.value
        for batch in batches:
            x = np.asarray(batch.column(at).flatten(), np.float64).reshape(len(batch), c.shape[1])
            far = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
            least = far.min(axis=1, keepdims=True, initial=np.inf)
            best = (far <= least + 1e-12 * (1 + (x * x).sum(axis=1)[:, None])).argmax(axis=1)
            d2 = ((x - c[best]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(d2)], names=[*batch.schema.names, "cluster", "d2"])

    schema = T.StructType([*matrix.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("d2", T.DoubleType())])
    return matrix.mapInArrow(run, schema)


def cost(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d2").alias("wssse"))


class CoClusters:
    """Block-average co-clustering of a long matrix (i, j, z[, w]) into k row and l column clusters.

    Each half-step is one pass over the matrix: the sums of w, w z and w z^2 for every row and column cluster (or the other way round).  They are kept as
    a table and are enough for the block means before and after the rows move, and for the distances to all prototypes.  Block means are k by l
    numbers and come to the driver.
    distance: euclidean or divergence (I-divergence).
    """

    def __init__(self, k: int, l: int, distance: str = "euclidean", tolerance: float = 1e-6, iterations: int = 100, runs: int = 5, epsilon: float = 1e-8, best_of_runs: bool = False, seed: int = 1, start: str = "hash"):  # noqa: E741
        kinds = [d for d in ("euclidean", "divergence") if d.startswith(distance.lower())]
        if not kinds:
            raise ValueError(f"unknown distance {distance}")
        self.k, self.l, self.divergence = k, l, kinds[0] == "divergence"
        self.tolerance, self.iterations, self.runs, self.epsilon, self.best_of_runs, self.seed, self.start = tolerance, iterations, runs, epsilon, best_of_runs, seed, start

    def _first(self, ids: DataFrame, key: str, n: int, run: int) -> DataFrame:
        at = F.col(key) % n if self.start == "mod" else F.pmod(F.xxhash64(F.col(key), F.lit(self.seed), F.lit(run), F.lit(key)), F.lit(n))
        return ids.select(key, at.cast("int").alias("c"))

    def sums(self, z: DataFrame, key: str, other: str, others: DataFrame) -> DataFrame:
        """(key, oc, sw, sz, szz): sums of each row over each cluster of columns, or the other way round."""
        met = z.join(others.withColumnRenamed("c", "oc"), other)
        return met.groupBy(key, "oc").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("z")).alias("sz"), F.sum(F.col("w") * F.col("z") * F.col("z")).alias("szz"))

    def means(self, sums: DataFrame, key: str, mine: DataFrame, grand: float) -> list[list[float]]:
        """Block means (sum of w z + mean(Z) epsilon) / (sum of w + epsilon), a list for each cluster of the key's side."""
        met = sums.join(mine, key).groupBy("c", "oc").agg(F.sum("sz").alias("sz"), F.sum("sw").alias("sw"))
        found = {(r.c, r.oc): (r.sz, r.sw) for r in met.collect()}
        at = lambda a, b: found.get((a, b), (0.0, 0.0))
        n, m = (self.k, self.l) if key == "i" else (self.l, self.k)
        return [[(at(a, b)[0] + grand * self.epsilon) / (at(a, b)[1] + self.epsilon) for b in range(m)] for a in range(n)]

    def assign(self, sums: DataFrame, key: str, prototypes: list[list[float]]) -> DataFrame:
        """(key, c, d): nearest prototype of each row (or column), the lowest on ties; prototypes: one list for each, over the other side's clusters."""

        def far(p: list[float]) -> Column:
            m = F.element_at(F.array(*[F.lit(float(x)) for x in p]), F.col("oc") + 1)
            if self.divergence:
                return F.col("sw") * (m + self.epsilon) - F.col("sz") * F.ln(m + self.epsilon)
            return F.col("szz") - 2 * m * F.col("sz") + m * m * F.col("sw")

        each = sums.groupBy(key).agg(*[F.sum(far(p)).alias(f"d{c}") for c, p in enumerate(prototypes)])
        best = F.array_min(F.array(*[F.struct(F.col(f"d{c}").alias("d"), F.lit(c).alias("c")) for c in range(len(prototypes))]))
        return each.select(key, best.alias("b")).select(key, F.col("b.c").alias("c"), F.col("b.d").alias("d"))

    def steps(self, z: DataFrame, rows: DataFrame, cols: DataFrame, grand: float, tmp: Scratch) -> Iterator[tuple[DataFrame, DataFrame, float]]:
        while True:
            by_row = tmp.table(self.sums(z, "i", "j", cols), "by-row")
            rows = tmp.table(self.assign(by_row, "i", self.means(by_row, "i", rows, grand)).select("i", "c"), "rows")
            m = self.means(by_row, "i", rows, grand)
            by_col = self.sums(z, "j", "i", rows)
            done = tmp.table(self.assign(by_col, "j", [list(x) for x in zip(*m, strict=True)]), "cols")
            error = done.agg(F.sum(F.pow("d", F.lit(1.0 if self.divergence else 2.0)))).first()[0]
            cols = done.select("j", "c")
            yield rows, cols, error

    def fit(self, z: DataFrame) -> tuple[DataFrame, DataFrame, str]:
        """Row clusters (i, c), column clusters (j, c) and a status.

        As it stands, the first run to change its error by less than the tolerance is returned at once, its error carried over from the
        run before; best_of_runs compares all runs instead.
        """
        z = z.select("i", "j", F.col("z").cast("double").alias("z"), (F.col("w") if "w" in z.columns else F.lit(1.0)).cast("double").alias("w"))
        with Scratch(z.sparkSession) as tmp:
            z = tmp.table(z, "matrix")
            grand = z.agg(F.avg(F.col("w") * F.col("z"))).first()[0] or 0.0
            best, now, status = None, float("inf"), f"reached maximum of {self.iterations} iterations"
            for run in range(self.runs):
                if self.best_of_runs:
                    now = float("inf")
                state = self._first(z.select("i").distinct(), "i", self.k, run), self._first(z.select("j").distinct(), "j", self.l, run)
                for step, (rows, cols, error) in zip(range(1, self.iterations + 1), self.steps(z, *state, grand, tmp), strict=False):
                    close = abs(error - now) < self.tolerance
                    now = error
                    if close and not self.best_of_runs:
                        return tmp.keep(rows), tmp.keep(cols), f"converged in {step} iterations"
                    if close:
                        status = f"converged in {step} iterations"
                        break
                if best is None or now < best[2]:
                    best = rows, cols, now
            return tmp.keep(best[0]), tmp.keep(best[1]), status
