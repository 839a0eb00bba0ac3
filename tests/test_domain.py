import itertools
import json
import math
import os
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.functions import scalar
from cellweave.operators import cluster, linalg, paint, stack, stats
from cellweave.plans.store import computed
from cellweave.sources import rasters, text
from cellweave.sources.tiff import Raster, encode
from cellweave.streaming.rasters import running_summary, watch_stack

NAN = float("nan")


def as_matrix(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell long, features array<double>").repartition(3)


def back(df):
    return np.array([r.features for r in df.orderBy("cell").collect()])


def same_up_to_sign(x, y, tol=1e-9):
    return all(min(np.abs(a - b).max(), np.abs(a + b).max()) < tol for a, b in zip(np.asarray(x).T, np.asarray(y).T, strict=True))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("rasters")
    rng = np.random.default_rng(2)
    for year in range(1980, 1991):
        cells = rng.normal(size=(4, 8, 12))
        cells[:, 0, 0] = NAN
        cells[:, 1, year % 5] = NAN
        (top / f"av_{year}v4.tif").write_bytes(encode(Raster(cells, 0, 0, 12, 8, 4326, NAN)))
    (top / "note.txt").write_text("no raster")
    return str(top)


def test_reading_rasters(spark, folder):
    rasters.register(spark)
    for df in (rasters.read_rasters(spark, folder, 3), spark.read.format("geotiff").option("band", 3).load(folder)):
        rows = df.orderBy("path").collect()
        assert [r.year for r in rows] == list(range(1980, 1991)) and {(r.cols, r.rows, r.band, len(r.cells)) for r in rows} == {(12, 8, 3, 96)}
    assert rasters.read_rasters(spark, folder, None, (1982, 1984)).count() == 12
    source = spark.read.format("geotiff").load(folder)
    assert source.where("band = 1 and year = 1985").count() == 1 and source.count() == 44
    assert spark.read.format("geotiff").option("years", "1985-1986").option("band", 1).load(folder).count() == 2
    listed = rasters.list_files(spark, folder).orderBy("path").collect()
    assert [(r.year_idx, r.year) for r in listed] == list(enumerate(range(1980, 1991)))
    assert rasters.profile(spark, folder, "*1980*").count() == 4 and {(r.cols, r.rows, r.year) for r in rasters.profile(spark, folder).collect()} == {(12, 8, y) for y in range(1980, 1991)}
    assert rasters.exists(spark, folder) and not rasters.exists(spark, folder + "/none")


def test_source_writes_what_it_reads(spark, folder, tmp_path):
    rasters.register(spark)
    rasters.read_rasters(spark, folder, 0, (1980, 1981)).write.format("geotiff").mode("append").save(str(tmp_path / "out"))
    a, b = (rasters.read_rasters(spark, p, 0, (1980, 1981)).orderBy("year").collect() for p in (folder, str(tmp_path / "out")))
    assert [np.nan_to_num(r.cells, nan=-9).tolist() for r in a] == [np.nan_to_num(r.cells, nan=-9).tolist() for r in b] and b[0].epsg == 4326


def test_source_commits_blocks_and_overwrites(spark, folder, tmp_path, monkeypatch):
    rasters.register(spark)
    out = str(tmp_path / "out")
    one = rasters.read_rasters(spark, folder, 0, (1980, 1980))
    one.write.format("geotiff").mode("append").save(out)
    rasters.read_rasters(spark, folder, 0, (1981, 1981)).write.format("geotiff").mode("overwrite").save(out)
    assert sorted(os.listdir(out)) == ["av_1981v4.tif"]
    with pytest.raises(Exception, match="without a path"):
        one.withColumn("path", F.lit(None).cast("string")).write.format("geotiff").mode("append").save(out)
    assert sorted(os.listdir(out)) == ["av_1981v4.tif"]


def test_large_images_come_in_blocks():
    image = Raster(np.arange(24.0).reshape(2, 3, 4))
    rows = [r for b in rasters._rows("x/1999.tif", image, [1]) for r in b.to_pylist()]
    assert [(r["first"], len(r["cells"])) for r in rows] == [(0, 12)]
    before, rasters.BLOCK_CELLS = rasters.BLOCK_CELLS, 5
    try:
        rows = [r for b in rasters._rows("x/1999.tif", image, None) for r in b.to_pylist()]
    finally:
        rasters.BLOCK_CELLS = before
    assert [(r["band"], r["first"], r["cells"][0]) for r in rows] == [(b, f, 12.0 * b + f) for b in (0, 1) for f in (0, 5, 10)]


def test_paint_is_the_inverse_of_exploding(spark, folder, tmp_path):
    s = stack.read_stack(spark, folder, band=2, years=(1983, 1983))
    grid = rasters.grid_of(spark, folder).first()
    rasters.write_raster(s, grid, str(tmp_path / "1983.tif"))
    again = stack.read_stack(spark, str(tmp_path))
    assert sorted(map(str, s.select("cell", "value").collect())) == sorted(map(str, again.select("cell", "value").collect()))
    assert s.where("value is null").count() == 2


def test_masks(spark, folder):
    s = stack.read_stack(spark, folder, years=(1980, 1981))
    mask = spark.createDataFrame([(k, [0.0, 1.0, 2.0, NAN][k % 4]) for k in range(96)], "cell long, m double")
    assert {r.cell % 4 for r in stack.keep_masked(s, mask).collect()} == {1}
    assert {r.cell % 4 for r in stack.keep_masked(s, mask, "nonzero").collect()} == {1, 2}
    masked = stack.mask_values(s, mask)
    assert masked.count() == s.count() and {r.cell % 4 for r in masked.where("value is not null").collect()} == {1}
    once = stack.mask_values(masked, mask)
    assert sorted(map(str, once.collect())) == sorted(map(str, masked.collect()))
    pos = stack.valid_cells(stack.first_image(s), mask).orderBy("pos").collect()
    assert [(r.pos, r.cell) for r in pos] == [(k, 4 * k + 1) for k in range(24)]
    assert stack.valid_cells(stack.first_image(s)).count() == 94  # without a mask, missing cells of the first image go
    with pytest.raises(ValueError):
        stack.select_years(s, 1999, 1990)


def test_polygon_with_hole(spark):
    outer, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]
    rings = scalar.polygon_rings(json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [outer, hole]}}))
    grid = SimpleNamespace(cols=12, rows=12, xmin=-1.0, ymin=-1.0, xmax=11.0, ymax=11.0)
    cells = spark.range(144).withColumnRenamed("id", "cell")
    got = {r.cell for r in stack.mask_polygon(cells, grid, rings).where("m = 1").collect()}
    want = {r * 12 + c for r in range(12) for c in range(12) if 0 < (x := c - 0.5) < 10 and 0 < (y := 10.5 - r) < 10 and not (3 < x < 7 and 3 < y < 7)}
    assert got == want


def test_missing_years_count_as_zero_or_drop_the_cell(spark):
    s = spark.createDataFrame([(1, 2000, 5.0), (1, 2001, None), (2, 2000, NAN), (2, 2001, None), (3, 2000, 0.0), (3, 2001, 2.0)], "cell long, year int, value double")
    assert [(r.cell, r.features) for r in stack.matrix(s, [2000, 2001]).orderBy("cell").collect()] == [(1, [5.0, 0.0]), (3, [0.0, 2.0])]
    assert [r.cell for r in stack.matrix(s, [2000, 2001], strict=True).collect()] == [3]


def test_scalars(spark):
    df = spark.createDataFrame([(-1000.0,), (NAN,), (None,), (3.0,)], "v double")
    got = df.select(scalar.missing(F.col("v"), -1000).alias("m"), scalar.filled(F.col("v"), -1).alias("f"), scalar.member(F.col("v"), [3.0]).alias("c")).collect()
    assert [tuple(r) for r in got][0] == (None, -1000.0, 0.0) and got[1].f == -1.0 and got[2].f == -1.0 and got[2].c is None and (got[3].m, got[3].c) == (3.0, 1.0)
    years = spark.createDataFrame([(y,) for y in (1900, 2000, 2004, 2001)], "y int")
    assert [r[0] for r in years.select(scalar.leap_year(F.col("y"))).collect()] == [False, True, True, False]


def reference_days(a, b, years):
    """Pairs of a (one entry more, at the front) and b, negative days with the year before."""
    pairs = []
    for k, (day, year) in enumerate(zip(b, years, strict=True)):
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        pairs.append((a[k], (367 if leap else 366) - day) if day < 0 else (a[k + 1], day))
    return pairs


def test_day_correlation(spark):
    rng = np.random.default_rng(8)
    years = list(range(1989, 2001))
    a = {c: rng.normal(size=13) for c in range(5)}
    b = {c: rng.integers(-20, 60, 12).astype(float) for c in range(5)}
    b[4][:] = 11.0
    model = spark.createDataFrame([(c, y, float(v)) for c, x in a.items() for y, v in zip([1988, *years], x)], "cell long, year int, value double")
    days = spark.createDataFrame([(c, y, float(v)) for c, x in b.items() for y, v in zip(years, x)], "cell long, year int, value double")
    for r in stats.day_correlation(model, days).collect():
        pairs = np.array(reference_days(a[r.cell], b[r.cell], years))
        assert (r.n, r.neg_cnt) == (12, int((b[r.cell] < 0).sum()))
        assert r.corr is None if r.cell == 4 else abs(r["corr"] - np.corrcoef(pairs.T)[0, 1]) < 1e-12
    wrapped = stats.day_wrapped_pairs(model, days, calendar=True).where("negative").collect()
    assert all(r.b == (366 if r.year % 4 == 0 else 365) + b[r.cell][r.year - 1989] for r in wrapped)


def test_correlation_of_constant_and_single_rows_is_null(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 3.0), (1, 2, 2.0, 4.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 2.0), (3, 2, 2.0, 4.0)], "cell long, year int, a double, b double")
    got = {r.cell: r["corr"] for r in stats.correlation(df).collect()}
    assert got[1] is None and got[2] is None and abs(got[3] - 1) < 1e-12


def test_histogram_and_variance(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 9.99, 10, 11, -1)] + [(None,)], "value double")
    assert {r.bin: r.n for r in stats.histogram(df, 5, 0, 10).collect()} == {0: 2, 2: 1, 4: 2}
    v = stats.variance_explained(spark.createDataFrame([(0, 3.0), (1, 4.0)], "mode int, value double")).orderBy("mode").collect()
    assert [round(r.share, 6) for r in v] == [0.36, 0.64] and v[1].cumulative == 1.0 and v[1].cumulative_value == 7.0


SHAPES = [(9, 5, "int"), (40, 6, "normal"), (30, 5, "dependent"), (25, 4, "zero year")]


@pytest.mark.parametrize("rows,cols,kind", SHAPES)
def test_product_svd(spark, rows, cols, kind):
    rng = np.random.default_rng(rows)
    a, b = (rng.integers(0, 9, (rows, cols)).astype(float) if kind == "int" else rng.normal(size=(rows, cols)) for _ in "ab")
    if kind == "dependent":
        a[:, 3] = a[:, 0] + a[:, 1]
    if kind == "zero year":
        a[:, 1] = 0
    m = linalg.product_svd(as_matrix(spark, a), as_matrix(spark, b))
    u, s, vt = np.linalg.svd(a @ b.T)
    rank = np.linalg.matrix_rank(a @ b.T)
    assert len(m.s) == rank and np.allclose(m.s, s[:rank])
    assert np.allclose(back(m.u) @ np.diag(m.s) @ back(m.v).T, a @ b.T)
    assert same_up_to_sign(back(m.u), u[:, :rank], 1e-8) and same_up_to_sign(back(m.v), vt[:rank].T, 1e-8)
    assert np.allclose(back(m.u).T @ back(m.u), np.eye(rank))
    assert linalg.residuals(as_matrix(spark, a), as_matrix(spark, b), m).max() < 1e-8
    cut = m.truncated(2)
    assert back(cut.u).shape == (rows, 2) and len(cut.s) == 2
    ra, rb = (np.linalg.svd(x, full_matrices=False) for x in (a, b))
    low = [(x[0][:, :2] * x[1][:2]) @ x[2][:2] for x in (ra, rb)]
    ranks = linalg.product_svd(as_matrix(spark, a), as_matrix(spark, b), 2, 2)
    assert len(ranks.s) <= 2 and np.allclose(back(ranks.u) @ np.diag(ranks.s) @ back(ranks.v).T, low[0] @ low[1].T)
    assert np.allclose(linalg.randomised_product(as_matrix(spark, a), as_matrix(spark, b), 2), s[:2], rtol=1e-6)


def test_low_rank_mca_cca_gcca(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 5)) + 3, rng.normal(size=(50, 5)) - 1
    x, y = as_matrix(spark, a), as_matrix(spark, b)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    low = u[:, :2] @ np.diag(s[:2]) @ vt[:2]
    assert np.allclose(back(linalg.low_rank(x, 2)), low)
    ca, cb = a - a.mean(axis=0), b - b.mean(axis=0)
    m = linalg.mca(x, y, r=3)
    assert np.allclose(m.s, np.linalg.svd(ca @ cb.T)[1][:3]) and same_up_to_sign(back(m.u), np.linalg.svd(ca @ cb.T)[0][:, :3], 1e-8)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    c = linalg.cca(x, y, p=2, r=2)
    assert np.allclose(c.s, np.linalg.svd(unit(low) @ unit(b).T)[1][:2])
    values, parts = linalg.gcca(x, y, normalise=False)
    assert np.allclose(values, np.linalg.svd(ca @ cb.T)[1][:5]) and same_up_to_sign(back(parts[0]), np.linalg.svd(ca @ cb.T)[0][:, :5], 1e-7)
    z = rng.normal(size=(50, 5))
    values, parts = linalg.gcca(x, y, as_matrix(spark, z), q=2, centre=False, normalise=False)
    blocks = [a, b, z]
    full = np.block([[np.zeros((50, 50)) if i == j else p @ q.T for j, q in enumerate(blocks)] for i, p in enumerate(blocks)])
    want, vectors = np.linalg.eigh(full)
    assert len(parts) == 3 and np.allclose(values, want[::-1][:2])
    for k, part in enumerate(parts):
        v = vectors[50 * k : 50 * k + 50, ::-1][:, :2]
        assert same_up_to_sign(back(part), v / np.linalg.norm(v, axis=0), 1e-8)


@pytest.mark.parametrize("entries,piece", [(1 << 22, 1 << 21), (7, 11)])
def test_expanded(spark, monkeypatch, entries, piece):
    """Every pair of cells has its entry, however rows are dealt and vectors cut, and also where all entries are 0."""
    monkeypatch.setattr(linalg, "ENTRIES", entries)
    monkeypatch.setattr(linalg, "PIECE", piece)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(11, 3)), rng.normal(size=(7, 3))
    for x in (a, a * 0):
        rows = linalg.expanded(linalg.product_svd(as_matrix(spark, x), as_matrix(spark, b))).collect()
        got = np.full((11, 7), np.nan)
        for r in rows:
            got[r.i, r.j] = r.v
        assert len(rows) == 77 and np.allclose(got, x @ b.T)


def test_expanded_is_written_small(spark, tmp_path):
    """Cells alike stand side by side whatever their keys are, so that files hold their entries as runs: the n * n rows are what fills the disk."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(24, 3))[rng.integers(0, 24, 2500)], rng.normal(size=(40, 3))[rng.integers(0, 40, 2600)]
    linalg.expanded(linalg.product_svd(as_matrix(spark, a), as_matrix(spark, b))).select("i", "j", scalar.rounded(F.col("v"), 6).alias("v")).write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    got = np.full((2500, 2600), np.nan)
    rows = duckdb.sql(f"SELECT i, j, v FROM '{tmp_path}/out/*.parquet'").fetchnumpy()
    got[rows["i"], rows["j"]] = rows["v"]
    assert len(rows["v"]) == got.size and np.allclose(got, a @ b.T, atol=1e-6)
    assert sum(x.stat().st_size for x in files) < 0.5 * got.size


def test_rounded(spark):
    values = [0.0, -0.0, 0.25, -0.25, 0.049999999999999996, 1.05, -7.349, 123456.789, -1e300, 4503599627370497.0, None]
    got = [r.v for r in spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").select("k", scalar.rounded(F.col("x"), 1).alias("v")).orderBy("k").collect()]
    want = [r[0] for r in duckdb.sql("SELECT round(x, 1) + 0 FROM (SELECT unnest(?) AS x)", params=[values]).fetchall()]
    assert got == want and not np.signbit(got[1])


def by_embedding(a):
    """SVD of a small matrix from the eigenvectors of [[0, A], [A', 0]]: another route to the same modes."""
    rows = len(a)
    values, vectors = np.linalg.eigh(np.block([[np.zeros((rows, rows)), a], [a.T, np.zeros((a.shape[1],) * 2)]]))
    order = np.argsort(-values)[: min(a.shape)]
    return [x / np.linalg.norm(x, axis=0) for x in (vectors[:rows, order], vectors[rows:, order])], values[order]


def test_modes_by_another_route(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(20, 4)), rng.normal(size=(20, 4))
    (u, v), s = by_embedding(a @ b.T)
    m = linalg.product_svd(as_matrix(spark, a), as_matrix(spark, b))
    assert np.allclose(m.s, s[:4]) and same_up_to_sign(back(m.u), u[:, :4], 1e-8) and same_up_to_sign(back(m.v), v[:, :4], 1e-8)


def test_matrix_modes(spark):
    x = np.random.default_rng(3).normal(size=(6, 4))
    assert np.allclose(back(linalg.prepared(as_matrix(spark, x), 1)), x - x.mean(axis=1, keepdims=True))
    with pytest.raises(ValueError):
        linalg.prepared(as_matrix(spark, x), 2)


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 1000))
def test_matmul_and_blocks(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-3, 4, (3, 4)), rng.integers(-3, 4, (4, 2))
    la = spark.createDataFrame([(int(i), int(t), float(a[i, t])) for i, t in np.ndindex(*a.shape)], "i long, t long, v double")
    lb = spark.createDataFrame([(int(t), int(j), float(b[t, j])) for t, j in np.ndindex(*b.shape)], "t long, j long, v double")
    assert {(r.i, r.j): r.v for r in linalg.matmul(la, lb).collect()} == {(i, j): float((a @ b)[i, j]) for i, j in np.ndindex(3, 2)}
    flat = lb.select((F.col("t") * 2 + F.col("j")).alias("pos"), "v")
    assert {(r.i, r.j): r.v for r in linalg.reshaped(flat, 2).collect()} == {(i, j): float(b[i, j]) for i, j in np.ndindex(4, 2)}


def test_kmeans(spark, tmp_path):
    assert cluster.k_values(2, 6, 2) == [2, 4, 6] and cluster.k_values(9, 5, 3) == [5] and cluster.k_values(1, 3, 0) == [1, 2, 3]
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (20, 3)) for c in (0, 5, 9)])
    m = as_matrix(spark, x)
    t = cluster.sweep(m, [2, 3], 20, str(tmp_path)).orderBy("k").collect()
    assert t[0].wssse > t[1].wssse
    model = cluster.load(f"{tmp_path}/3")
    got = cluster.predict(model, m).collect()
    centres = [c.tolist() for c in model.clusterCenters()]
    assert sorted(r.value for r in got) == sorted(centres[r.cluster][0] for r in got)
    near = cluster.nearest(m, centres)
    assert {r.cell: r.cluster for r in near.collect()} == {r.cell: r.cluster for r in got}
    assert abs(cluster.cost(near).first().wssse - t[1].wssse) < 1e-6
    tie = cluster.nearest(as_matrix(spark, [[0.0]]), [[1.0], [-1.0]]).first()
    assert (tie.cluster, tie.d2) == (0, 1.0)
    many = rng.normal(size=(300, 3))
    far = ((x[:, None] - many) ** 2).sum(axis=2)
    assert {(r.cell, r.cluster): r.d2 for r in cluster.nearest(m, many.tolist()).collect()} == pytest.approx({(i, int(d.argmin())): d.min() for i, d in enumerate(far)})


def brute_step(z, w, rows, cols, k, l, eps, divergence):  # noqa: E741
    grand = (w * z).mean()

    def means():
        out = np.empty((k, l))
        for a, b in itertools.product(range(k), range(l)):
            m = np.ix_(rows == a, cols == b)
            out[a, b] = ((w * z)[m].sum() + grand * eps) / (w[m].sum() + eps)
        return out

    def side(z, w, others, protos):
        d = np.array([[((w[i] * (p[others] + eps)) - w[i] * z[i] * np.log(p[others] + eps)).sum() if divergence else (w[i] * (z[i] - p[others]) ** 2).sum() for p in protos] for i in range(len(z))])
        return d.argmin(axis=1), (d.min(axis=1) ** (1 if divergence else 2)).sum()

    rows, _ = side(z, w, cols, means())
    cols, error = side(z.T, w.T, rows, means().T)
    return rows, cols, error


@pytest.mark.parametrize("distance", ["euclidean", "divergence"])
def test_coclustering(spark, distance):
    rng = np.random.default_rng(5)
    z = np.kron(np.array([[1.0, 5.0], [9.0, 2.0], [4.0, 7.0]]), np.ones((4, 3))) + rng.random((12, 6)) * 0.1
    w = np.where(rng.random(z.shape) < 0.1, 0.5, 1.0)
    model = cluster.CoClusters(3, 2, distance, start="mod", iterations=12, runs=1)
    long = spark.createDataFrame([(int(i), int(j), float(z[i, j]), float(w[i, j])) for i, j in np.ndindex(*z.shape)], "i long, j long, z double, w double")
    rows, cols, status = model.fit(long)
    r, c, before = np.arange(12) % 3, np.arange(6) % 2, math.inf
    for step in range(1, 13):
        r, c, error = brute_step(z, w, r, c, 3, 2, 1e-8, distance == "divergence")
        if abs(error - before) < 1e-6:
            assert status == f"converged in {step} iterations"
            break
        before = error
    assert [x.c for x in rows.orderBy("i").collect()] == r.tolist() and [x.c for x in cols.orderBy("j").collect()] == c.tolist()


def test_coclustering_from_hashed_starts_keeps_the_best_run(spark):
    rng = np.random.default_rng(6)
    z = np.kron(np.array([[1.0, 5.0], [9.0, 2.0]]), np.ones((6, 4))) + rng.random((12, 8)) * 0.1
    long = spark.createDataFrame([(int(i), int(j), float(z[i, j])) for i, j in np.ndindex(*z.shape)], "i long, j long, z double")
    rows, cols, status = cluster.CoClusters(2, 2, runs=3, iterations=8, best_of_runs=True, seed=3).fit(long)
    r, c = [x.c for x in rows.orderBy("i").collect()], [x.c for x in cols.orderBy("j").collect()]
    assert "converged" in status and len(set(r[:6])) == len(set(r[6:])) == len(set(c[:4])) == len(set(c[4:])) == 1 and r[0] != r[6] and c[0] != c[4]
    first = [cluster.CoClusters(2, 2, seed=k)._first(spark.range(200).withColumnRenamed("id", "i"), "i", 2, run).orderBy("i").collect() for k, run in ((1, 0), (1, 0), (1, 1), (2, 0))]
    assert first[0] == first[1] != first[2] and first[0] != first[3] and {x.c for x in first[0]} == {0, 1}


def test_text_sources_and_transposed_lines(spark, tmp_path):
    (tmp_path / "a.set").write_text("one\ntwo\n")
    assert [r[0] for r in text.read_lines(spark, str(tmp_path / "a.set"), whole=True).collect()] == ["one\ntwo\n"]
    (tmp_path / "elbow.csv").write_text("2,75,1.5\nx,y\n3,75,0.5\n")
    assert sorted(tuple(r) for r in text.read_elbow(spark, str(tmp_path / "elbow.csv")).collect()) == [(2, 75, 1.5), (3, 75, 0.5)]
    v = spark.createDataFrame([(m, c, 10.0 * m + c) for m in (0, 1) for c in (3, 1, 2)], "mode int, cell long, value double")
    text.write_transposed(v, str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["1.0,11.0", "2.0,12.0", "3.0,13.0"]


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1.5, 2,x",), ("",)], "value string")
    assert [r[0] for r in df.select(text.parse_numbers(F.col("value"))).collect()] == [[1.5, 2.0, None], [None]]
    lines = spark.createDataFrame([(0, 5, 1.5), (0, 4, 0.5)], "mode int, cell long, value double")
    s = spark.createDataFrame([(0, 9.0)], "mode int, value double")
    out = text.mode_lines(lines, s, lines)
    assert [r.line for r in out.orderBy("line_no").collect()] == ["0.5,1.5", "9.0", "0.5,1.5"]
    for block in (65_536, 5):
        text.BLOCK = block
        text.write_modes(text.mode_blocks(lines, s, lines), str(tmp_path / "modes"))
        assert (tmp_path / "modes/mode=0.txt").read_text() == "0.5,1.5\n9.0\n0.5,1.5\n"
    text.BLOCK = 65_536
    program = tmp_path / "tool.sh"
    program.write_text("#!/bin/sh\nsed s/a/b/\n")
    program.chmod(0o755)
    assert [r[0] for r in text.through_program(spark.createDataFrame([("a1",)], "value string"), f"sh {program}", str(program)).collect()] == ["b1"]


def test_results_are_kept_by_their_parameters(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for p in ({"k": 1}, {"k": 1}, {"k": 2}):
        assert computed(spark, str(tmp_path), "t", p, make).count() == 3
    assert len(made) == 2
    assert computed(spark, str(tmp_path), "t", {"k": 1}, make, again=True).count() == 3 and len(made) == 3


def test_streaming(spark, folder):
    query = running_summary(watch_stack(spark, folder, files_at_once=4)).writeStream.outputMode("complete").format("memory").queryName("summary").start()
    query.processAllAvailable()
    query.stop()
    want = stats.cell_summary(stack.read_stack(spark, folder)).collect()
    got = {r.cell: r for r in spark.table("summary").collect()}
    assert len(got) == 96 and all(got[r.cell].n == r.n and (r.n < 2 or abs(got[r.cell]["mean"] - r["mean"]) < 1e-9) for r in want)


def test_painting_each(spark, tmp_path):
    grid = SimpleNamespace(cols=3, rows=2, xmin=0.0, ymin=0.0, xmax=3.0, ymax=2.0, epsg=4326)
    df = spark.createDataFrame([(1, 0, 2.0), (1, 5, 3.0), (2, 1, 4.0)], "mode int, cell long, value double")
    paths = paint.write_each(df, grid, "mode", str(tmp_path / "out"))
    assert len(paths) == 2
    again = stack.read_stack(spark, str(tmp_path / "out")).where("value is not null")
    assert sorted((r.cell, r.value) for r in again.collect()) == [(0, 2.0), (1, 4.0), (5, 3.0)]
