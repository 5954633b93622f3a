"""Scans, filters, interpolation and convolution over many blocks agree with one pass over the whole."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import linalg, products, scans, signal
from gridloom.operators.matrix import COL, ROW, Matrix
from gridloom.operators.scans import BLOCK


@pytest.fixture
def blocks(monkeypatch):
    """Blocks of seven positions."""
    monkeypatch.setattr(scans, "BLOCK", 7)
    monkeypatch.setattr(signal, "BLOCK", 7)


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(2).normal(size=(23, 16))


def _rows(a):
    return np.array(a.to_rows())


def test_scans_of_blocks(spark, blocks, x):
    a = Matrix.of(spark, x.tolist())
    for axis, at in ((ROW, 1), (COL, 0)):
        assert np.allclose(_rows(a.cumsum(axis)), x.cumsum(at))
        assert np.allclose(_rows(a.cumprod(axis)), x.cumprod(at))
        assert np.allclose(_rows(a.diff(axis)), np.diff(x, axis=at))
        assert np.allclose(_rows(a.gradient(axis, 0.5)), np.gradient(x, 0.5, axis=at))
        steps = np.zeros_like(x)
        np.moveaxis(steps, at, 0)[1:] = (np.moveaxis(x, at, 0)[1:] + np.moveaxis(x, at, 0)[:-1]) / 2
        assert np.allclose(_rows(a.cumtrapz(axis)), steps.cumsum(at))
        assert np.allclose(_rows(a.sort(axis)), np.sort(x, axis=at))
        assert np.allclose(_rows(a.sort(axis, descending=True)), -np.sort(-x, axis=at))
        assert np.allclose(_rows(a.median(axis)).ravel(), np.median(x, axis=at))
    assert abs(a.median() - np.median(x)) < 1e-12
    places = Matrix.of(spark, [[float(k * k) for k in range(16)]])
    assert abs(a.row(0).trapz_over(places) - np.trapezoid(x[0], np.arange(16) ** 2)) < 1e-9


def test_ranks_are_positions(spark):
    rng = random.Random(3)
    values = [rng.randrange(40) for _ in range(300)]
    got = scans.numbered(spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, k int").repartition(6), ["v", "k"]).collect()
    want = {k: n for n, (_, k) in enumerate(sorted((v, k) for k, v in enumerate(values)))}
    assert {r["k"]: r["rank"] for r in got} == want


def test_filters_over_blocks(spark, blocks):
    rng = np.random.default_rng(4)
    rows = [(s, k, float(rng.normal())) for s, n in ((1, 30), (2, 1), (3, 9), (None, 12)) for k in range(n)]
    df = spark.createDataFrame(rows, "s int, k int, x double").repartition(5)
    b, a = [0.5, 0.25, -0.1, 0.2], [2.0, -0.6, 0.3]
    iir = {(r["s"], r["k"]): r["filtered"] for r in signal.iir(df, "k", "x", b, a, ["s"]).collect()}
    fir = {(r["s"], r["k"]): r["filtered"] for r in signal.fir(df, "k", "x", b, ["s"]).collect()}
    for s in (1, 2, 3, None):
        xs, ys = [v for t, _, v in rows if t == s], []
        for n in range(len(xs)):
            taps = sum(c * xs[n - k] for k, c in enumerate(b) if n >= k)
            ys.append((taps - sum(c * ys[n - k] for k, c in enumerate(a) if k and n >= k)) / a[0])
            assert abs(fir[s, n] - taps) < 1e-12 and abs(iir[s, n] - ys[n]) < 1e-9
    alone = signal.iir(df.where("s = 1").drop("s"), "k", "x", [1.0], [1.0, -1.0]).collect()
    total = np.cumsum([v for t, _, v in rows if t == 1])
    assert all(abs(r["filtered"] - total[r["k"]]) < 1e-9 for r in alone)


def test_interpolation_over_blocks(spark, blocks):
    rng = np.random.default_rng(5)
    knots = [(s, float(p), float(rng.normal())) for s in (1, 2) for p in range(0, 40, 2)] + [(3, 1.0, 5.0)]
    asked = [(s, float(q), f"{s}/{q}") for s in (1, 2, 3, 4) for q in rng.uniform(-3, 42, 25)] + [(1, 4.0, "on"), (1, 4.0, "on"), (3, 1.0, "only")]
    got = signal.interp1(spark.createDataFrame(knots, "s int, x double, y double"), spark.createDataFrame(asked, "s int, q double, name string").repartition(4), "x", "y", "q", ["s"]).collect()
    assert len(got) == len(asked) and set(got[0].asDict()) == {"s", "q", "name", "interpolated"}
    for r in got:
        own = [(x, y) for s, x, y in knots if s == r["s"]]
        inside = own and own[0][0] <= r["q"] <= own[-1][0]
        assert math.isnan(r["interpolated"]) != bool(inside)
        if inside:
            assert abs(r["interpolated"] - np.interp(r["q"], *zip(*own))) < 1e-9


@pytest.mark.parametrize("block", [4, 1000])
def test_convolution_by_blocks(spark, block):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=19), rng.normal(size=11)
    got = signal.conv(Matrix.of(spark, [a.tolist()]), Matrix.of(spark, [[v] for v in b]), block)
    assert got.shape == (1, 29) and np.allclose(_rows(got), np.convolve(a, b))


def test_products_of_sparse_cells_are_dense(spark):
    """A product has all its cells, whatever its size and however few the factors have."""
    df = spark.createDataFrame([(0, 0, 2.0), (1, 1, 3.0)], "i long, j long, v double")
    a = Matrix(df, 2, 2)
    assert sorted(map(tuple, products.multiply(a, a).df.collect())) == [(0, 0, 4.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 9.0)]


def test_ill_conditioned_and_deficient(spark):
    n = 7
    h = np.array([[1.0 / (i + j + 1) for j in range(n)] for i in range(n)])
    a = Matrix.of(spark, h.tolist())
    assert linalg.rank(a) == n
    x = _rows(linalg.solve(a, Matrix.of(spark, h.sum(axis=1, keepdims=True).tolist())))
    assert np.abs(x - 1).max() < 1e-6
    rng = np.random.default_rng(7)
    t = rng.normal(size=(60, 5))
    t[:, 4] = t[:, 0] - 2 * t[:, 1]
    tall, b = Matrix.of(spark, t.tolist()), rng.normal(size=(60, 2))
    assert linalg.rank(tall) == 4
    assert np.allclose(_rows(linalg.solve(tall, Matrix.of(spark, b.tolist()))), np.linalg.lstsq(t, b, rcond=None)[0])
    q, r, p = linalg.qr_pivoted(tall)
    assert q.n == 4 and np.allclose(_rows(q) @ r @ p.T, t) and np.allclose(_rows(q).T @ _rows(q), np.eye(4))
    with pytest.raises(ArithmeticError):
        linalg.qr(tall)
    assert np.allclose(t @ linalg.null(tall), 0) and linalg.null(tall).shape == (5, 1)
    wide = Matrix.of(spark, t[:3].tolist())
    assert np.allclose(linalg.lsqminnorm(wide, Matrix.of(spark, b[:3].tolist())), np.linalg.pinv(t[:3]) @ b[:3])
    with pytest.raises(np.linalg.LinAlgError):
        linalg.solve(Matrix.of(spark, [[1.0, 2.0], [2.0, 4.0]]), Matrix.of(spark, [[1.0], [2.0]]))


def test_triangles_over_levels(spark):
    x = np.random.default_rng(8).normal(size=(400, 6))
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "i long, r array<double>").repartition(40)
    got = linalg.triangle(rows, 6)
    want = np.linalg.qr(x, mode="r")
    assert np.allclose(got, want * np.sign(np.diag(want))[:, None])
    assert np.allclose(_rows(products.gram(linalg.of_rows(rows, 400, 6))), x.T @ x)


def test_lazy_meets_once(spark):
    a, b = Matrix.of(spark, [[1.0, 2.0], [3.0, 4.0]]), Matrix.of(spark, [[5.0, 6.0], [7.0, 8.0]])
    made = (a.lazy() % b + a.lazy().ln() - b).eval()
    assert np.allclose(_rows(made), np.array([[5, 12], [21, 32]]) + np.log([[1, 2], [3, 4]]) - [[5, 6], [7, 8]])
    with pytest.raises(ValueError):
        a.lazy() + Matrix.of(spark, [[1.0]]).lazy()
    assert made.df.where(F.col("v").isNull()).count() == 0


def test_a_full_block_is_interpolated_in_linear_time(spark):
    """One block of 65,536 rows: a frame that is read anew for every row takes minutes here."""
    n = BLOCK // 2
    knots = spark.range(n).select((F.col("id") * 2).alias("x"), (F.col("id") * 3.0).alias("y"))
    asked = spark.range(n - 1).select((F.col("id") * 2 + 1).alias("q"))
    began = time.monotonic()
    bad = signal.interp1(knots, asked, "x", "y", "q").where("abs(interpolated - 1.5 * q) > 1e-9").count()
    assert bad == 0 and time.monotonic() - began < 40


def test_equal_values_are_dealt_over_partitions(spark, monkeypatch):
    """One value in nearly all rows: no partition holds most of them, and ranks are whole."""
    put, most = scans.materialize, []

    def watched(df, label):
        made = put(df, label)
        most.append(made.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
        return made

    monkeypatch.setattr(scans, "materialize", watched)
    df = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scans.numbered(df, ["v"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first() == (40_000, 0, 39_999)
    assert most[0] < 20_000
    assert found.orderBy("rank").select("v").collect() == df.orderBy("v").collect()
