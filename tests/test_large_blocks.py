"""Large matrices in blocks against numpy, with blocks small enough for many panels."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.functions import ieee
from gridloom.operators import blocks, products
from gridloom.operators.blocks import Blocked
from gridloom.operators.matrix import Matrix

N, BLOCK = 23, 8


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(7).normal(size=(N, N))


def of(spark, a, block=BLOCK):
    return Blocked.of(Matrix.of(spark, a.tolist()), block).written()


def back(b):
    out = np.zeros((b.m, b.n))
    for i, j, v in b.to_matrix().df.collect():
        out[i, j] += v
    return out


@pytest.mark.parametrize("small", [0, blocks.SMALL])
def test_products(spark, x, small, monkeypatch):
    monkeypatch.setattr(blocks, "SMALL", small)
    a, b = x[:, :12], x[:12, :7]
    assert np.allclose(back(of(spark, a).multiply(of(spark, b))), a @ b)
    assert np.allclose(back(of(spark, b.T).multiply(of(spark, a.T))), b.T @ a.T)
    assert np.allclose(back(of(spark, a).T()), a.T)
    s = of(spark, x)
    assert np.allclose(back(s.add(s.T(), -2.0).plus_diagonal(3.0).scaled(0.5)), (x - 2 * x.T + 3 * np.eye(N)) / 2)
    assert np.isclose(blocks.norm(s), np.abs(x).sum(axis=1).max())


def test_cholesky(spark, x):
    a = x @ x.T + N * np.eye(N)
    low = blocks.cholesky(of(spark, a))
    assert np.allclose(back(low), np.linalg.cholesky(a))
    assert np.allclose(back(blocks.solve_positive(of(spark, a), of(spark, x[:, :8]))), np.linalg.solve(a, x[:, :8]))
    with pytest.raises(np.linalg.LinAlgError):
        blocks.cholesky(of(spark, a - 2 * a.max() * np.eye(N)))


@pytest.mark.parametrize("fan", [2, 8])
def test_lu(spark, x, fan, monkeypatch):
    monkeypatch.setattr(blocks, "FAN_IN", fan)
    f = blocks.lu(of(spark, x))
    low, up = back(f.lower), back(f.upper)
    order = [r["row"] for r in f.order.orderBy("pos").collect()]
    assert sorted(order) == list(range(N))
    assert np.allclose(low @ up, x[order]) and np.allclose(np.diag(low), 1) and not np.triu(low, 1).any() and not np.tril(up, -1).any()
    assert np.allclose(back(f.permuted(of(spark, x[:, :3]))), x[order][:, :3])
    sign, log = np.linalg.slogdet(x)
    got = blocks.log_det(f)
    assert got[0] == sign and np.isclose(got[1], log)
    b = x[:, :7] + 1
    assert np.allclose(back(blocks.solve_factored(f, of(spark, b))), np.linalg.solve(x, b))
    assert np.allclose(back(blocks.solve_factored(f, of(spark, b), transposed=True)), np.linalg.solve(x.T, b))


def test_singular(spark, x):
    a = x.copy()
    a[:, 8] = a[:, 3]
    a[19] = a[2]
    f = blocks.lu(of(spark, a))
    order = [r["row"] for r in f.order.orderBy("pos").collect()]
    assert np.allclose(back(f.lower) @ back(f.upper), a[order])
    zero = np.zeros((7, 7))
    zero[0, 0] = 1.0
    g = blocks.lu(of(spark, zero, 3))
    assert blocks.log_det(g) == (0, -np.inf) and np.allclose(back(g.lower) @ back(g.upper), zero)
    with pytest.raises(np.linalg.LinAlgError):
        blocks.solve_factored(g, of(spark, np.ones((7, 1)), 3))


@pytest.mark.parametrize("perm", [[0, 1, 2, 3, 4, 5], [1, 0, 3, 2, 5, 4], [1, 2, 3, 4, 5, 0], [2, 0, 1, 4, 3, 5]])
def test_cycles(spark, perm):
    seen, n = set(), 0
    for k in range(len(perm)):
        n += k not in seen
        while k not in seen:
            seen.add(k)
            k = perm[k]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(perm)], "pos bigint, row bigint")
    assert blocks._cycles(df) == n


def test_mixed_precision(spark, x):
    a = x + N * np.eye(N)
    got, steps = blocks.solve_mixed(of(spark, a), of(spark, x[:, :2]))
    assert steps in (1, 2, 3, 4) and np.abs(back(got) - np.linalg.solve(a, x[:, :2])).max() < 1e-12
    # Too ill-conditioned for single precision: the double-precision factors take over.
    u, _, vt = np.linalg.svd(x)
    bad = u @ np.diag(np.logspace(0, -11, N)) @ vt
    b = bad @ np.ones((N, 1))
    got, steps = blocks.solve_mixed(of(spark, bad), of(spark, b))
    assert steps == -1 and np.abs(bad @ back(got) - b).max() < 1e-12


def test_functions(spark, x):
    a = x[:9, :9] / 3
    values, vectors = np.linalg.eig(a)
    assert np.allclose(back(blocks.exp(of(spark, a))), (vectors @ np.diag(np.exp(values)) @ np.linalg.inv(vectors)).real)
    s = a @ a.T + np.eye(9)
    root = back(blocks.sqrt(of(spark, s)))
    assert np.allclose(root @ root, s) and np.linalg.eigvalsh(root).min() > 0


def test_rows_of_other_lengths_are_told(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0])], "i bigint, r array<double>")
    assert sum(len(r["r"]) for r in rows.collect()) == 2 * 2  # as many as fit, at other places
    with pytest.raises(Exception, match="another length"):
        Blocked.of(Matrix(rows.select("i", F.posexplode("r").alias("j", "v")), 2, 2, packed=rows), 5).df.collect()


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_every_pair_meets_once(n):
    met = [p for r in blocks._rounds(n) for p in r if min(p) >= 0]
    assert sorted(met) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    for r in blocks._rounds(n):
        assert sorted(q for p in r for q in p if q >= 0) == list(range(n))


@pytest.mark.parametrize("shape, block", [((7, 23), 5), ((23, 9), 4)])
def test_singular_values(spark, x, shape, block):
    a = x[: shape[0], : shape[1]]
    u, s, v = blocks.svd(of(spark, a, block))
    values = np.array([r["s"] for r in s.orderBy("j").collect()])
    assert np.allclose(np.sort(values)[::-1][: min(shape)], np.linalg.svd(a, compute_uv=False)) and (values > 0).sum() == min(shape)
    left, right = back(u), back(v)
    assert np.allclose(right.T @ right, np.eye(shape[1])) and np.allclose(left * values @ right.T, a)
    assert np.allclose(left.T @ left, np.diag((values > 0).astype(float)), atol=1e-9)
    assert np.allclose(back(blocks.scale_columns(u, s)), left * values)


def test_thin_singular_values_of_a_wide_matrix(spark, x):
    """V has as many columns as the matrix has rows; its square would grow with the columns."""
    a = x[:5]
    u, s, v = blocks.svd_thin(of(spark, a, 4))
    values = np.zeros(5)
    for j, sv in s.collect():
        values[j] = sv
    assert (v.m, v.n, u.n) == (N, 5, 5) and np.allclose(back(u) * values @ back(v).T, a)
    assert np.allclose(back(v).T @ back(v), np.eye(5))


def test_blocks_widen_with_the_order():
    assert [blocks.side(n) for n in (1, 1024, 1025, 2049, 10**6)] == [256, 256, 512, 1024, 1024]


def test_rows_of_wide_panels():
    a = np.random.default_rng(3).normal(size=(301, 190))
    order, lu = blocks._lu_rows(a)
    low, up = np.tril(lu, -1)[:, :190] + np.eye(301, 190), np.triu(lu[:190])
    assert np.allclose(low @ up, a[order]) and np.abs(low).max() <= 1 + 1e-12
    a[:, 77] = a[:, 12]
    order, lu = blocks._lu_rows(a)
    assert np.allclose((np.tril(lu, -1) + np.eye(301, 190)) @ np.triu(lu[:190]), a[order])


@pytest.mark.parametrize("by", [1, 9])
def test_turned_columns(spark, x, by):
    assert np.allclose(back(of(spark, x).turned(by)), np.roll(x, by, axis=1))


def test_products_copy_a_factor_once_a_tile(spark, x, monkeypatch):
    """Many blocks along a side: partial products of one place are added up in one task, and copies follow the tiles, not the blocks."""
    monkeypatch.setattr(blocks, "SMALL", 0)
    a = of(spark, np.tril(x), 2)
    assert np.allclose(back(a.multiply(a.T())), np.tril(x) @ np.tril(x).T)


def test_narrow_factors_meet_in_pairs_without_copies(spark, x, monkeypatch):
    """Of one inner block no factor is copied on disk: each is shuffled once, whatever the product's order."""
    monkeypatch.setattr(blocks, "SMALL", 0)
    monkeypatch.setattr(blocks, "TILE", BLOCK)
    rows = spark.createDataFrame([(k, r[:5].tolist()) for k, r in enumerate(x)], "i bigint, r array<double>")
    e = Matrix(rows.select("i", F.posexplode("r").alias("j", "v")), N, 5, packed=rows)
    left, right = Blocked.of(e, BLOCK), Blocked.of(e.T(), BLOCK)
    got = left.product_cells(right)
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan
    assert np.allclose(got.to_rows(), x[:, :5] @ x[:, :5].T)
    assert np.allclose(back(left.multiply(right)), x[:, :5] @ x[:, :5].T)
    with pytest.raises(ValueError):
        left.product_cells(left)


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("shape", [(3, 5), (300, 2), (1, 1), (0, 4)])
def test_runs_are_the_cells_of_a_block(first, shape):
    x = np.random.default_rng(5).normal(size=shape)
    got = [(i, j + k, v) for b in blocks._lines(2, 1, x, 300, first) for i, j, run in zip(*[c.to_pylist() for c in b.columns]) for k, v in enumerate(run)]
    assert sorted(got) == [(600 + i, 300 + j, x[i, j]) for i in range(shape[0]) for j in range(shape[1])]


def test_rounded_products_are_written_by_codes(spark, monkeypatch, tmp_path):
    """Parquet's dictionaries hold: 2 bytes a cell instead of 8."""
    monkeypatch.setattr(blocks, "SMALL", 0)
    e = np.random.default_rng(5).normal(size=(1024, 64))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(e)], "i bigint, r array<double>")
    a = Matrix(rows.select("i", F.posexplode("r").alias("j", "v")), 1024, 64, packed=rows)
    made = products.multiply_blocked(a, a.T()).map_elems(lambda v: ieee.rounded(v, 5)).df.select("i", "j", "v")
    made.write.parquet(f"{tmp_path}/out")
    files = [pq.ParquetFile(f).metadata.row_group(0).column(2) for f in tmp_path.glob("out/*.parquet")]
    assert sum(c.num_values for c in files) == 1024 * 1024
    assert all("PLAIN" not in c.encodings for c in files if c.num_values > 40_000) and max(c.num_values for c in files) > 40_000
    out = np.zeros((1024, 1024))
    for i, j, v in spark.read.parquet(f"{tmp_path}/out").collect():
        out[i, j] = v
    assert np.allclose(out, e @ e.T, atol=6e-6)
