"""Hand-computed goldens, shape rules and edge cases of the matrix operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import batched, learn, linalg, products, setops
from gridloom.operators.matrix import COL, ROW, Matrix
from gridloom.operators.tensor import Tensor, contract, contract_axes
from gridloom.sources import generate, sinks


@pytest.fixture(scope="module")
def m(spark):
    return Matrix.of(spark, [[3, 1, 4], [1, 5, 9]])


def test_reductions(m):
    assert m.sum() == 23 and m.sum(COL).to_rows() == [[4, 6, 13]] and m.sum(ROW).to_rows() == [[8], [15]]
    assert m.min(COL).to_rows() == [[1, 1, 4]] and m.max(ROW).to_rows() == [[4], [9]] and m.mean(COL).to_rows() == [[2, 3, 6.5]]
    assert m.argmin() == (0, 1) and m.argmax() == (1, 2)
    assert m.prod(COL).to_rows() == [[3, 5, 36]] and m.prod(ROW).to_rows() == [[12], [45]]
    assert m.median() == 3.5 and m.median(COL).to_rows() == [[2, 3, 6.5]]
    assert m.norm("one") == 13 and m.norm("inf") == 15 and m.norm() == pytest.approx(math.sqrt(133))


def test_scans_and_order(m):
    assert m.cumsum(COL).to_rows() == [[3, 1, 4], [4, 6, 13]] and m.cumsum(ROW).to_rows() == [[3, 4, 8], [1, 6, 15]]
    assert m.cumprod(COL).to_rows() == [[3, 1, 4], [3, 5, 36]]
    assert m.diff(COL).to_rows() == [[-2, 4, 5]] and m.diff(ROW).to_rows() == [[-2, 3], [4, 4]]
    assert m.sort(COL).to_rows() == [[1, 1, 4], [3, 5, 9]] and m.sort(ROW).to_rows() == [[1, 3, 4], [1, 5, 9]] and m.sort(ROW, True).to_rows() == [[4, 3, 1], [9, 5, 1]]
    assert m.sortrows(0).to_rows() == [[1, 5, 9], [3, 1, 4]]
    assert m.trapz(ROW).to_rows() == [[4.5], [10]] and m.cumtrapz(ROW).to_rows() == [[0, 2, 4.5], [0, 3, 10]]
    assert m.gradient(ROW).to_rows() == [[-2, 0.5, 3], [4, 4, 4]]


def test_rounding_and_remainders(spark):
    x = Matrix.of(spark, [[-2.5, -1, 0, 1.5, 2.5]])
    assert x.floor().to_rows() == [[-3, -1, 0, 1, 2]] and x.ceil().to_rows() == [[-2, -1, 0, 2, 3]]
    assert x.round().to_rows() == [[-3, -1, 0, 2, 3]] and x.fix().to_rows() == [[-2, -1, 0, 1, 2]]
    y = Matrix.of(spark, [[-1, -4, 5, 7]])
    assert y.mod(3).to_rows() == [[2, 2, 2, 1]] and y.rem(3).to_rows() == [[-1, -1, 2, 1]] and y.mod(0).to_rows() == y.to_rows()


def test_ieee(spark):
    x = Matrix.of(spark, [[1.0, -1.0, 0.0, float("nan"), float("inf")]])
    a, b, c, d, e = (x / 0.0).to_rows()[0]
    assert a == math.inf and b == -math.inf and math.isnan(c) and math.isnan(d) and e == math.inf
    a, b, c, d, e = x.ln().to_rows()[0]
    assert a == 0 and math.isnan(b) and c == -math.inf and math.isnan(d) and e == math.inf
    assert x.gt(0.0).to_rows() == [[True, False, False, False, True]] and x.ne(x).to_rows() == [[False, False, False, True, False]]
    assert not x.equals(x) and not x.allclose(x) and x.floor().to_rows()[0][4] == math.inf


def test_masks(m):
    assert m.gt(3).nnz() == 3 and m.gt(8).any() and not m.gt(8).all()
    assert [tuple(r) for r in m.ge(4).find().collect()] == [(0, 2), (1, 1), (1, 2)]
    picked = m.select_where(m.gt(3))
    assert picked.shape == (3, 1) and picked.to_rows() == [[4], [5], [9]]
    assert m.put_where(m.gt(3), 0).to_rows() == [[3, 1, 0], [1, 0, 0]]
    assert m.put_where(m.gt(3), picked * 2.0).to_rows() == [[3, 1, 8], [1, 10, 18]]


def test_access_and_structure(spark, m):
    assert m.at(-1, -1) == 9 and m.flat(4) == 5 and m.row(1).to_rows() == [[1, 5, 9]] and m.col(-1).to_rows() == [[4], [9]]
    with pytest.raises(IndexError):
        m.at(2, 0)
    with pytest.raises(TypeError):
        m.at(0.5, 0)
    assert m.block((1, 0), (0, 1)).to_rows() == [[1, 5], [3, 1]]
    a = Matrix.of(spark, [[1, 2, 3], [4, 5, 6]])
    assert a.circshift(1, 0).to_rows() == [[4, 5, 6], [1, 2, 3]] and a.circshift(-1, 1).to_rows() == [[2, 3, 1], [5, 6, 4]]
    assert a.rot90().shape == (3, 2) and a.rot90().at(0, 0) == 3 and a.rot90(4).to_rows() == a.to_rows()
    assert a.T().T().to_rows() == a.to_rows() and a.reshape(3, 2).to_rows() == [[1, 2], [3, 4], [5, 6]]
    assert a.hstack(a).shape == (2, 6) and a.vstack(a).to_rows()[2] == [1, 2, 3]
    assert a.resized(3, 2).to_rows() == [[1, 2], [4, 5], [0, 0]]
    with pytest.raises(ValueError):
        Matrix.of(spark, [[1], [1, 2]])


def test_generators(spark):
    assert generate.linspace(spark, 0, 1, 5).to_rows() == [[0, 0.25, 0.5, 0.75, 1]] and generate.linspace(spark, 2, 5, 1).to_rows() == [[5]]
    assert generate.span(spark, 0, 5, 2).to_rows() == [[0, 2, 4]] and generate.span(spark, 5, 0).empty() and generate.linspace(spark, 0, 1, 0).empty()
    for n in (1, 3, 4, 5, 6, 8, 10, 14):
        a = np.array(generate.magic(spark, n).to_rows())
        assert len(set(a.ravel())) == n * n and len({*a.sum(0), *a.sum(1), np.trace(a), np.trace(a[::-1])}) == 1, n
    assert sorted(generate.randperm(spark, 20, 3).to_rows()[0]) == list(range(20))
    assert generate.toeplitz(Matrix.of(spark, [[1, 2, 3]]), Matrix.of(spark, [[1, 8, 9]])).to_rows() == [[1, 8, 9], [2, 1, 8], [3, 2, 1]]


def test_products(spark, m):
    a = np.array(m.to_rows())
    assert np.allclose((m * m.T()).to_rows(), a @ a.T) and np.allclose(products.gram(m).to_rows(), a.T @ a)
    assert np.allclose(products.kron(m, m).to_rows(), np.kron(a, a))
    assert products.cross(Matrix.of(spark, [[1], [2], [3]]), Matrix.of(spark, [[4], [5], [6]])).to_rows() == [[-3], [6], [-3]]
    b = Matrix.of(spark, [[2, 1], [1, 3]])
    assert np.allclose(products.power(b, 5).to_rows(), np.linalg.matrix_power(np.array(b.to_rows()), 5))
    with pytest.raises(ValueError):
        m * m


def test_linalg(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    a = Matrix.of(spark, x.tolist())
    q, r = linalg.qr(a)
    assert np.allclose(np.array(q.to_rows()) @ r, x) and np.allclose(np.triu(r), r)
    assert np.allclose(linalg.svdvals(a), np.linalg.svd(x)[1]) and linalg.rank(a) == 5
    b = rng.normal(size=(40, 1))
    assert np.allclose(linalg.solve(a, Matrix.of(spark, b.tolist())).to_rows(), np.linalg.lstsq(x, b, rcond=None)[0])
    s = x[:5]
    inv = linalg.inverse(Matrix.of(spark, s.tolist()))
    assert np.allclose(np.array(inv.to_rows()) @ s, np.eye(5), atol=1e-6) and linalg.det(Matrix.of(spark, s.tolist())) == pytest.approx(np.linalg.det(s))
    assert linalg.normest(a) == pytest.approx(np.linalg.norm(x, 2), rel=1e-4)


@pytest.mark.parametrize("name", sorted(set(batched.FUNCTIONS) - {"roots", "poly", "polyeig"}))
def test_batched_functions_run(name):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4, 4))
    a = a @ a.T + 4 * np.eye(4)
    made = batched.FUNCTIONS[name](a)
    assert all(np.isfinite(x).all() for x in (made.values() if isinstance(made, dict) else [made]))


def test_matrix_functions():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4, 4)) / 2
    f = batched.FUNCTIONS
    assert np.allclose(f["sinm"](a) @ f["sinm"](a) + f["cosm"](a) @ f["cosm"](a), np.eye(4))
    assert np.allclose(f["expm"](np.diag([0.0, 1.0])), np.diag([1.0, math.e]))
    t = batched.schur(a)
    assert np.allclose(t["Q"] @ t["T"] @ t["Q"].conj().T, a) and np.allclose(np.sort_complex(np.diag(t["T"])), np.sort_complex(np.linalg.eigvals(a)))
    assert np.allclose(batched.PAIRS["deconv"](np.array([[1, 7, 13, 15]]), np.array([[1, 5]]))["quotient"], [[1, 2, 3]])


def test_sets(spark):
    a, b = Matrix.of(spark, [[3, 1, 4, 1, 5]]), Matrix.of(spark, [[1, 5, 9]])
    flat = lambda x: [r[0] for r in x.to_rows()]
    assert flat(setops.unique(a)) == [1, 3, 4, 5] and flat(setops.union(a, b)) == [1, 3, 4, 5, 9] and flat(setops.intersect(a, b)) == [1, 5]
    assert flat(setops.setdiff(a, b)) == [3, 4] and flat(setops.setxor(a, b)) == [3, 4, 9]
    assert setops.ismember(a, b).to_rows() == [[False, True, False, True, True]] and not setops.issubset(a, b)


def test_tensors(spark):
    t = Tensor.generate(spark, (2, 3, 4), lambda n: n)
    x = np.arange(24.0).reshape(2, 3, 4)

    def array(t):
        out = np.zeros(t.shape)
        for r in t.df.select(*t.axes, "v").collect():
            out[tuple(r[:-1])] = r[-1]
        return out

    assert np.array_equal(array(t.permute([2, 0, 1])), x.transpose(2, 0, 1)) and np.array_equal(array(t.reshape(6, -1)), x.reshape(6, 4))
    assert np.array_equal(array(t.slice(1, 2)), x[:, 2]) and np.array_equal(array(t.sum(1)), x.sum(1)) and np.array_equal(array(t.diff(2)), np.diff(x, axis=2))
    u = Tensor.generate(spark, (4, 5), lambda n: n)
    assert np.array_equal(array(contract(t, u)), np.tensordot(x, np.arange(20.0).reshape(4, 5), 1))
    assert np.array_equal(array(contract_axes(t, t, [0, 1], [0, 1])), np.tensordot(x, x, [[0, 1], [0, 1]]))
    with pytest.raises(ValueError):
        t + u


def test_sinks(spark, m, tmp_path):
    text = sinks.render(m, sinks.Options("csv", header=True))
    assert text == "col0,col1,col2\n3,1,4\n1,5,9" and sinks.render(m, sinks.Options("json")) == "[[3.0, 1.0, 4.0], [1.0, 5.0, 9.0]]"
    sinks.save(m, str(tmp_path / "a.md"))
    assert (tmp_path / "a.md").read_text().startswith("| col0")
    sinks.write(m, str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells")).count() == 6
    with pytest.raises(OSError):
        sinks.save(m, str(tmp_path / "none" / "a.csv"))


def test_perceptrons(spark):
    for name in ("and", "or", "nand", "nor"):
        table = learn.truth_table(spark, learn.LOGIC[name])
        w, epochs = learn.train_online(table, ["a", "b", "one"], "y")
        assert epochs > 0 and learn.predict(table, ["a", "b", "one"], w).where("predicted <> y").count() == 0
    w, epochs = learn.train_batch(learn.truth_table(spark, learn.LOGIC["and"]), ["a", "b", "one"], "y")
    assert epochs > 0
    assert learn.train_online(learn.truth_table(spark, learn.LOGIC["xor"]), ["a", "b", "one"], "y", epochs=20)[1] == -1


def test_polynomial_eigenvalues():
    a = np.diag([2.0, 6.0])
    found = batched.polyeig(np.hstack([a, -3 * np.eye(2) - np.diag([0.0, 2.0]), np.eye(2)]))
    assert np.allclose(found.ravel(), [1, 2, 2, 3])


def test_complex(spark):
    from gridloom.operators.complexes import Complex

    x = np.array([[1 + 2j, -3j], [0.5, 2 - 1j]])
    z = Complex.of(Matrix.of(spark, x.real.tolist()), Matrix.of(spark, x.imag.tolist()))

    def array(c):
        out = np.zeros(c.shape, complex)
        for r in c.df.select("i", "j", "re", "im").collect():
            out[r[0], r[1]] = complex(r[2], r[3])
        return out

    assert np.allclose(array(z * z), x @ x) and np.allclose(array(z.H()), x.conj().T) and np.allclose(array(z.sqrt()), np.sqrt(x))
    for f in ("exp", "sin", "cos", "tan", "sinh", "cosh", "tanh", "conj"):
        assert np.allclose(array(getattr(z, f)()), getattr(np, f)(x)), f
    assert np.isclose(z.dot(z), (x.conj() * x).sum()) and np.isclose(z.var(), np.var(x)) and (z * z.H()).is_hermitian() and not z.is_hermitian()
    with pytest.raises(TypeError):
        z.sort(ROW)


def test_pair_forces_are_balanced(spark):
    from gridloom.operators.complexes import pair_forces

    rng = np.random.default_rng(4)
    p = rng.uniform(0, 6, (60, 2))
    got = {r["k"]: r for r in pair_forces(spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(p)], "k int, x double, y double"), "k", "x", "y", 1.2).collect()}
    d = p[:, None] - p[None]
    r2 = (d**2).sum(-1) + np.eye(60) * 99
    s6 = np.where(r2 < 1.44, r2**-3.0, 0)
    want = (24 * (2 * s6 * s6 - s6) / r2)[..., None] * d
    for k in got:
        assert got[k]["fx"] == pytest.approx(want[k, :, 0].sum(), rel=1e-6) and got[k]["partners"] == (r2[k] < 1.44).sum()


def test_product_by_blocks(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(11, 7)), rng.normal(size=(7, 9))
    a, b = Matrix.of(spark, x.tolist()), Matrix.of(spark, y.tolist())
    for block in (3, 4, 16):
        assert np.allclose(products.multiply_blocked(a, b, block).to_rows(), x @ y)


@pytest.mark.parametrize("few", [0, 32])
@pytest.mark.parametrize("kind", ["lines", "anywhere", "copies"])
def test_near_totals_are_those_of_the_pairs(spark, kind, few, monkeypatch):
    """Borders, copies of one place, keys of many places and places that are not numbers, over many tiles."""
    from gridloom.operators import complexes

    monkeypatch.setattr(complexes, "FEW", few)
    rng = np.random.default_rng(9)
    x, y = rng.integers(-40, 40, 260) / 4, rng.integers(-20, 20, 260) / 2
    if kind == "anywhere":
        x, y = x + rng.uniform(size=260), y + rng.uniform(size=260)
    if kind == "copies":
        x, y = np.round(x / 8) * 8 + 0.5, np.round(y / 4) * 4
    rows = [(k // 2 if k < 60 else k, a, b) for k, (a, b) in enumerate(zip(x.tolist(), y.tolist()))]
    rows += [(900, float("nan"), 1.0), (901, 1.0, float("inf")), (902, None, 1.0), (None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(3)
    pairs = complexes.near_pairs(df.where("k < 900"), "k", "x", "y", 1.25).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("r2").alias("s")).collect()
    got = {r["k"]: (r["n"], r["s"]) for r in complexes.near_totals(df, "k", "x", "y", 1.25).collect()}
    assert {r["k"]: r["n"] for r in pairs} == {k: n for k, (n, _) in got.items()}
    assert all(got[r["k"]][1] == pytest.approx(r["s"], rel=1e-13) for r in pairs)
    units = df.withColumn("y", F.col("y") * 2)
    assert {r["k"]: (r["n"], r["s"]) for r in complexes.near_totals(units, "k", "x", "y", 1.25, 0.5).collect()}.keys() == got.keys()


def test_crowded_neighbours_make_no_pairs(spark):
    """60,000 points in two places have 1.8 billion pairs, which a join would make one by one."""
    from gridloom.operators.complexes import near_totals

    df = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert near_totals(df, "k", "x", "y", 1.5).groupBy("n", "s").count().collect() == [(30_000, 30_000.0, 60_000)]


def test_neighbours_are_those_of_sql_at_the_border(spark, tmp_path):
    """Partners at a distance of exactly 1.5, whose lines SQL keeps as decimals."""
    import duckdb

    from gridloom.plans.queries import ORACLE, QUERIES

    path = tmp_path / "events.parquet"
    duckdb.sql(f"COPY (SELECT range * 97 + range % 3 AS event_id, (range * 7 % 5) * 100.0::DOUBLE AS value FROM range(1500)) TO '{path}'")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    want = {r[0]: r[1:] for r in c.sql(ORACLE["neighbours_in_range"]).fetchall()}
    got = {r["event_id"]: (r["partners"], r["mean_r2"]) for r in QUERIES["neighbours_in_range"](spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)
