"""Generated matrices of several tiles, tables of many small matrices, and what is counted without a shuffle of all cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import batched, exact
from gridloom.operators.matrix import Matrix
from gridloom.sources import generate


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(generate, "TILE", 4)
    monkeypatch.setattr(generate, "TILES", 2)


@pytest.mark.parametrize("m, n", [(9, 9), (6, 11), (11, 3)])
def test_shapes_of_tiles(spark, m, n):
    c, r = np.arange(1.0, m + 1), np.arange(1.0, n + 1) * 10
    r[0] = c[0]
    i, j = np.indices((m, n))
    got = np.array(generate.toeplitz(Matrix.of(spark, [c.tolist()]), Matrix.of(spark, [r.tolist()])).to_rows())
    assert np.array_equal(got, np.where(i >= j, c[np.maximum(i - j, 0)], r[np.maximum(j - i, 0)]))
    both = np.concatenate([c, r[1:]])
    assert np.array_equal(np.array(generate.hankel(Matrix.of(spark, [c.tolist()]), Matrix.of(spark, [r.tolist()])).to_rows()), both[i + j])
    assert np.array_equal(np.array(generate.hankel(Matrix.of(spark, [c.tolist()])).to_rows()), np.concatenate([c, np.zeros(m)])[np.add.outer(np.arange(m), np.arange(m))])
    assert np.array_equal(np.array(generate.diagonal(Matrix.of(spark, [c.tolist()])).to_rows()), np.diag(c))
    assert np.array_equal(np.array(generate.eye(spark, n, 3.0).to_rows()), 3 * np.eye(n))
    assert np.allclose(np.array(generate.hilb(spark, n, 6).to_rows()), np.round(1 / (np.add.outer(np.arange(n), np.arange(n)) + 1), 6), atol=1e-15)


def test_no_cell_is_shuffled(spark):
    """Pieces of the vector go to tiles; the plan has no exchange by i or j above the cells."""
    plan = generate.toeplitz(Matrix.of(spark, [[1.0] * 9])).df._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and plan.index("Generate explode") < plan.index("Exchange")


@pytest.mark.parametrize("m, n", [(9, 9), (11, 3), (0, 0)])
def test_vectors_too_long_to_be_sent(spark, m, n, monkeypatch):
    c = Matrix.of(spark, [np.arange(1.0, m + 1).tolist()]) if m else generate.zeros(spark, 1, 0)
    r = Matrix.of(spark, [[1.0, *np.arange(2.0, n + 1) * 10]]) if n else generate.zeros(spark, 1, 0)
    every = lambda: [sorted(x.df.collect()) for x in (generate.toeplitz(c, r), generate.hankel(c), generate.diagonal(c))]
    sent = every()
    assert [len(x) for x in sent] == [m * n, m * m, m * m]
    monkeypatch.setattr(generate, "MOST_SENT", -1)
    assert every() == sent


def test_one_loop_makes_all_cells(spark):
    """A second explosion keeps the cells' code from being compiled."""
    x = Matrix.of(spark, [[1.0] * 9])
    for made in (generate.toeplitz(x), generate.hankel(x), generate.diagonal(x), generate.eye(spark, 9), generate.hilb(spark, 9, 6), generate.wilkinson(spark, 9)):
        plan = made.df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Generate explode") == 1 and "CartesianProduct" not in plan


@pytest.mark.parametrize("n", [9, 10, 12, 14])
def test_magic_squares_by_diagonals(spark, n):
    a = np.array(generate.magic(spark, n).to_rows())
    assert sorted(a.ravel()) == list(range(1, n * n + 1)) and set(a.sum(axis=0)) == set(a.sum(axis=1)) == {n * (n * n + 1) / 2}


@pytest.mark.parametrize("n", [1, 3, 9, 10, 12, 14])
def test_magic_squares_by_lines(spark, n, monkeypatch):
    monkeypatch.setattr(exact, "BITS", 16)
    monkeypatch.setattr(exact, "MAPS", 2)
    a, got = np.array(generate.magic(spark, n).to_rows()), np.zeros((n, n))
    lines, line = generate.magic_lines(n)
    for s in range(lines):
        for i, j, v in line(s):
            assert (got[i, j] == 0).all()
            got[i, j] = v
    assert np.array_equal(got, a)
    sums, different = exact.sums_of_square(spark, n, lines, line)
    assert {r["v"] for r in sums.collect()} == {n * (n * n + 1) // 2} and sums.count() == 2 * n and different.first()[0] == n * n


def test_sums_of_a_square_that_is_not_magic(spark):
    line = lambda s: iter([(s, np.arange(5), np.arange(5) - 2 + s % 2)])
    sums, different = exact.sums_of_square(spark, 5, 5, line)
    assert {(r["side"], r["at"]): r["v"] for r in sums.collect()} == {(0, k): 5 * (k % 2) for k in range(5)} | {(1, k): 5 * (k - 2) + 2 for k in range(5)}
    assert different.first()[0] == 6


@pytest.mark.parametrize("n", [60_001, 60_002, 60_004])
def test_magic_squares_beyond_int(spark, n):
    first = generate.magic(spark, n).df.limit(8).collect()
    lines, line = generate.magic_lines(n)
    made = {(int(a), int(b)): int(c) for s in (0, 1, lines // 2 - 2) for i, j, v in line(s) for a, b, c in zip(np.broadcast_to(i, j.shape), j, v)}
    assert all(made[r["i"], r["j"]] == r["v"] for r in first) and max(made.values()) > 2**31


def test_distinct_by_maps(spark, monkeypatch):
    monkeypatch.setattr(exact, "BITS", 64)
    monkeypatch.setattr(exact, "MAPS", 2)
    numbers = spark.range(1000).select((F.col("id") * 7 % 500 - 100).alias("v")).unionByName(spark.createDataFrame([(None,), (10**12,), (10**12,)], "v bigint"))
    assert exact.distinct(numbers, "v").first()[0] == 501
    assert exact.distinct(numbers.where("v > 10"), "v").where("different = 390").count() == 1
    assert exact.distinct(numbers.limit(0), "v").first()[0] == 0
    plan = exact.distinct(numbers, "v")._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan


def test_many_keys_start_no_group_each(spark):
    """A key's cells may be in two batches, keys may be null or text, and a key that one side lacks has no row."""
    cells = spark.range(3000).select(F.when(F.col("id") > 5, F.concat(F.lit("k"), F.col("id"))).alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("id").cast("double").alias("v")).where("id <> 3 and (id > 5 or id = 0)")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        wide = cells.unionByName(cells.withColumn("j", F.lit(1)))
        made = batched.apply(wide, "key", 1, 2, lambda a: {"sum": a.sum(keepdims=True), "two": 2 * a})
        assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
        got = {(r["key"], r["factor"], r["j"]): r["re"] for r in made.collect()}
        assert len(got) == 3 * 2995 and got["k77", "sum", 0] == 154 and got["k77", "two", 1] == 154 and got[None, "sum", 0] == 0
        pair = batched.apply_pair(wide, cells.where("key < 'k2'"), "key", (1, 2), (1, 1), lambda a, b: a * b)
        found = {(r["key"], r["j"]): r["re"] for r in pair.collect()}
        assert found["k17", 1] == 289 and all(k and k < "k2" for k, _ in found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
