"""Products: joins on the inner index and sums over it."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.matrix import Matrix

#: Order of the blocks that meet in products.
BLOCK = 256
#: Columns that rows may have, and cells that a small factor or a Gram matrix may have, to be held by every task.
MOST_COLUMNS, MOST_SMALL = 1024, 1024 * 1024


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """A·B by blocks; where A's rows are at hand and B is small and narrow by its shape, B is sent to the rows instead."""
    if a.n != b.m:
        raise ValueError(f"product of shapes {a.shape} and {b.shape}")
    if a.packed is not None and max(a.n, b.n) <= MOST_COLUMNS and b.numel() <= MOST_SMALL:
        from gridloom.operators import linalg

        return linalg.times(a, linalg.small(b))
    return multiply_blocked(a, b)


def multiply_blocked(a: Matrix, b: Matrix, block: int | None = None) -> Matrix:
    """A·B by blocks, which meet by inner and outer index; each pair is one dense product. Blocks of narrow factors are larger for larger products."""
    from gridloom.operators.blocks import Blocked, side

    block = block or (side(max(a.m, b.n)) if a.n <= BLOCK else BLOCK)
    return Blocked.of(a, block).product_cells(Blocked.of(b, block))


def gram(a: Matrix) -> Matrix:
    """AᵀA: every task sums the products of its own rows, and only these small sums are shuffled."""
    if a.n > MOST_COLUMNS:
        return multiply_blocked(a.T(), a)
    from gridloom.operators import linalg

    return _row_products(linalg.rows_of(a).select("r", F.col("r").alias("s")), a.n, a.n)


def t_mul(a: Matrix, b: Matrix) -> Matrix:
    """AᵀB without a transpose: rows meet on their own index."""
    if a.m != b.m:
        raise ValueError(f"product of shapes {a.shape[::-1]} and {b.shape}")
    if max(a.n, b.n) > MOST_COLUMNS:
        return multiply_blocked(a.T(), b)
    from gridloom.operators import linalg

    both = linalg.rows_of(a).join(linalg.rows_of(b).select("i", F.col("r").alias("s")), "i")
    return _row_products(both.select("r", "s"), a.n, b.n)


def _row_products(rows: DataFrame, m: int, n: int) -> Matrix:
    """The sum over rows of rᵀ·s, of m x n."""
    from gridloom.operators import linalg

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, n))
        for batch in batches:
            x, y = linalg._stacked(batch.column(0), m), linalg._stacked(batch.column(1), n)
            total += x.T @ y
        i, j = np.indices((m, n)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    return Matrix(rows.mapInArrow(partial, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")), m, n)


def mul_t(a: Matrix, b: Matrix) -> Matrix:
    """ABᵀ."""
    return multiply(a, b.T())


def gemm(alpha: float, a: Matrix, b: Matrix, beta: float, c: Matrix) -> Matrix:
    return _pair(a, b) * alpha + c * beta


def _pair(a: Matrix, b: Matrix) -> Matrix:
    """A·B, where A may be a transposed matrix whose rows are at hand: then its rows meet B's, or its own."""
    if a.untransposed is not None and a.untransposed.packed is not None and max(a.m, b.n) <= MOST_COLUMNS and b.packed is not None:
        return gram(b) if a.untransposed.packed is b.packed else t_mul(a.untransposed, b)
    return multiply(a, b)


def chain(*parts: Matrix) -> Matrix:
    """A product of many, in the order of least multiplications."""

    @functools.cache
    def best(a: int, b: int) -> tuple[int, int]:
        if a == b:
            return 0, a
        return min((best(a, k)[0] + best(k + 1, b)[0] + parts[a].m * parts[k].n * parts[b].n, k) for k in range(a, b))

    def build(a: int, b: int) -> Matrix:
        return parts[a] if a == b else _pair(build(a, best(a, b)[1]), build(best(a, b)[1] + 1, b))

    return build(0, len(parts) - 1)


def power(a: Matrix, p: int) -> Matrix:
    """A whole, non-negative power, by repeated squaring."""
    from gridloom.sources import generate

    if a.m != a.n:
        raise ValueError("power of a matrix that is not square")
    if p < 0:
        raise ValueError("a negative power is the power of linalg.inverse()")
    out = None
    while p:
        if p & 1:
            out = a if out is None else multiply(out, a)
        a, p = (multiply(a, a), p >> 1) if p > 1 else (a, 0)
    return out if out is not None else generate.eye(a.spark, a.n)


def kron(a: Matrix, b: Matrix) -> Matrix:
    """Kronecker product: every cell of A beside every cell of B is the result itself."""
    left = a.df.select(F.col("i").alias("p"), F.col("j").alias("q"), F.col("v").alias("x"))
    both = left.crossJoin(b.df)
    cells = both.select((F.col("p") * b.m + F.col("i")).alias("i"), (F.col("q") * b.n + F.col("j")).alias("j"), (F.col("x") * F.col("v")).alias("v"))
    return Matrix(cells, a.m * b.m, a.n * b.n)


def cross(a: Matrix, b: Matrix) -> Matrix:
    """Cross product of two vectors of three elements."""
    if a.numel() != 3 or b.numel() != 3:
        raise ValueError("cross product of other than three elements")
    flat = lambda m, c: m.df.select((F.col("i") * m.n + F.col("j")).alias("k"), F.col("v").alias(c))
    parts = []
    for p, q, s in ((1, 2, 1.0), (2, 1, -1.0)):
        x = flat(a, "x").select(F.pmod(F.col("k") - p, F.lit(3)).alias("k"), "x")
        y = flat(b, "y").select(F.pmod(F.col("k") - q, F.lit(3)).alias("k"), "y")
        parts.append(x.join(y, "k").select("k", (F.col("x") * F.col("y") * s).alias("v")))
    out = parts[0].unionByName(parts[1]).groupBy("k").agg(F.sum("v").alias("v"))
    zero = F.lit(0).cast("bigint")
    cells = out.select(F.col("k").alias("i"), zero.alias("j"), "v") if a.n == 1 else out.select(zero.alias("i"), F.col("k").alias("j"), "v")
    return Matrix(cells, *a.shape)
