"""Linear algebra of tall matrices, by orthogonal factors of parts of their rows.

A tall matrix has any number of rows and up to ``MOST_COLUMNS`` columns. Every partition reduces
its rows to the triangular factor of their QR, factors are stacked and reduced again, and the last
one, of n x n, reaches the driver. It has A's singular values, null space, rank and least squares
to working precision: the condition is not squared, as it would be by the Gram matrix. Q, U and
residuals are products with small matrices that stay distributed. Square matrices of any order are
solved and inverted by block LU (``blocks``); Q that is never formed is in ``implicit``; tables of many small
matrices are in ``batched``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.shared import materialize
from gridloom.operators.matrix import CELLS, COL, Matrix
from gridloom.operators.products import t_mul

#: Columns of a tall matrix; a triangular factor has the square of this many cells on the driver.
MOST_COLUMNS = 1024
#: Triangular factors that one task stacks, and rows that it stacks on a factor at once.
FAN_IN, STACKED = 8, 4096

EPS = 2.0**-52


def small(a: Matrix) -> np.ndarray:
    """A matrix of bounded size on the driver."""
    if a.numel() > MOST_COLUMNS**2:
        raise ValueError(f"{a.shape} is beyond {MOST_COLUMNS} x {MOST_COLUMNS}")
    out = np.zeros(a.shape)
    for i, j, v in a.df.select("i", "j", "v").collect():
        out[i, j] = v
    return out


def lift(a: Matrix, x: np.ndarray) -> Matrix:
    """A small array as a matrix in the session of ``a``."""
    cells = [(int(i), int(j), float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])]
    return Matrix(a.spark.createDataFrame(cells, CELLS), *x.shape)


# --- rows ---------------------------------------------------------------------------------------


def rows_of(a: Matrix) -> DataFrame:
    """(i, r): a row's elements as one array. Matrices that were read as rows have them; others meet by row."""
    if a.n > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    if a.packed is not None:
        return a.packed
    cells = F.array_sort(F.collect_list(F.struct("j", "v")))
    return a.df.groupBy("i").agg(F.transform(cells, lambda c: c["v"]).alias("r"))


def of_rows(rows: DataFrame, m: int, n: int) -> Matrix:
    cells = rows.select("i", F.posexplode("r").alias("j", "v"))
    return Matrix(cells.select("i", F.col("j").cast("bigint").alias("j"), "v"), m, n, packed=rows)


def times(a: Matrix, x: np.ndarray) -> Matrix:
    """A·X for a small X, row by row: nothing is shuffled if A's rows are at hand."""
    width, box = x.shape[1], a.spark.sparkContext.broadcast(np.ascontiguousarray(x, dtype=float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _stacked(batch.column(1), len(box.value)) @ box.value
            offsets = pa.array(np.arange(0, made.size + 1, width, dtype=np.int32) if width else np.zeros(len(made) + 1, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], names=["i", "r"])

    return of_rows(rows_of(a).mapInArrow(run, "i bigint, r array<double>"), a.m, width)


def _stacked(lists: pa.ListArray, n: int) -> np.ndarray:
    """Rows as one array; a row of another length would shift all that follow."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(lists) * n or len(lists) and (np.diff(lists.offsets.to_numpy()) != n).any():
        raise ValueError(f"a row has other than {n} elements")
    return flat.reshape(-1, n)


def _reduce(n: int, x: np.ndarray, held: np.ndarray) -> np.ndarray:
    for at in range(0, len(x), STACKED):
        held = np.linalg.qr(np.vstack([held, x[at : at + STACKED]]), mode="r")
    return held


def triangle(rows: DataFrame, n: int) -> np.ndarray:
    """The triangular factor, of at most n rows, of all ``r`` of ``rows``, with a non-negative diagonal.

    Each level leaves one factor a partition, and then one for ``FAN_IN`` of the level before.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = np.zeros((0, n))
        for batch in batches:
            held = _reduce(n, _stacked(batch.column(0), n), held)
        yield _as_batch(TaskContext.get().partitionId(), held)

    def _as_batch(part: int, held: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, held.size + 1, n, dtype=np.int32)), pa.array(held.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), part, np.int64)), lists], names=["p", "r"])

    def again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = np.zeros((0, n)), 0
        for batch in parts:
            part = batch.column(0)[0].as_py() // FAN_IN if batch.num_rows else part
            # A row here is a stack of factors.
            held = _reduce(n, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n), held)
        yield _as_batch(part, held)

    level = materialize(rows.select("r").mapInArrow(fold, "p bigint, r array<double>"), "triangles")
    while (level.agg(F.max("p")).first()[0] or 0) >= FAN_IN:
        groups = level.withColumn("g", F.floor(F.col("p") / FAN_IN))
        stacked = groups.groupBy("g").agg(F.min("p").alias("p"), F.flatten(F.collect_list("r")).alias("r")).select("p", "r")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from again(iter([pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1)], names=["p", "r"])]))

        level = materialize(stacked.mapInArrow(each, "p bigint, r array<double>"), "triangles")
    held = np.array([r["r"] for r in level.select("r").collect()], dtype=float).reshape(-1, n)
    r = np.linalg.qr(held, mode="r")
    return np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] * r if len(r) else r


def _triangle(a: Matrix) -> np.ndarray:
    return triangle(rows_of(a), a.n)


def _beside(a: Matrix, b: Matrix) -> np.ndarray:
    """The triangular factor of A and B side by side."""
    both = rows_of(a).join(rows_of(b).select("i", F.col("r").alias("s")), "i").select("i", F.concat("r", "s").alias("r"))
    return triangle(both, a.n + b.n)


# --- factorisations -----------------------------------------------------------------------------


def qr(a: Matrix) -> tuple[Matrix, np.ndarray]:
    """(Q distributed, R small) with a non-negative diagonal; full column rank is needed.

    Q is A·R⁻¹, made orthogonal to working precision by the same step once more.
    """
    if a.m < a.n:
        raise ValueError("more columns than rows")
    first = _triangle(a)
    if len(first) < a.n or np.abs(np.diag(first)).min() <= max(a.shape) * EPS * np.abs(first).max():
        raise ArithmeticError("columns depend on each other; use qr_pivoted()")
    q = times(a, np.linalg.inv(first))
    second = _triangle(q)
    return times(a, np.linalg.inv(second @ first)), second @ first


def pivoted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Q, R, P) with X·P = Q·R: each step reflects the column that is longest below the rows done."""
    from gridloom.operators import batched

    made = batched.qr_pivoted(x)
    return made["Q"], made["R"], made["P"]


def qr_pivoted(a: Matrix) -> tuple[Matrix, np.ndarray, np.ndarray]:
    """(Q distributed, R, P small) with A·P = Q·R, the diagonal of R falling; Q has as many columns as A has rank."""
    _, r, p = pivoted(_triangle(a))
    d = np.abs(np.diag(r))
    k = int((d > max(a.shape) * EPS * d.max(initial=0.0)).sum())
    q = times(a, p[:, :k] @ np.linalg.inv(r[:k, :k]))
    again = _triangle(q)
    return times(q, np.linalg.inv(again)), again @ r[:k], p


def _tall(a: Matrix) -> Matrix:
    return a if a.m >= a.n else a.T()


def svdvals(a: Matrix) -> list[float]:
    return np.linalg.svd(_triangle(_tall(a)), compute_uv=False).tolist()


def _right(a: Matrix) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and all right vectors of A."""
    _, s, vt = np.linalg.svd(_triangle(a))
    return np.append(s, np.zeros(a.n - len(s))), vt.T


def _kept(a: Matrix, s: np.ndarray, tol: float = -1.0) -> np.ndarray:
    return s > (tol if tol >= 0 else max(a.shape) * EPS * s.max(initial=0.0))


def svd(a: Matrix) -> tuple[Matrix, np.ndarray, np.ndarray]:
    """(U distributed, singular values, V small) of the numerically non-zero part."""
    s, v = _right(a)
    keep = _kept(a, s)
    return times(a, v[:, keep] / s[keep]), s[keep], v[:, keep]


def low_rank(a: Matrix, k: int) -> Matrix:
    """The best approximation of rank k: A V Vᵀ with the k leading right vectors."""
    _, v = _right(a)
    return times(a, v[:, :k] @ v[:, :k].T)


def rank(a: Matrix, tol: float = -1.0) -> int:
    return int(_kept(a, np.array(svdvals(a)), tol).sum())


def cond(a: Matrix, kind: str = "two") -> float:
    """two: largest over smallest singular value; one, inf, fro: norm times the inverse's; infinite if singular."""
    if kind == "two":
        s = svdvals(a)
        return float("inf") if s[-1] <= EPS * s[0] * 1e-3 else s[0] / s[-1]
    try:
        return a.norm(kind) * inverse(a).norm(kind)
    except np.linalg.LinAlgError:
        return float("inf")


def null(a: Matrix) -> np.ndarray:
    s, v = _right(a)
    return v[:, ~_kept(a, s)]


def orth(a: Matrix) -> Matrix:
    return svd(a)[0]


def _least(r: np.ndarray, n: int, shape: tuple[int, int]) -> np.ndarray:
    """Least squares of least norm from the factor of A and B side by side."""
    u, s, vt = np.linalg.svd(r[:n, :n], full_matrices=False)
    keep = s > max(shape) * EPS * s.max(initial=0.0)
    return vt[keep].T @ ((u[:, keep].T @ r[: len(u), n:]) / s[keep][:, None])


def solve(a: Matrix, b: Matrix) -> Matrix:
    """By block LU for square A of any order, which must not be singular; least squares, of least norm, for tall A of any rank."""
    if a.m != b.m:
        raise ValueError("sides of different heights")
    if a.m < a.n:
        raise ValueError("under-determined")
    if a.m == a.n:
        from gridloom.operators import blocks

        return blocks.solve(blocks.Blocked.of(a), blocks.Blocked.of(b)).to_matrix()
    return lift(a, _least(_beside(a, b), a.n, a.shape))


def lsqminnorm(a: Matrix, b: Matrix) -> np.ndarray:
    """pinv(A)·B, small, for any shape and rank."""
    if a.m >= a.n:
        return _least(_beside(a, b), a.n, a.shape)
    s, v = _right(a)
    keep = _kept(a, s)
    return v[:, keep] / s[keep] ** 2 @ v[:, keep].T @ small(t_mul(a, b))


pinv_times = lsqminnorm


def right_divide(a: Matrix, b: Matrix) -> Matrix:
    """X with X·B = A."""
    return solve(b.T(), a.T()).T()


def inverse(a: Matrix) -> Matrix:
    from gridloom.operators import blocks

    a._square("inverse")
    return blocks.inverse(blocks.Blocked.of(a)).to_matrix()


def power(a: Matrix, p: int) -> Matrix:
    """A whole power; negative ones of the inverse."""
    from gridloom.operators import products

    return products.power(a, p) if p >= 0 else products.power(inverse(a), -p)


def det(a: Matrix) -> float:
    from gridloom.operators import blocks

    a._square("determinant")
    sign, log = blocks.log_det(blocks.lu(blocks.Blocked.of(a)))
    return float(sign * np.exp(log))


def normest(a: Matrix, tol: float = 1e-6, most: int = 100) -> float:
    """Largest singular value by power iteration on AᵀA, whose vector alone meets the driver."""
    x = np.ones((a.n, 1)) / np.sqrt(a.n)
    was = 0.0
    for _ in range(most):
        y = small(t_mul(a, times(a, x)))
        now = float(np.sqrt(np.linalg.norm(y)))
        x = y / max(np.linalg.norm(y), 1e-300)
        if abs(now - was) <= tol * now:
            break
        was = now
    return now


def column_norms(a: Matrix) -> Matrix:
    return (a * 1.0).map_elems(lambda v: v * v)._reduce(COL, F.sqrt(F.sum("v")))

