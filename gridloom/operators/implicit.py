"""QR of a tall matrix whose Q is never formed.

Row blocks are reduced to triangular factors, which are stacked by ``FAN_IN`` and reduced again, up to one. Every
node of this tree keeps its reflectors, as LAPACK packs them, in a written table a level. Qᵀ·B goes up the tree: a
node applies its reflectors and hands the rows that its triangle stands for to its parent, while the others stay.
Q·Y comes down the same way. Neither forms Q, and orthogonality does not depend on A's condition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.shared import materialize
from gridloom.operators.blocks import Blocked, each
from gridloom.operators.matrix import Matrix

#: Rows of a leaf, and triangles that one node stacks.
ROWS, FAN_IN = 4096, 8

_NODES = "p bigint, sizes array<bigint>, h array<double>, tau array<double>, r array<double>"
_PART = "p bigint, x array<double>"


def _reduced(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reflectors below the diagonal, their factors, the triangle) of a node's rows."""
    h, tau = np.linalg.qr(x, mode="raw")
    packed = np.ascontiguousarray(h.T)
    return packed, tau, np.triu(packed)[: min(x.shape)]


def _apply(h: np.ndarray, tau: np.ndarray, n: int, b: np.ndarray, transposed: bool) -> np.ndarray:
    """Qᵀ·B or Q·B of one node: I - V·T·Vᵀ with all its reflectors at once."""
    h = h.reshape(-1, n)
    k = len(tau)
    v = np.tril(h[:, :k], -1)
    v[np.arange(k), np.arange(k)] = 1.0
    v[:, tau == 0] = 0.0
    inner = np.triu(v.T @ v, 1)
    inner[np.arange(k), np.arange(k)] = 1 / np.where(tau == 0, 1.0, tau)
    return b - v @ np.linalg.solve(inner.T if transposed else inner, v.T @ b)


@dataclass(frozen=True)
class ImplicitQR:
    """A = Q·R, with the reflectors of every level, from the leaves up."""

    levels: list[DataFrame]
    m: int
    n: int
    rows: int

    def triangle(self) -> DataFrame:
        """R, of min(m, n) rows, as one row."""
        return self.levels[-1].select("r")

    def r(self) -> Matrix:
        """R's cells."""
        at = self.triangle().select(F.posexplode("r").alias("k", "v"))
        return Matrix(at.select(F.floor(F.col("k") / self.n).cast("bigint").alias("i"), (F.col("k") % self.n).cast("bigint").alias("j"), "v"), min(self.m, self.n), self.n)

    def up(self, b: Matrix) -> tuple[DataFrame, list[DataFrame]]:
        """Qᵀ·B: the rows that belong to R as one row (x), and for every level what stays at its nodes (p, x)."""
        if b.m != self.m:
            raise ValueError("sides of different heights")
        width, now, stay, n = b.n, _leaves(b, self.rows), [], self.n
        for level in self.levels:
            def node(p, x, h, tau):
                made = _apply(h, tau, n, x.reshape(-1, width), True)
                return [(p, len(tau), made)]

            done = materialize(each(now.join(level, "p"), ["p", "x", "h", "tau"], node, "p bigint, k bigint, x array<double>"), "q-up")
            stay.append(done.select("p", F.slice("x", F.col("k").cast("int") * width + 1, F.size("x")).alias("x")))
            head = done.select("p", F.slice("x", F.lit(1), F.col("k").cast("int") * width).alias("x"))
            now = _stacked(head, "x")
        return head.select("x"), stay

    def down(self, top: DataFrame, stay: list[DataFrame] | None, width: int) -> Matrix:
        """Q·Y for Y as ``up`` gives it; with nothing at the nodes, of the columns of Q that belong to R."""
        now, n = top.select(F.lit(0).cast("bigint").alias("p"), "x"), self.n
        for k in range(len(self.levels) - 1, -1, -1):
            held = self.levels[k].join(now, "p")
            held = held.join(stay[k].withColumnRenamed("x", "rest"), "p", "left") if stay else held.withColumn("rest", F.lit(None).cast("array<double>"))

            def node(p, sizes, h, tau, x, rest) -> Iterator[tuple]:
                whole = np.zeros((len(h) // n, width))
                whole[: len(tau)] = x.reshape(-1, width)
                if rest is not None:
                    whole[len(tau) :] = rest.reshape(-1, width)
                made, at = _apply(h, tau, n, whole, False), 0
                for c, size in enumerate(sizes.tolist()):
                    yield p * FAN_IN + c if k else p, made[at : at + size]
                    at += size

            now = materialize(each(held, ["p", "sizes", "h", "tau", "x", "rest"], node, _PART), "q-down")
        cells = now.select("p", F.posexplode("x").alias("k", "v"))
        i = F.col("p") * self.rows + F.floor(F.col("k") / width)
        return Matrix(cells.select(i.cast("bigint").alias("i"), (F.col("k") % width).cast("bigint").alias("j"), "v"), self.m, width)

    def least_squares(self, b: Matrix) -> tuple[Matrix, list[float]]:
        """(X with least ‖A·X - B‖ for A of full column rank, the residual's norm for each column of B)."""
        if self.m < self.n:
            raise ValueError("under-determined")
        m, n, width = self.m, self.n, b.n
        top, stay = self.up(b)

        def back(r, x):
            r = r.reshape(n, n)
            if np.abs(np.diag(r)).min() <= max(m, n) * np.finfo(float).eps * np.abs(r).max():
                raise ArithmeticError("columns depend on each other")
            return [(0, np.linalg.solve(r, x.reshape(n, width)))]

        one = F.lit(1).alias("one")
        solved = each(self.triangle().select("r", one).join(top.select("x", one), "one"), ["r", "x"], back, _PART)
        at = solved.select(F.posexplode("x").alias("k", "v"))
        found = Matrix(at.select(F.floor(F.col("k") / width).cast("bigint").alias("i"), (F.col("k") % width).cast("bigint").alias("j"), "v"), n, width)
        left = [s.select(F.posexplode("x").alias("k", "v")).select((F.col("k") % width).alias("j"), "v") for s in stay]
        every = left[0]
        for more in left[1:]:
            every = every.unionByName(more)
        sums = dict(every.groupBy("j").agg(F.sum(F.col("v") * F.col("v"))).collect())
        return found, [float(np.sqrt(sums.get(j, 0.0))) for j in range(width)]


def _leaves(a: Matrix, rows: int) -> DataFrame:
    """(p, x): row blocks, each in one task; the blocks of a ``Blocked`` one block wide."""
    if a.packed is None:
        from gridloom.operators import linalg

        a = Matrix(a.df, a.m, a.n, packed=linalg.rows_of(a))
    return Blocked.of(a, max(rows, a.n)).df.select("p", "x") if rows >= a.n else _cut(a, rows)


def _cut(a: Matrix, rows: int) -> DataFrame:
    """The same for leaves of fewer rows than A has columns."""
    held = a.packed.groupBy(F.floor(F.col("i") / rows).cast("bigint").alias("p")).agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("m"))
    return held.select("p", F.flatten(F.transform("m", lambda m: m["r"])).alias("x"))


def _stacked(parts: DataFrame, name: str) -> DataFrame:
    """What the children of a node hand it, in their order."""
    up = parts.groupBy(F.floor(F.col("p") / FAN_IN).cast("bigint").alias("up")).agg(F.sort_array(F.collect_list(F.struct("p", name))).alias("m"))
    return up.select(F.col("up").alias("p"), F.flatten(F.transform("m", lambda m: m[name])).alias(name))


def qr(a: Matrix, rows: int = ROWS) -> ImplicitQR:
    """The tree of A's row blocks of ``rows`` rows, of which there is at least one."""
    n = a.n
    if a.empty():
        raise ValueError("QR of an empty matrix")

    def leaf(p, x):
        x = x.reshape(-1, n)
        h, tau, r = _reduced(x, n)
        return [(p, np.array([len(x)]), h, tau, r)]

    levels = [materialize(each(_leaves(a, rows), ["p", "x"], leaf, _NODES), "q-tree")]
    while (levels[-1].agg(F.max("p")).first()[0] or 0) > 0:
        up = levels[-1].groupBy(F.floor(F.col("p") / FAN_IN).cast("bigint").alias("up")).agg(F.sort_array(F.collect_list(F.struct("p", "r"))).alias("m"))
        up = up.select(F.col("up").alias("p"), F.transform("m", lambda m: (F.size(m["r"]) / n).cast("bigint")).alias("sizes"), F.flatten(F.transform("m", lambda m: m["r"])).alias("x"))

        def node(p, sizes, x):
            h, tau, r = _reduced(x.reshape(-1, n), n)
            return [(p, sizes, h, tau, r)]

        levels.append(materialize(each(up, ["p", "sizes", "x"], node, _NODES), "q-tree"))
    return ImplicitQR(levels, a.m, n, rows)
