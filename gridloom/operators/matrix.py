"""Matrices as DataFrames of cells.

A ``Matrix`` is a plan that yields cells ``(i, j, v)`` with unique 0-based indices, beside its
shape, which never depends on the data. All operators are lazy and made of joins, groupings and
windows on the indices; nothing is collected but scalars. Members work element by element;
functions of the whole matrix are in ``linalg`` and ``matfun``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import ieee
from gridloom.operators import scans
from gridloom.operators.scans import numbered

ROW, COL = True, False

CELLS = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", T.DoubleType())])


class _Cell:
    """The columns of a cell, made when they are used: a session must be running by then."""

    i = property(lambda _: F.col("i"))
    j = property(lambda _: F.col("j"))
    v = property(lambda _: F.col("v"))


cell = _Cell()


def _index(k: int, n: int, axis: str) -> int:
    if isinstance(k, float):
        raise TypeError("an index is an integer")
    at = k + n if k < 0 else k
    if not 0 <= at < n:
        raise IndexError(f"{axis} {k} is outside [-{n}, {n})")
    return at


class Matrix:
    """A dense matrix of doubles or booleans; see the module.

    ``packed`` are the same elements as rows (i, r), where the matrix was read or made so; products
    and factorisations then need no shuffle to meet by row.
    """

    def __init__(self, df: DataFrame, m: int, n: int, mask: bool = False, packed: DataFrame | None = None):
        if m < 0 or n < 0:
            raise ValueError("a shape is not negative")
        self.df, self.m, self.n, self.mask, self.packed = df, m, n, mask, packed
        self.untransposed: Matrix | None = None

    # --- making ---

    @classmethod
    def of(cls, spark: SparkSession, rows: Sequence[Sequence[float]]) -> Matrix:
        """A small matrix from its rows, which have one length."""
        n = len(rows[0]) if rows else 0
        if any(len(r) != n for r in rows):
            raise ValueError("rows of different lengths")
        cells = [(a, b, float(x)) for a, r in enumerate(rows) for b, x in enumerate(r)]
        return cls(spark.createDataFrame(cells, CELLS), len(rows), n)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def _with(self, value: Column, mask: bool | None = None) -> Matrix:
        return Matrix(self.df.select("i", "j", value.alias("v")), self.m, self.n, self.mask if mask is None else mask)

    def _moved(self, to_i: Column, to_j: Column, m: int, n: int) -> Matrix:
        return Matrix(self.df.select(to_i.cast("bigint").alias("i"), to_j.cast("bigint").alias("j"), "v"), m, n, self.mask)

    # --- shape ---

    @property
    def shape(self) -> tuple[int, int]:
        return self.m, self.n

    def rows(self) -> int:
        return self.m

    def cols(self) -> int:
        return self.n

    def numel(self) -> int:
        return self.m * self.n

    def empty(self) -> bool:
        return self.numel() == 0

    def _need(self, what: str) -> None:
        if self.empty():
            raise ValueError(f"{what} of an empty matrix")

    def _same(self, other: Matrix, what: str) -> None:
        if self.shape != other.shape:
            raise ValueError(f"{what} of shapes {self.shape} and {other.shape}")

    def _square(self, what: str) -> None:
        if self.m != self.n:
            raise ValueError(f"{what} of a matrix that is not square")

    # --- arithmetic ---

    def _zip(self, other: Matrix, f: Callable[[Column, Column], Column], what: str, mask: bool = False) -> Matrix:
        """Cells of equal indices, combined. One shuffle on (i, j) at most; none if both are so partitioned."""
        self._same(other, what)
        both = self.df.withColumnRenamed("v", "a").join(other.df.withColumnRenamed("v", "b"), ["i", "j"])
        return Matrix(both.select("i", "j", f(F.col("a"), F.col("b")).alias("v")), self.m, self.n, mask)

    def __add__(self, o):
        if isinstance(o, Matrix):
            return self._zip(o, lambda a, b: a + b, "sum")
        return self._with(cell.v + F.lit(o)) if isinstance(o, (int, float)) else NotImplemented

    def __sub__(self, o):
        if isinstance(o, Matrix):
            return self._zip(o, lambda a, b: a - b, "difference")
        return self._with(cell.v - F.lit(o)) if isinstance(o, (int, float)) else NotImplemented

    def __radd__(self, k: float):
        return self._with(F.lit(k) + cell.v)

    def __rsub__(self, k: float):
        return self._with(F.lit(k) - cell.v)

    def __neg__(self):
        return self._with(-cell.v)

    def __mul__(self, o):
        if isinstance(o, Matrix):
            from gridloom.operators import products

            return products.multiply(self, o)
        return self._with(cell.v * F.lit(o)) if isinstance(o, (int, float)) else NotImplemented

    def __rmul__(self, k: float):
        return self._with(cell.v * F.lit(k))

    def __truediv__(self, o):
        if isinstance(o, Matrix):
            from gridloom.operators import linalg

            return linalg.right_divide(self, o)
        return self._with(ieee.divide(cell.v, F.lit(float(o))))

    def __mod__(self, o):
        """``%``: Hadamard product with a matrix, truncating remainder with an integer."""
        return self.mul(o) if isinstance(o, Matrix) else self._with(ieee.rem(cell.v, F.lit(float(o))))

    def mul(self, o: Matrix) -> Matrix:
        return self._zip(o, lambda a, b: a * b, "Hadamard product")

    def div(self, o: Matrix) -> Matrix:
        return self._zip(o, ieee.divide, "quotient")

    def emax(self, o: Matrix) -> Matrix:
        return self._zip(o, F.greatest, "maximum")

    def emin(self, o: Matrix) -> Matrix:
        return self._zip(o, F.least, "minimum")

    # --- element-wise functions (one projection each; chains collapse into one) ---

    def __getattr__(self, name: str):
        f = ieee.UNARY.get(name)
        if f is None:
            raise AttributeError(name)
        return lambda: self._with(f(cell.v))

    def pow(self, p: float) -> Matrix:
        return self._with(F.pow(cell.v, F.lit(float(p))))

    def log(self, base: float) -> Matrix:
        return self._with(ieee.log2(cell.v) / F.lit(math.log2(base)))

    def mod(self, y) -> Matrix:
        return self._zip(y, ieee.mod, "mod") if isinstance(y, Matrix) else self._with(ieee.mod(cell.v, F.lit(float(y))))

    def rem(self, y) -> Matrix:
        return self._zip(y, ieee.rem, "rem") if isinstance(y, Matrix) else self._with(ieee.rem(cell.v, F.lit(float(y))))

    def atan2(self, x: Matrix) -> Matrix:
        return self._zip(x, F.atan2, "atan2")

    def hypot(self, x: Matrix) -> Matrix:
        return self._zip(x, F.hypot, "hypot")

    def map_elems(self, f: Callable[[Column], Column]) -> Matrix:
        """``f`` of every element, as a Column expression (a pandas UDF for opaque functions)."""
        return self._with(f(cell.v))

    def zip_elems(self, o: Matrix, f: Callable[[Column, Column], Column]) -> Matrix:
        return self._zip(o, f, "zip")

    def fill(self, value: float) -> Matrix:
        return self._with(F.lit(float(value)))

    def spy(self, tol: float = 0.0) -> Matrix:
        """1 where the magnitude is above ``tol``, else 0."""
        return self._with(F.when(F.abs(cell.v) > tol, 1.0).otherwise(0.0))

    def lazy(self):
        """A deferred element-wise expression of this matrix."""
        from gridloom.operators.lazy import Expr

        return Expr.of(self)

    # --- comparisons, masks ---

    def _compare(self, op: str, o) -> Matrix:
        if isinstance(o, Matrix):
            return self._zip(o, functools.partial(ieee.compare, op), "comparison", True)
        return self._with(ieee.compare(op, cell.v, F.lit(o)), True)

    def lt(self, o):
        return self._compare("lt", o)

    def gt(self, o):
        return self._compare("gt", o)

    def le(self, o):
        return self._compare("le", o)

    def ge(self, o):
        return self._compare("ge", o)

    def eq(self, o):
        return self._compare("eq", o)

    def ne(self, o):
        return self._compare("ne", o)

    __lt__, __gt__, __le__, __ge__ = lt, gt, le, ge

    def land(self, o: Matrix) -> Matrix:
        return self._zip(o, lambda a, b: ieee.truth(a) & ieee.truth(b), "and", True)

    def lor(self, o: Matrix) -> Matrix:
        return self._zip(o, lambda a, b: ieee.truth(a) | ieee.truth(b), "or", True)

    def lxor(self, o: Matrix) -> Matrix:
        return self._zip(o, lambda a, b: ieee.truth(a) != ieee.truth(b), "xor", True)

    def lnot(self) -> Matrix:
        return self._with(~ieee.truth(cell.v), True)

    __and__, __or__, __xor__, __invert__ = land, lor, lxor, lnot

    def equals(self, o: Matrix) -> bool:
        """Whole-matrix equality: false for other shapes, and for any NaN."""
        return self.shape == o.shape and self.eq(o).all()

    def allclose(self, o: Matrix, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
        if self.shape != o.shape:
            return False
        near = lambda a, b: ieee.compare("le", F.abs(a - b), atol + rtol * F.abs(b)) | ieee.compare("eq", a, b)
        return self._zip(o, near, "allclose", True).all()

    def any(self, axis: bool | None = None):
        if axis is not None:
            return self._reduce(axis, F.bool_or(ieee.truth(cell.v)), mask=True)
        return bool(self.df.select(F.coalesce(F.bool_or(ieee.truth(cell.v)), F.lit(False))).first()[0])

    def all(self, axis: bool | None = None):
        if axis is not None:
            return self._reduce(axis, F.bool_and(ieee.truth(cell.v)), mask=True)
        return bool(self.df.select(F.coalesce(F.bool_and(ieee.truth(cell.v)), F.lit(True))).first()[0])

    def nnz(self) -> int:
        return self.df.where(ieee.truth(cell.v)).count()

    def find(self) -> DataFrame:
        """(i, j) of the non-zeros, in row-major order."""
        return self.df.where(ieee.truth(cell.v)).select("i", "j").orderBy("i", "j")

    def select_where(self, mask: Matrix) -> Matrix:
        """A(mask): the marked elements in row-major order, as a column."""
        self._same(mask, "mask")
        kept = self.df.join(mask.df.where(ieee.truth(cell.v)).select("i", "j"), ["i", "j"])
        ranked = numbered(kept, ["i", "j"])
        return Matrix(ranked.select(F.col("rank").alias("i"), F.lit(0).cast("bigint").alias("j"), "v"), mask.nnz(), 1)

    def put_where(self, mask: Matrix, value) -> Matrix:
        """A(mask) = scalar, or = a vector of as many elements, in row-major order."""
        self._same(mask, "mask")
        marked = mask.df.select("i", "j", ieee.truth(cell.v).alias("k"))
        if not isinstance(value, Matrix):
            both = self.df.join(marked, ["i", "j"])
            return Matrix(both.select("i", "j", F.when(F.col("k"), F.lit(float(value))).otherwise(cell.v).alias("v")), self.m, self.n)
        if value.numel() != mask.nnz():
            raise ValueError("as many values as marked elements are needed")
        places = numbered(marked.where("k"), ["i", "j"]).select("i", "j", "rank")
        new = value.df.select((cell.i * value.n + cell.j).alias("rank"), F.col("v").alias("w"))
        both = self.df.join(places.join(new, "rank").drop("rank"), ["i", "j"], "left")
        return Matrix(both.select("i", "j", F.coalesce("w", "v").alias("v")), self.m, self.n)

    # --- element access ---

    def at(self, a: int, b: int) -> float:
        a, b = _index(a, self.m, "row"), _index(b, self.n, "column")
        return self.df.where((cell.i == a) & (cell.j == b)).first()["v"]

    def flat(self, k: int) -> float:
        k = _index(k, self.numel(), "element")
        return self.at(k // self.n, k % self.n)

    def scalar(self) -> float:
        if self.shape != (1, 1):
            raise ValueError("only a 1x1 matrix is a scalar")
        return self.at(0, 0)

    def row(self, a: int) -> Matrix:
        a = _index(a, self.m, "row")
        return Matrix(self.df.where(cell.i == a), self.m, self.n, self.mask)._moved(F.lit(0), cell.j, 1, self.n)

    def col(self, b: int) -> Matrix:
        b = _index(b, self.n, "column")
        out = Matrix(self.df.where(cell.j == b), self.m, self.n, self.mask)._moved(cell.i, F.lit(0), self.m, 1)
        out.packed = self._sliced(b, b)
        return out

    def _sliced(self, c1: int, c2: int) -> DataFrame | None:
        """The rows' columns from c1 to c2, if rows are at hand."""
        return None if self.packed is None else self.packed.select("i", F.slice("r", c1 + 1, c2 - c1 + 1).alias("r"))

    def block(self, rows: tuple[int, int], cols: tuple[int, int]) -> Matrix:
        """Both ends included; a reversed range walks backward."""
        (r1, r2), (c1, c2) = [tuple(_index(k, n, w) for k in x) for x, n, w in ((rows, self.m, "row"), (cols, self.n, "column"))]
        inside = cell.i.between(min(r1, r2), max(r1, r2)) & cell.j.between(min(c1, c2), max(c1, c2))
        to_i, to_j = (cell.i - r1 if r1 <= r2 else r1 - cell.i), (cell.j - c1 if c1 <= c2 else c1 - cell.j)
        out = Matrix(self.df.where(inside), self.m, self.n, self.mask)._moved(to_i, to_j, abs(r2 - r1) + 1, abs(c2 - c1) + 1)
        if (r1, r2) == (0, self.m - 1) and c1 <= c2:
            out.packed = self._sliced(c1, c2)
        return out

    def put_block(self, a: int, b: int, o: Matrix) -> Matrix:
        """A copy with ``o`` written at (a, b)."""
        if a < 0 or b < 0 or a + o.m > self.m or b + o.n > self.n:
            raise IndexError("the block is outside")
        moved = o.df.select((cell.i + a).alias("i"), (cell.j + b).alias("j"), F.col("v").alias("w"))
        both = self.df.join(moved, ["i", "j"], "left")
        inside = cell.i.between(a, a + o.m - 1) & cell.j.between(b, b + o.n - 1)
        return Matrix(both.select("i", "j", F.when(inside, F.col("w")).otherwise(cell.v).alias("v")), self.m, self.n)

    def put(self, a: int, b: int, value: float) -> Matrix:
        a, b = _index(a, self.m, "row"), _index(b, self.n, "column")
        return self._with(F.when((cell.i == a) & (cell.j == b), F.lit(float(value))).otherwise(cell.v))

    # --- reductions ---

    def _reduce(self, axis: bool, how: Column, mask: bool = False, empty: float | None = None) -> Matrix:
        """One result per row (ROW) or per column (COL)."""
        m, n = (self.m, 1) if axis == ROW else (1, self.n)
        if self.empty() and empty is None:
            raise ValueError("a reduction of an empty matrix")
        key = "i" if axis == ROW else "j"
        out = self.df.groupBy(key).agg(how.alias("v"))
        zero = F.lit(0).cast("bigint")
        return Matrix(out.select("i", zero.alias("j"), "v") if axis == ROW else out.select(zero.alias("i"), "j", "v"), m, n, mask)

    def _scalar(self, how: Column, what: str) -> float:
        self._need(what)
        return self.df.select(how).first()[0]

    def sum(self, axis: bool | None = None):
        if axis is not None:
            return self._reduce(axis, F.sum(cell.v))
        return self.df.select(F.coalesce(F.sum(cell.v), F.lit(0.0))).first()[0]

    def prod(self, axis: bool | None = None):
        return self._scalar(F.product(cell.v), "product") if axis is None else self._reduce(axis, F.product(cell.v))

    def min(self, axis: bool | None = None):
        return self._scalar(F.min(cell.v), "minimum") if axis is None else self._reduce(axis, F.min(cell.v))

    def max(self, axis: bool | None = None):
        return self._scalar(F.max(cell.v), "maximum") if axis is None else self._reduce(axis, F.max(cell.v))

    def mean(self, axis: bool | None = None):
        return self._scalar(F.avg(cell.v), "mean") if axis is None else self._reduce(axis, F.avg(cell.v))

    def var(self, sample: bool = False) -> float:
        return self._scalar(F.var_samp(cell.v) if sample else F.var_pop(cell.v), "variance")

    def stddev(self, sample: bool = False) -> float:
        return math.sqrt(self.var(sample))

    def median(self, axis: bool | None = None):
        """The middle value, the mean of both for an even count. Long lines are counted by ranges, not gathered or sorted."""
        from gridloom.operators import exact

        if axis is None:
            self._need("median")
            return exact.median(self.df, "v").first()["median"]
        _, stay, n = self._along(axis)
        if n <= scans.BLOCK:
            return self._reduce(axis, F.median(cell.v))
        made = exact.median(self.df, "v", [stay]).withColumnRenamed("median", "v")
        none = F.lit(0).cast("bigint")
        if axis == ROW:
            return Matrix(made.select("i", none.alias("j"), "v"), self.m, 1)
        return Matrix(made.select(none.alias("i"), "j", "v"), 1, self.n)

    def mode(self) -> float:
        """The most frequent value, the smallest among ties."""
        self._need("mode")
        return self.df.groupBy("v").count().orderBy(F.desc("count"), "v").first()["v"]

    def argmin(self, flat: bool = False) -> tuple[int, int] | int:
        """The first place of the least value in row-major order, as a pair or as a flat index."""
        self._need("argmin")
        i, j = self.df.select(F.min(F.struct("v", "i", "j")).alias("x")).select("x.i", "x.j").first()
        return i * self.n + j if flat else (i, j)

    def argmax(self, flat: bool = False) -> tuple[int, int] | int:
        self._need("argmax")
        i, j = self.df.select(F.min(F.struct((-cell.v).alias("w"), "i", "j")).alias("x")).select("x.i", "x.j").first()
        return i * self.n + j if flat else (i, j)

    def trace(self) -> float:
        self._square("trace")
        return Matrix(self.df.where("i = j"), self.m, self.n)._scalar(F.sum(cell.v), "trace")

    def dot(self, o: Matrix) -> float:
        return self.mul(o).sum()

    def norm(self, kind: str = "fro") -> float:
        """fro (scaled against overflow), one, inf or two."""
        if self.empty():
            return 0.0
        if kind == "fro":
            top = self._scalar(F.max(F.abs(cell.v)), "norm")
            if top == 0 or math.isinf(top) or math.isnan(top):
                return top
            return top * math.sqrt(self.df.select(F.sum(F.pow(cell.v / top, F.lit(2.0)))).first()[0])
        if kind in ("one", "inf"):
            return self.abs().sum(ROW if kind == "inf" else COL).max()
        from gridloom.operators import linalg

        return linalg.svdvals(self)[0]

    def trapz(self, axis: bool | None = None):
        """Trapezoids at unit spacing: the sum less half of both ends."""
        if axis is None:
            axis = ROW if self.m == 1 else COL
            return self.trapz(axis).scalar() if 1 in self.shape else None
        key, n = ("j", self.n) if axis == ROW else ("i", self.m)
        if n < 2:
            return self._reduce(axis, F.sum(cell.v * 0.0))
        return self._reduce(axis, F.sum(F.when(F.col(key).isin(0, n - 1), cell.v / 2).otherwise(cell.v)))

    # --- scans: along one axis, in blocks of bounded length ---

    def _along(self, axis: bool) -> tuple[str, str, int]:
        """(index that runs, index that stays, length). ROW runs along each row."""
        return ("j", "i", self.n) if axis == ROW else ("i", "j", self.m)

    def _running(self, axis: bool, how: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Matrix:
        run, stay, n = self._along(axis)
        return Matrix(scans.running(self.df.select("i", "j", "v"), stay, run, n, how, join), self.m, self.n)

    def _with_neighbours(self, axis: bool) -> DataFrame:
        run, stay, n = self._along(axis)
        return scans.with_neighbours(self.df.select("i", "j", "v"), stay, run, n)

    def cumsum(self, axis: bool) -> Matrix:
        return self._running(axis, F.sum, lambda a, b: a + b)

    def cumprod(self, axis: bool) -> Matrix:
        return self._running(axis, F.product, lambda a, b: a * b)

    def diff(self, axis: bool) -> Matrix:
        run, _, n = self._along(axis)
        out = self._with_neighbours(axis).where(F.col(run) < n - 1).select("i", "j", (F.col("after") - cell.v).alias("v"))
        left = max(n - 1, 0)
        return Matrix(out, self.m, left) if axis == ROW else Matrix(out, left, self.n)

    def cumtrapz(self, axis: bool) -> Matrix:
        step = self._with_neighbours(axis).select("i", "j", F.coalesce((cell.v + F.col("before")) / 2, F.lit(0.0)).alias("v"))
        return Matrix(step, self.m, self.n).cumsum(axis)

    def gradient(self, axis: bool, h: float = 1.0) -> Matrix:
        if h == 0:
            raise ValueError("the spacing is zero")
        before, after = F.col("before"), F.col("after")
        inner = (after - before) / (2 * h)
        ends = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after - cell.v) / h).otherwise((cell.v - before) / h)
        return Matrix(self._with_neighbours(axis).select("i", "j", F.coalesce(inner, ends).alias("v")), self.m, self.n)

    def trapz_over(self, x: Matrix) -> float:
        """Trapezoids of these values over the places ``x``, both taken in row-major order."""
        if x.numel() != self.numel():
            raise ValueError("as many places as values are needed")
        flat = lambda a: a.df.select((cell.i * a.n + cell.j).alias("k"), F.col("v").alias("w"))
        both = flat(x).withColumnRenamed("w", "x").join(flat(self).withColumnRenamed("w", "y"), "k").select(F.lit(0).alias("s"), "k", F.struct("x", "y").alias("v"))
        near, v = scans.with_neighbours(both, "s", "k", self.numel()), F.col("v")
        area = (F.col("after")["x"] - v["x"]) * (F.col("after")["y"] + v["y"]) / 2
        return near.agg(F.coalesce(F.sum(area), F.lit(0.0))).first()[0]

    def _automatic(self) -> int:
        """The dimension that transforms run along: a vector's own, a matrix's columns."""
        return 1 if self.m == 1 else 0

    def fftshift(self, both: bool = False) -> Matrix:
        """Half a turn along the automatic dimension, or along both."""
        if both:
            return self.circshift(self.m // 2, 0).circshift(self.n // 2, 1)
        return self.circshift(self.shape[self._automatic()] // 2, self._automatic())

    def ifftshift(self, both: bool = False) -> Matrix:
        if both:
            return self.circshift(-(self.m // 2), 0).circshift(-(self.n // 2), 1)
        return self.circshift(-(self.shape[self._automatic()] // 2), self._automatic())

    def circshift(self, k: int, dim: int = 0) -> Matrix:
        if dim == 0:
            return self._moved(F.pmod(cell.i + k, F.lit(self.m)), cell.j, self.m, self.n) if self.m else self
        return self._moved(cell.i, F.pmod(cell.j + k, F.lit(self.n)), self.m, self.n) if self.n else self

    # --- order ---

    def sort(self, axis: bool, descending: bool = False) -> Matrix:
        """Every row or column by itself. Long ones are ranged over tasks: each has the same length, which gives its ranks."""
        run, stay, n = self._along(axis)
        key = F.desc("v") if descending else F.asc("v")
        if n <= scans.BLOCK:
            rank = F.row_number().over(Window.partitionBy(stay).orderBy(key)) - 1
            out = self.df.select(F.col(stay), rank.cast("bigint").alias(run), "v")
        else:
            out = numbered(self.df.select(stay, "v"), [stay, key]).select(stay, (F.col("rank") - F.col(stay) * n).alias(run), "v")
        return Matrix(out.select("i", "j", "v"), self.m, self.n)

    def sortrows(self, key: int = 0, descending: bool = False) -> Matrix:
        """Stable order of whole rows by one column."""
        key = _index(key, self.n, "column")
        keys = self.df.where(cell.j == key).select("i", F.col("v").alias("k"))
        ranked = numbered(keys, [F.desc("k") if descending else F.asc("k"), "i"]).select("i", "rank")
        return Matrix(self.df.join(ranked, "i").select(F.col("rank").alias("i"), "j", "v"), self.m, self.n)

    # --- structure ---

    def T(self) -> Matrix:  # noqa: N802
        out = self._moved(cell.j, cell.i, self.n, self.m)
        out.untransposed = self
        return out

    H = T

    def reshape(self, m: int, n: int) -> Matrix:
        if m * n != self.numel():
            raise ValueError("a reshape keeps the number of elements")
        k = cell.i * self.n + cell.j
        return self._moved(F.floor(k / n), k % n, m, n) if n else Matrix(self.df, m, n)

    def repmat(self, a: int, b: int) -> Matrix:
        """Every cell is written a x b times, where it is: the copies are the result itself."""
        out = self.df.select("i", "j", "v", F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("p")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
        if a <= 0 or b <= 0:
            raise ValueError("counts are positive")
        return Matrix(out.select((F.col("p") * self.m + cell.i).alias("i"), (F.col("q") * self.n + cell.j).alias("j"), "v"), self.m * a, self.n * b)

    def fliplr(self) -> Matrix:
        return self._moved(cell.i, self.n - 1 - cell.j, self.m, self.n)

    def flipud(self) -> Matrix:
        return self._moved(self.m - 1 - cell.i, cell.j, self.m, self.n)

    def rot90(self, k: int = 1) -> Matrix:
        """Counter-clockwise quarter turns."""
        k %= 4
        if k == 1:
            return self._moved(self.n - 1 - cell.j, cell.i, self.n, self.m)
        if k == 2:
            return self._moved(self.m - 1 - cell.i, self.n - 1 - cell.j, self.m, self.n)
        return self._moved(cell.j, self.m - 1 - cell.i, self.n, self.m) if k == 3 else self

    def triu(self, k: int = 0) -> Matrix:
        return self._with(F.when(cell.j - cell.i >= k, cell.v).otherwise(0.0))

    def tril(self, k: int = 0) -> Matrix:
        return self._with(F.when(cell.j - cell.i <= k, cell.v).otherwise(0.0))

    def diag(self) -> Matrix:
        return Matrix(self.df.where("i = j"), self.m, self.n)._moved(cell.i, F.lit(0), min(self.m, self.n), 1)

    def hstack(self, o: Matrix) -> Matrix:
        """A | B; an empty left side gives the right one."""
        if self.empty():
            return o
        if self.m != o.m:
            raise ValueError("sides of different heights")
        return Matrix(self.df.unionByName(o._moved(cell.i, cell.j + self.n, o.m, o.n).df), self.m, self.n + o.n)

    def vstack(self, o: Matrix) -> Matrix:
        if self.empty():
            return o
        if self.n != o.n:
            raise ValueError("parts of different widths")
        return Matrix(self.df.unionByName(o._moved(cell.i + self.m, cell.j, o.m, o.n).df), self.m + o.m, self.n)

    def blkdiag(self, o: Matrix) -> Matrix:
        from gridloom.sources import generate

        m, n = self.m + o.m, self.n + o.n
        parts = self.df.unionByName(o._moved(cell.i + self.m, cell.j + self.n, o.m, o.n).df)
        return generate.completed(parts, m, n)

    def resized(self, m: int, n: int) -> Matrix:
        """Cropped or padded with zeros."""
        from gridloom.sources import generate

        return generate.completed(self.df.where((cell.i < m) & (cell.j < n)), m, n)

    # --- structure tests ---

    def _tolerance(self, tol: float) -> float:
        return tol if tol >= 0 else 100 * 2.0**-52 * self.norm("inf")

    def is_diagonal(self) -> bool:
        return not self.df.where("i <> j AND v <> 0").head(1)

    def is_symmetric(self, tol: float = -1.0) -> bool:
        if self.m != self.n:
            return False
        t = self._tolerance(tol)
        return self._zip(self.T(), lambda a, b: ieee.compare("le", F.abs(a - b), F.lit(t)), "symmetry", True).all()

    is_hermitian = is_symmetric

    def is_upper(self, k: int = 0, tol: float = -1.0) -> bool:
        return not self.df.where((cell.j - cell.i < k) & ~ieee.compare("le", F.abs(cell.v), F.lit(self._tolerance(tol)))).head(1)

    def is_lower(self, k: int = 0, tol: float = -1.0) -> bool:
        return not self.df.where((cell.j - cell.i > k) & ~ieee.compare("le", F.abs(cell.v), F.lit(self._tolerance(tol)))).head(1)

    def bandwidth(self, tol: float = -1.0) -> tuple[int, int]:
        """(below, above) the diagonal."""
        big = self.df.where(~ieee.compare("le", F.abs(cell.v), F.lit(self._tolerance(tol))))
        low, high = big.agg(F.max(cell.i - cell.j), F.max(cell.j - cell.i)).first()
        return max(0, low or 0), max(0, high or 0)

    def is_banded(self, lower: int, upper: int, tol: float = -1.0) -> bool:
        a, b = self.bandwidth(tol)
        return a <= lower and b <= upper

    # --- out ---

    def to_rows(self) -> list[list[float]]:
        """The rows of a small matrix, on the driver."""
        out = [[0.0] * self.n for _ in range(self.m)]
        for a, b, x in self.df.select("i", "j", "v").toLocalIterator():
            out[a][b] = x
        return out

