"""Tensors: one bigint column per axis (``a0``, ``a1``, …) and a value ``v``, beside the shape."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import ieee
from gridloom.operators.matrix import Matrix, cell
from gridloom.operators.scans import numbered


class Tensor:
    def __init__(self, df: DataFrame, shape: Sequence[int]):
        self.df, self.shape = df, tuple(shape)

    @property
    def axes(self) -> list[str]:
        return [f"a{k}" for k in range(len(self.shape))]

    def rank(self) -> int:
        return len(self.shape)

    def size(self) -> int:
        return math.prod(self.shape) if self.shape else 0

    @classmethod
    def generate(cls, spark: SparkSession, shape: Sequence[int], value: Callable[[Column], Column]) -> Tensor:
        """``value`` of the flat row-major index at every cell."""
        flat = spark.range(math.prod(shape)).withColumnRenamed("id", "n")
        return cls(flat.select(*_unflat(F.col("n"), shape), value(F.col("n")).cast("double").alias("v")), shape)

    @classmethod
    def from_matrix(cls, a: Matrix) -> Tensor:
        return cls(a.df.select(F.col("i").alias("a0"), F.col("j").alias("a1"), "v"), a.shape)

    def to_matrix(self) -> Matrix:
        if self.rank() == 1:
            return Matrix(self.df.select(F.lit(0).cast("bigint").alias("i"), F.col("a0").alias("j"), "v"), 1, self.shape[0])
        if self.rank() != 2:
            raise ValueError("only ranks one and two are matrices")
        return Matrix(self.df.select(F.col("a0").alias("i"), F.col("a1").alias("j"), "v"), *self.shape)

    def _axis(self, k: int) -> int:
        if not 0 <= k < self.rank():
            raise IndexError(f"axis {k} of rank {self.rank()}")
        return k

    def flat_index(self) -> Column:
        out = F.lit(0).cast("bigint")
        for a, n in zip(self.axes, self.shape):
            out = out * n + F.col(a)
        return out

    # --- elements ---

    def at(self, *index: int) -> float:
        if len(index) != self.rank():
            raise IndexError(f"{len(index)} indices of rank {self.rank()}")
        hit = F.lit(True)
        for k, (a, n) in enumerate(zip(index, self.shape)):
            at = a + n if a < 0 else a
            if not 0 <= at < n:
                raise IndexError(f"index {a} is outside axis {k}")
            hit &= F.col(f"a{k}") == at
        return self.df.where(hit).first()["v"]

    def flat(self, k: int) -> float:
        """The element at a flat row-major index."""
        index, rest = [], k + self.size() if k < 0 else k
        if not 0 <= rest < self.size():
            raise IndexError("the index is outside")
        for n in reversed(self.shape):
            index.append(rest % n)
            rest //= n
        return self.at(*reversed(index))

    def scalar(self) -> float:
        if self.size() != 1:
            raise ValueError("only a tensor of one element is a scalar")
        return self.df.first()["v"]

    def equals(self, o: Tensor) -> bool:
        """Whole equality: false for other shapes, and for any NaN."""
        return self.shape == o.shape and self.compare("eq", o).all()

    def allclose(self, o: Tensor, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
        if self.shape != o.shape:
            return False
        near = lambda a, b: ieee.compare("le", F.abs(a - b), atol + rtol * F.abs(b)) | ieee.compare("eq", a, b)
        return self._zip(o, near).all()

    # --- views: renames and filters ---

    def reshape(self, *shape: int) -> Tensor:
        """One -1 is inferred."""
        known = math.prod(s for s in shape if s >= 0)
        shape = tuple(self.size() // known if s < 0 else s for s in shape)
        if math.prod(shape) != self.size():
            raise ValueError("a reshape keeps the number of elements")
        return Tensor(self.df.select(self.flat_index().alias("n"), "v").select(*_unflat(F.col("n"), shape), "v"), shape)

    def permute(self, order: Sequence[int]) -> Tensor:
        if sorted(order) != list(range(self.rank())):
            raise ValueError("not a permutation of the axes")
        return Tensor(self.df.select(*[F.col(f"a{o}").alias(f"a{k}") for k, o in enumerate(order)], "v"), [self.shape[o] for o in order])

    def swap_axes(self, a: int, b: int) -> Tensor:
        order = list(range(self.rank()))
        order[self._axis(a)], order[self._axis(b)] = b, a
        return self.permute(order)

    def T(self) -> Tensor:  # noqa: N802
        return self.permute(list(range(self.rank()))[::-1])

    def slice(self, axis: int, index: int) -> Tensor:
        if not 0 <= index < self.shape[self._axis(axis)]:
            raise IndexError("the index is outside")
        rest = [k for k in range(self.rank()) if k != axis]
        out = self.df.where(F.col(f"a{axis}") == index)
        return Tensor(out.select(*[F.col(f"a{o}").alias(f"a{k}") for k, o in enumerate(rest)], "v"), [self.shape[o] for o in rest])

    # --- element-wise ---

    def _with(self, value: Column) -> Tensor:
        return Tensor(self.df.select(*self.axes, value.alias("v")), self.shape)

    def _zip(self, o: Tensor, f: Callable[[Column, Column], Column]) -> Tensor:
        if self.shape != o.shape:
            raise ValueError(f"shapes {self.shape} and {o.shape}: there is no broadcasting")
        both = self.df.withColumnRenamed("v", "x").join(o.df.withColumnRenamed("v", "y"), self.axes)
        return Tensor(both.select(*self.axes, f(F.col("x"), F.col("y")).alias("v")), self.shape)

    def __add__(self, o: Tensor) -> Tensor:
        return self._zip(o, lambda x, y: x + y)

    def __sub__(self, o: Tensor) -> Tensor:
        return self._zip(o, lambda x, y: x - y)

    def __mod__(self, o: Tensor) -> Tensor:
        return self._zip(o, lambda x, y: x * y)

    mul = __mod__

    def div(self, o: Tensor) -> Tensor:
        return self._zip(o, ieee.divide)

    def __neg__(self) -> Tensor:
        return self._with(-cell.v)

    def __mul__(self, o):
        return contract(self, o, 1) if isinstance(o, Tensor) else self._with(cell.v * F.lit(o))

    __rmul__ = __mul__

    def __truediv__(self, k: float) -> Tensor:
        return self._with(ieee.divide(cell.v, F.lit(float(k))))

    def compare(self, op: str, o) -> Tensor:
        return self._zip(o, lambda x, y: ieee.compare(op, x, y)) if isinstance(o, Tensor) else self._with(ieee.compare(op, cell.v, F.lit(o)))

    def land(self, o: Tensor) -> Tensor:
        return self._zip(o, lambda x, y: ieee.truth(x) & ieee.truth(y))

    def lor(self, o: Tensor) -> Tensor:
        return self._zip(o, lambda x, y: ieee.truth(x) | ieee.truth(y))

    def lxor(self, o: Tensor) -> Tensor:
        return self._zip(o, lambda x, y: ieee.truth(x) != ieee.truth(y))

    def lnot(self) -> Tensor:
        return self._with(~ieee.truth(cell.v))

    def pow(self, p: float) -> Tensor:
        return self._with(F.pow(cell.v, F.lit(float(p))))

    def fill(self, value: float) -> Tensor:
        return self._with(F.lit(float(value)))

    def __getattr__(self, name: str):
        f = ieee.UNARY.get(name)
        if f is None:
            raise AttributeError(name)
        return lambda: self._with(f(cell.v))

    def select_where(self, mask: Tensor) -> DataFrame:
        """(flat index, value) of the marked elements."""
        return self.df.join(mask.df.where(ieee.truth(cell.v)).drop("v"), self.axes).select(self.flat_index().alias("n"), "v")

    def put_where(self, mask: Tensor, value: float | Tensor) -> Tensor:
        """The marked elements become a scalar, or those of a tensor of rank one with as many, in row-major order."""
        if not isinstance(value, Tensor):
            return self._zip(mask, lambda x, y: F.when(ieee.truth(y), F.lit(float(value))).otherwise(x))
        if self.shape != mask.shape:
            raise ValueError("a mask of another shape")
        if value.rank() != 1 or value.size() != mask.nnz():
            raise ValueError("as many values as marked elements are needed")
        places = numbered(mask.df.where(ieee.truth(cell.v)).select(*self.axes), self.axes)
        new = places.join(value.df.select(F.col("a0").alias("rank"), F.col("v").alias("w")), "rank").drop("rank")
        return Tensor(self.df.join(new, self.axes, "left").select(*self.axes, F.coalesce("w", "v").alias("v")), self.shape)

    # --- reductions and scans ---

    def _all(self, how: Column) -> float:
        return self.df.select(how).first()[0]

    def reduce(self, how: Callable[[Column], Column], axis: int | None = None):
        """``how`` of all values, or along one axis; the last axis of rank one leaves shape (1)."""
        if axis is None:
            return self._all(how(cell.v))
        rest = [k for k in range(self.rank()) if k != self._axis(axis)]
        if not rest:
            return Tensor(self.df.agg(how(cell.v).alias("v")).select(F.lit(0).cast("bigint").alias("a0"), "v"), [1])
        out = self.df.groupBy(*[F.col(f"a{o}").alias(f"a{k}") for k, o in enumerate(rest)]).agg(how(cell.v).alias("v"))
        return Tensor(out, [self.shape[o] for o in rest])

    def sum(self, axis: int | None = None):
        return self.reduce(F.sum, axis)

    def mean(self, axis: int | None = None):
        return self.reduce(F.avg, axis)

    def min(self, axis: int | None = None):
        return self.reduce(F.min, axis)

    def max(self, axis: int | None = None):
        return self.reduce(F.max, axis)

    def prod(self, axis: int | None = None):
        return self.reduce(F.product, axis)

    def var(self, sample: bool = False) -> float:
        return self._all(F.var_samp(cell.v) if sample else F.var_pop(cell.v))

    def stddev(self, sample: bool = False) -> float:
        return math.sqrt(self.var(sample))

    def norm(self) -> float:
        return math.sqrt(self._all(F.sum(cell.v * cell.v)) or 0.0)

    def nnz(self) -> int:
        return self.df.where(ieee.truth(cell.v)).count()

    def any(self) -> bool:
        return bool(self.df.where(ieee.truth(cell.v)).head(1))

    def all(self) -> bool:
        return not self.df.where(~ieee.truth(cell.v)).head(1)

    def find(self) -> DataFrame:
        return self.df.where(ieee.truth(cell.v)).select(self.flat_index().alias("n")).orderBy("n")

    def _window(self, axis: int):
        return Window.partitionBy(*[a for k, a in enumerate(self.axes) if k != axis]).orderBy(f"a{self._axis(axis)}")

    def cumsum(self, axis: int) -> Tensor:
        return self._with(F.sum(cell.v).over(self._window(axis).rowsBetween(Window.unboundedPreceding, 0)))

    def cumprod(self, axis: int) -> Tensor:
        return self._with(F.product(cell.v).over(self._window(axis).rowsBetween(Window.unboundedPreceding, 0)))

    def diff(self, axis: int) -> Tensor:
        n = self.shape[self._axis(axis)]
        if n < 2:
            raise ValueError("fewer than two along the axis")
        out = self._with(F.lead(cell.v).over(self._window(axis)) - cell.v).df.where(F.col(f"a{axis}") < n - 1)
        return Tensor(out, [s - (k == axis) for k, s in enumerate(self.shape)])


def _unflat(n: Column, shape: Sequence[int]) -> list[Column]:
    out, step = [], 1
    for k in range(len(shape) - 1, -1, -1):
        out.append((F.floor(n / step) % shape[k]).cast("bigint").alias(f"a{k}"))
        step *= shape[k]
    return out[::-1]


def contract(a: Tensor, b: Tensor, k: int = 1) -> Tensor:
    """The last k axes of A with the first k of B."""
    return contract_axes(a, b, list(range(a.rank() - k, a.rank())), list(range(k)))


def contract_axes(a: Tensor, b: Tensor, axes_a: Sequence[int], axes_b: Sequence[int]) -> Tensor:
    """Sum over pairs of axes, by products of tiles; absent cells are zero."""
    from gridloom.operators import tiles

    return tiles.contract_cells(a, b, axes_a, axes_b)


def contract_acc(a: Tensor, b: Tensor, k: int, out: Tensor) -> Tensor:
    """out + contract(A, B, k)."""
    return out + contract(a, b, k)
