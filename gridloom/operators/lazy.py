"""Element-wise expressions that are put off: matrices meet once, and one projection evaluates all."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import ieee
from gridloom.operators.matrix import Matrix


class Expr:
    """A function of the elements, at one place, of some matrices of one shape."""

    def __init__(self, inputs: list[Matrix], f: Callable[[dict[int, Column]], Column]):
        self.inputs, self.f = inputs, f

    @classmethod
    def of(cls, a: Matrix) -> Expr:
        return cls([a], lambda at: at[id(a)])

    def _unary(self, g: Callable[[Column], Column]) -> Expr:
        return Expr(self.inputs, lambda at: g(self.f(at)))

    def _binary(self, o, g: Callable[[Column, Column], Column]) -> Expr:
        if isinstance(o, Matrix):
            o = Expr.of(o)
        if not isinstance(o, Expr):
            return self._unary(lambda x: g(x, F.lit(float(o))))
        if self.inputs[0].shape != o.inputs[0].shape:
            raise ValueError(f"expressions of shapes {self.inputs[0].shape} and {o.inputs[0].shape}")
        more = [x for x in o.inputs if all(x is not y for y in self.inputs)]
        return Expr([*self.inputs, *more], lambda at: g(self.f(at), o.f(at)))

    def __add__(self, o):
        return self._binary(o, lambda x, y: x + y)

    def __sub__(self, o):
        return self._binary(o, lambda x, y: x - y)

    def __mod__(self, o):
        return self._binary(o, lambda x, y: x * y)

    def __mul__(self, k: float):
        return self._unary(lambda x: x * F.lit(float(k)))

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, k: float):
        return self._unary(lambda x: F.lit(float(k)) - x)

    def __truediv__(self, o):
        return self._binary(o, ieee.divide)

    def __neg__(self):
        return self._unary(lambda x: -x)

    def pow(self, p: float):
        return self._unary(lambda x: F.pow(x, F.lit(float(p))))

    def emax(self, o):
        return self._binary(o, F.greatest)

    def emin(self, o):
        return self._binary(o, F.least)

    def __getattr__(self, name: str):
        f = ieee.UNARY.get(name)
        if f is None:
            raise AttributeError(name)
        return lambda: self._unary(f)

    def eval(self) -> Matrix:
        """The matrix: one join of the inputs, whatever the number of steps."""
        parts = [a.df.select("i", "j", F.col("v").alias(f"v{k}")) for k, a in enumerate(self.inputs)]
        both = functools.reduce(lambda x, y: x.join(y, ["i", "j"]), parts)
        value = self.f({id(a): F.col(f"v{k}") for k, a in enumerate(self.inputs)})
        return Matrix(both.select("i", "j", value.alias("v")), *self.inputs[0].shape)
