"""Identity matrices that stay symbols until they meet a matrix of known size."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.operators.matrix import Matrix, cell


class Identity:
    """``scale`` times the identity of order ``n``; without an order it takes that of what it meets."""

    def __init__(self, n: int | None = None, scale: float = 1.0):
        if n is not None and n < 0:
            raise ValueError("an order is not negative")
        self.n, self.scale = n, float(scale)

    def _order(self, o: Identity) -> int | None:
        if None not in (self.n, o.n) and self.n != o.n:
            raise ValueError(f"identities of orders {self.n} and {o.n}")
        return o.n if self.n is None else self.n

    def _fits(self, a: Matrix) -> None:
        a._square("sum or product with an identity")
        if self.n not in (None, a.m):
            raise ValueError(f"an identity of order {self.n} and a matrix of {a.m}")

    def __add__(self, o):
        if isinstance(o, Identity):
            return Identity(self._order(o), self.scale + o.scale)
        if isinstance(o, Matrix):
            self._fits(o)
            return o._with(F.when(cell.i == cell.j, cell.v + self.scale).otherwise(cell.v))
        return NotImplemented

    __radd__ = __add__

    def __neg__(self) -> Identity:
        return Identity(self.n, -self.scale)

    def __sub__(self, o):
        return self + -o

    def __rsub__(self, o):
        return -self + o

    def __mul__(self, o):
        if isinstance(o, Identity):
            return Identity(self._order(o), self.scale * o.scale)
        if isinstance(o, Matrix):
            self._fits(o)
            return o * self.scale
        return Identity(self.n, self.scale * o)

    __rmul__ = __mul__

    def size(self) -> int | None:
        return self.n

    def materialised(self, spark: SparkSession, n: int | None = None) -> Matrix:
        from gridloom.sources import generate

        order = self._order(Identity(n)) if n is not None else self.n
        if order is None:
            raise ValueError("an identity without an order")
        return generate.eye(spark, order, self.scale)


#: The identity without an order.
I = Identity()  # noqa: E741
