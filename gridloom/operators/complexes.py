"""Complex matrices: cells ``(i, j, re, im)`` beside a shape. There is no order, so no sort, min or max."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import ieee
from gridloom.operators.matrix import ROW, Matrix

Pair = tuple[Column, Column]

#: Cutoffs along a side of the tiles in which neighbours are counted, and places of one line that are added one by one.
SIDE, FEW = 4, 32


def times(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def over(a: Pair, b: Pair) -> Pair:
    size = b[0] * b[0] + b[1] * b[1]
    return ieee.divide(a[0] * b[0] + a[1] * b[1], size), ieee.divide(a[1] * b[0] - a[0] * b[1], size)


def exp(z: Pair) -> Pair:
    return F.exp(z[0]) * F.cos(z[1]), F.exp(z[0]) * F.sin(z[1])


def ln(z: Pair) -> Pair:
    return ieee.log(F.hypot(*z)), F.atan2(z[1], z[0])


def power(z: Pair, p: float) -> Pair:
    size, turn = F.pow(F.hypot(*z), F.lit(float(p))), F.atan2(z[1], z[0]) * p
    return size * F.cos(turn), size * F.sin(turn)


def sin(z: Pair) -> Pair:
    return F.sin(z[0]) * F.cosh(z[1]), F.cos(z[0]) * F.sinh(z[1])


def cos(z: Pair) -> Pair:
    return F.cos(z[0]) * F.cosh(z[1]), -F.sin(z[0]) * F.sinh(z[1])


def sinh(z: Pair) -> Pair:
    return F.sinh(z[0]) * F.cos(z[1]), F.cosh(z[0]) * F.sin(z[1])


def cosh(z: Pair) -> Pair:
    return F.cosh(z[0]) * F.cos(z[1]), F.sinh(z[0]) * F.sin(z[1])


#: Element-wise functions by name.
UNARY: dict[str, Callable[[Pair], Pair]] = {
    "exp": exp, "ln": ln, "sin": sin, "cos": cos, "sinh": sinh, "cosh": cosh,
    "tan": lambda z: over(sin(z), cos(z)), "tanh": lambda z: over(sinh(z), cosh(z)),
    "sqrt": lambda z: power(z, 0.5), "conj": lambda z: (z[0], -z[1]),
    "lg": lambda z: tuple(x / math.log(2) for x in ln(z)), "log10": lambda z: tuple(x / math.log(10) for x in ln(z)),
    "sign": lambda z: (F.coalesce(F.try_divide(z[0], F.hypot(*z)), F.lit(0.0)), F.coalesce(F.try_divide(z[1], F.hypot(*z)), F.lit(0.0))),
}


class Complex:
    def __init__(self, df: DataFrame, m: int, n: int):
        self.df, self.m, self.n = df, m, n

    @classmethod
    def of(cls, re: Matrix, im: Matrix) -> Complex:
        re._same(im, "parts")
        both = re.df.withColumnRenamed("v", "re").join(im.df.withColumnRenamed("v", "im"), ["i", "j"])
        return cls(both, re.m, re.n)

    @property
    def shape(self) -> tuple[int, int]:
        return self.m, self.n

    def _own(self) -> Pair:
        return F.col("re"), F.col("im")

    def _with(self, z: Pair) -> Complex:
        return Complex(self.df.select("i", "j", z[0].alias("re"), z[1].alias("im")), self.m, self.n)

    def _zip(self, o: Complex, f: Callable[[Pair, Pair], Pair]) -> Complex:
        if self.shape != o.shape:
            raise ValueError(f"shapes {self.shape} and {o.shape}")
        both = self.df.join(o.df.withColumnsRenamed({"re": "re2", "im": "im2"}), ["i", "j"])
        re, im = f((F.col("re"), F.col("im")), (F.col("re2"), F.col("im2")))
        return Complex(both.select("i", "j", re.alias("re"), im.alias("im")), self.m, self.n)

    def __add__(self, o: Complex) -> Complex:
        return self._zip(o, lambda a, b: (a[0] + b[0], a[1] + b[1]))

    def __sub__(self, o: Complex) -> Complex:
        return self._zip(o, lambda a, b: (a[0] - b[0], a[1] - b[1]))

    def __neg__(self) -> Complex:
        return self._with((-F.col("re"), -F.col("im")))

    def __mod__(self, o: Complex) -> Complex:
        return self._zip(o, times)

    mul = __mod__

    def div(self, o: Complex) -> Complex:
        return self._zip(o, over)

    def __mul__(self, o):
        """A scalar, or the matrix product: one join on the inner index, one sum of both parts."""
        if not isinstance(o, Complex):
            k = complex(o)
            return self._with(times(self._own(), (F.lit(k.real), F.lit(k.imag))))
        if self.n != o.m:
            raise ValueError(f"product of shapes {self.shape} and {o.shape}")
        left = self.df.withColumnRenamed("j", "k")
        right = o.df.select(F.col("i").alias("k"), "j", F.col("re").alias("re2"), F.col("im").alias("im2"))
        re, im = times((F.col("re"), F.col("im")), (F.col("re2"), F.col("im2")))
        return Complex(left.join(right, "k").groupBy("i", "j").agg(F.sum(re).alias("re"), F.sum(im).alias("im")), self.m, o.n)

    def __getattr__(self, name: str):
        f = UNARY.get(name)
        if f is None:
            raise TypeError(f"complex numbers have no {name}") if name in ("min", "max", "sort", "median", "mode", "unique", "argmin", "argmax", "lt", "gt") else AttributeError(name)
        return lambda: self._with(f(self._own()))

    def pow(self, p: float) -> Complex:
        return self._with(power(self._own(), p))

    def _part(self, value: Column) -> Matrix:
        return Matrix(self.df.select("i", "j", value.alias("v")), self.m, self.n)

    def real(self) -> Matrix:
        return self._part(F.col("re"))

    def imag(self) -> Matrix:
        return self._part(F.col("im"))

    def abs(self) -> Matrix:
        return self._part(F.hypot("re", "im"))

    def arg(self) -> Matrix:
        return self._part(F.atan2("im", "re"))

    angle = arg

    def T(self) -> Complex:  # noqa: N802
        return Complex(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "re", "im"), self.n, self.m)

    def H(self) -> Complex:  # noqa: N802
        return self.T().conj()

    def sum(self) -> complex:
        re, im = self.df.agg(F.coalesce(F.sum("re"), F.lit(0.0)), F.coalesce(F.sum("im"), F.lit(0.0))).first()
        return complex(re, im)

    def mean(self) -> complex:
        return self.sum() / (self.m * self.n)

    def dot(self, o: Complex) -> complex:
        """conj(a)·b over all elements."""
        return self.conj().mul(o).sum()

    def norm(self) -> float:
        return self.abs().norm()

    def var(self, sample: bool = False) -> float:
        """Mean square distance from the mean."""
        v = self.real().var(sample) + self.imag().var(sample)
        return v

    def sum_axis(self, axis: bool) -> Complex:
        key = "i" if axis == ROW else "j"
        out = self.df.groupBy(key).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        zero = F.lit(0).cast("bigint")
        cells = out.select("i", zero.alias("j"), "re", "im") if axis == ROW else out.select(zero.alias("i"), "j", "re", "im")
        return Complex(cells, *((self.m, 1) if axis == ROW else (1, self.n)))

    def is_hermitian(self, tol: float = 1e-12) -> bool:
        return self.m == self.n and not (self - self.H()).abs().gt(tol).any()


def mandelbrot(points: DataFrame, re: str, im: str, rounds: int) -> DataFrame:
    """Add ``steps``: how often z² + c is taken before |z| passes 2, as a fold in one expression."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("n"))

    def step(s: Column, _: Column) -> Column:
        x, y = s["x"] * s["x"] - s["y"] * s["y"] + F.col(re), 2 * s["x"] * s["y"] + F.col(im)
        inside = s["x"] * s["x"] + s["y"] * s["y"] <= 4
        keep = lambda new, old: F.when(inside, new).otherwise(old)
        return F.struct(keep(x, s["x"]).alias("x"), keep(y, s["y"]).alias("y"), (s["n"] + inside.cast("int")).alias("n"))

    return points.withColumn("steps", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["n"]).cast("bigint"))


def near_pairs(points: DataFrame, key: str, x: str, y: str, cutoff: float) -> DataFrame:
    """(k, k2, x, y, x2, y2, r2) of ordered pairs of points within ``cutoff``.

    The plane is cut into squares of the cutoff's width; a point meets the nine squares around its
    own by an equi-join, so that only neighbours are compared.
    """
    own = points.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.floor(F.col(x) / cutoff).alias("p"), F.floor(F.col(y) / cutoff).alias("q"))
    step = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    other = own.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "p", "q")
    near = own.withColumn("dp", F.explode(step)).withColumn("dq", F.explode(step)).select("k", "x", "y", (F.col("p") + F.col("dp")).alias("p"), (F.col("q") + F.col("dq")).alias("q"))
    r2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    both = near.join(other, ["p", "q"]).where("k <> k2").withColumn("r2", r2)
    return both.where((F.col("r2") < cutoff * cutoff) & (F.col("r2") > 0)).drop("p", "q")


def near_totals(points: DataFrame, key: str, x: str, y: str, cutoff: float, unit: float = 1.0) -> DataFrame:
    """(k, n, s) of the keys with partners: how many pairs of ``near_pairs`` a key has, and the sum of their r2.

    No pair is made. The plane is cut into tiles of ``SIDE`` cutoffs, and a point is copied to those that its cutoff reaches. In a tile the
    points of one y lie on a line in the order of x, where partners are a range, and their totals differences of running sums: a point costs
    the lines within the cutoff, not the points on them. ``y`` is in units, so that lines at whole multiples of one have exact distances.
    """
    finite = lambda c: F.col(c) - F.col(c) == 0
    own = points.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("k").isNotNull() & finite("x") & finite("y"))
    side, reach = SIDE * cutoff, cutoff * (1 + 1e-6)
    at = lambda c: F.floor(c / side)
    tiles = lambda c: F.explode(F.sequence(at(c - reach), at(c + reach)))
    across, up = F.col("x"), F.col("y") * float(unit)
    seen = own.select("*", tiles(across).alias("p")).select("*", tiles(up).alias("q"))
    seen = seen.select("*", ((F.col("p") == at(across)) & (F.col("q") == at(up))).alias("own"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        px, py, home = part["x"].to_numpy(), part["y"].to_numpy(), part["own"].to_numpy()
        n, s = _totals(np.zeros(len(part), np.int64), px, py, home, cutoff, unit)
        codes = pd.factorize(part["k"])[0]
        again = np.flatnonzero(np.bincount(codes)[codes] > 1)
        if len(again):
            same, squares = _totals(codes[again], px[again], py[again], home[again], cutoff, unit)
            n[again] -= same
            s[again] -= squares
        keep = home & (n > 0)
        return pd.DataFrame({"k": part["k"][keep], "n": n[keep], "s": s[keep].astype(float)})

    made = seen.groupBy("p", "q").applyInPandas(run, f"k {own.schema['k'].dataType.simpleString()}, n bigint, s double")
    return made.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _totals(group: np.ndarray, px: np.ndarray, py: np.ndarray, home: np.ndarray, cutoff: float, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """For every point at home: points of its group within the cutoff and not at its place, and their squared distances' sum.

    Running sums are kept in long doubles, so that their differences are as good as sums of doubles.
    """
    limit, wide = cutoff * cutoff, np.longdouble
    order = np.lexsort((px, py, group))
    g, sy, sx = group[order], py[order], px[order]
    new_line = np.r_[True, (g[1:] != g[:-1]) | (sy[1:] != sy[:-1])]
    new_place = new_line | np.r_[True, sx[1:] != sx[:-1]]
    first = np.flatnonzero(new_place)
    weight, place_of = np.diff(np.r_[first, len(sx)]), np.cumsum(new_place) - 1
    g, sy, sx, starts, asked = g[first], sy[first], sx[first], np.flatnonzero(new_line[first]), np.flatnonzero(home[order][first])
    ends = np.r_[starts[1:], len(sx)]
    line_y, ys, xs = sy[starts], np.unique(sy), np.unique(sx)
    line_keys = g[starts] * (len(ys) + 1) + np.searchsorted(ys, line_y)
    keys = np.repeat(np.arange(len(starts)), ends - starts) * (len(xs) + 1) + np.searchsorted(xs, sx)
    middle = wide(xs[0]) + (wide(xs[-1]) - wide(xs[0])) / 2
    running = lambda v: np.concatenate([np.zeros(1, v.dtype), np.cumsum(v)])
    d = sx.astype(wide) - middle
    counts, firsts, seconds = running(weight), running(weight * d), running(weight * d * d)

    def reach(x: np.ndarray, line: np.ndarray, dy2: np.ndarray, below: float) -> tuple[np.ndarray, np.ndarray]:
        """The range of a line's places whose squared distance, as doubles round it, is below a limit."""
        w, base = np.sqrt(np.maximum(below - dy2, 0)), line * (len(xs) + 1)
        a = np.searchsorted(keys, base + np.searchsorted(xs, x - w))
        b = np.searchsorted(keys, base + np.searchsorted(xs, x + w, "right"))
        inside = lambda at: (x - sx[np.clip(at, 0, len(sx) - 1)]) ** 2 + dy2 < below

        def walked(at: np.ndarray, step: int, goes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            while (go := goes(at)).any():
                at = at + step * go
            return at

        a = walked(a, -1, lambda at: (at > starts[line]) & inside(at - 1))
        a = walked(a, 1, lambda at: (at < b) & ~inside(at))
        b = walked(b, 1, lambda at: (at < ends[line]) & inside(at))
        return a, walked(b, -1, lambda at: (at > a) & ~inside(at - 1))

    n, s = np.zeros(len(sx), np.int64), np.zeros(len(sx), wide)
    border = cutoff / unit * (1 + 1e-9)
    low = np.searchsorted(line_keys, g[asked] * (len(ys) + 1) + np.searchsorted(ys, sy[asked] - border))
    high = np.searchsorted(line_keys, g[asked] * (len(ys) + 1) + np.searchsorted(ys, sy[asked] + border, "right"))
    for step in range(int((high - low).max(initial=0))):
        own = np.flatnonzero(low + step < high)
        line, to = low[own] + step, asked[own]
        dy2 = ((sy[to] - line_y[line]) * unit) ** 2
        hit = dy2 < limit
        line, to, dy2 = line[hit], to[hit], dy2[hit]
        x, (a, b) = sx[to], reach(sx[to], line, dy2, limit)
        found, away = counts[b] - counts[a], d[to]
        total = found * (away * away + dy2) - 2 * away * (firsts[b] - firsts[a]) + (seconds[b] - seconds[a])
        few = np.flatnonzero(b - a <= FEW)
        total[few] = 0
        for k in range(int((b - a)[few].max(initial=0))):
            few = few[a[few] + k < b[few]]
            at = a[few] + k
            total[few] += weight[at] * ((x[few] - sx[at]) ** 2 + dy2[few])
        none = np.flatnonzero(dy2 == 0)
        za, zb = reach(x[none], line[none], dy2[none], np.nextafter(0, 1))
        found[none] -= counts[zb] - counts[za]
        n[to] += found
        s[to] += total
    out_n, out_s = np.zeros(len(px), np.int64), np.zeros(len(px), wide)
    out_n[order], out_s[order] = n[place_of], s[place_of]
    return out_n, out_s


def pair_forces(particles: DataFrame, key: str, x: str, y: str, cutoff: float, epsilon: float = 1.0, sigma: float = 1.0) -> DataFrame:
    """(key, fx, fy, partners): Lennard-Jones forces within ``cutoff``."""
    s6 = F.pow(F.lit(sigma * sigma) / F.col("r2"), F.lit(3.0))
    f = 24 * epsilon * (2 * s6 * s6 - s6) / F.col("r2")
    both = near_pairs(particles, key, x, y, cutoff)
    return both.groupBy(F.col("k").alias(key)).agg(F.sum(f * (F.col("x") - F.col("x2"))).alias("fx"), F.sum(f * (F.col("y") - F.col("y2"))).alias("fy"), F.count(F.lit(1)).alias("partners"))
