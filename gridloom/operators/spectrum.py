"""Transforms of one long series, and half spectra of real ones.

A series is a table (k, re, im) with the places 0 … n - 1; absent places are zero. Its transform takes four steps: the
places are written as k1·n2 + k2, strides of equal k2 are transformed along k1, turned by a twiddle, regrouped by
frequency f1, and transformed along k2. The two regroupings are the only shuffles, and a task holds strides of
bounded length. Lengths without two such factors go through Bluestein's chirp, a product of two transforms
whose length is a power of two.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import materialize

#: Length of the longest stride, and elements that a task transforms at once.
STRIDE, AT_ONCE = 2**20, 2**18

_SCHEMA = "k bigint, re double, im double"


def factors(n: int) -> tuple[int, int] | None:
    """n1·n2 = n, as equal as they can be; none where the larger one is beyond a stride."""
    for a in range(math.isqrt(n), 0, -1):
        if n % a == 0:
            return (a, n // a) if n // a <= STRIDE else None
    return None


def series(df: DataFrame, place: str, value: str | Column, imaginary: str | Column | None = None) -> DataFrame:
    """(k, re, im) from a table's columns."""
    column = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return df.select(F.col(place).cast("bigint").alias("k"), column(value).alias("re"), column(imaginary).alias("im") if imaginary is not None else F.lit(0.0).alias("im"))


def _strides(df: DataFrame, stride: Column, at: Column, length: int, many: int, run: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``run(strides, their values as stride x place)`` for all strides, in groups that a task holds."""
    together = max(1, min(AT_ONCE // length, -(-many // 64)))
    group = F.floor(stride / together).cast("bigint")
    inner = F.struct((stride % together).cast("int").alias("s"), at.cast("int").alias("a"), "re", "im")
    held = df.groupBy(group.alias("g")).agg(F.collect_list(inner).alias("x"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g, own = batch.column(0)[row].as_py(), batch.column(1)[row].values
                x = np.zeros((min(together, many - g * together), length), complex)
                s, a, re, im = (own.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                x[s, a] = re + 1j * im
                places, made = run(np.arange(g * together, g * together + len(x)), x)
                yield pa.RecordBatch.from_arrays([pa.array(places.ravel()), pa.array(made.real.ravel()), pa.array(made.imag.ravel())], names=["k", "re", "im"])

    return held.mapInArrow(each, _SCHEMA)


def _turns(numerator: np.ndarray, n: int, sign: float) -> np.ndarray:
    """exp(sign · 2πi · numerator / n) for whole numerators, which are reduced before they are divided."""
    return np.exp(sign * 2j * math.pi * (numerator % n) / n)


def transform(df: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """The discrete transform of length n (absent places are zero); the inverse divides by n."""
    if n < 1:
        raise ValueError("a transform has a length")
    sign, two = (1.0 if inverse else -1.0), factors(n)
    if two is None:
        return _chirp(df, n, inverse)
    n1, n2 = two
    one_way = np.fft.ifft if inverse else np.fft.fft

    def first(k2: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f1 = np.arange(n1)
        return f1 * n2 + k2[:, None], one_way(x, axis=1) * _turns(f1 * k2[:, None], n, sign)

    def second(f1: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return f1[:, None] + n1 * np.arange(n2), one_way(x, axis=1)

    quotient, rest = F.floor(F.col("k") / n2), F.col("k") % n2
    half = _strides(df, rest, quotient, n1, n2, first)
    return _strides(half, quotient, rest, n2, n1, second)


def _chirp(df: DataFrame, n: int, inverse: bool) -> DataFrame:
    """Bluestein: f·k = (f² + k² - (f - k)²) / 2 makes a transform of any length a convolution with a chirp."""
    sign, longer = (1.0 if inverse else -1.0), 1 << (2 * n - 1).bit_length()
    spark = df.sparkSession

    def turned(batches: Iterator[pa.RecordBatch], divisor: float, below: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, re, im = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            keep = k < below
            x = (re + 1j * im)[keep] * _turns(_square(k[keep], 2 * n), 2 * n, sign) / divisor
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(x.real), pa.array(x.imag)], names=["k", "re", "im"])

    def chirp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            c = _turns(_square(np.minimum(k, longer - k), 2 * n), 2 * n, -sign)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.real), pa.array(c.imag)], names=["k", "re", "im"])

    a = transform(df.mapInArrow(lambda b: turned(b, 1.0, n), _SCHEMA), longer)
    places = spark.range(n).unionByName(spark.range(longer - n + 1, longer))
    b = transform(places.mapInArrow(chirp, _SCHEMA), longer)
    back = transform(materialize(product(a, b), "chirp"), longer, inverse=True)
    return back.mapInArrow(lambda b: turned(b, float(n) if inverse else 1.0, n), _SCHEMA)


def _square(k: np.ndarray, m: int) -> np.ndarray:
    """k² modulo m, for k below 2**31 in one product and beyond in halves."""
    k = k % m
    if m < 2**31:
        return k * k % m
    high, low = k >> 16, k & 0xFFFF
    out = np.zeros(len(k), object)
    out[:] = (high.astype(object) * k.astype(object) << 16) + low.astype(object) * k.astype(object)
    return (out % m).astype(np.int64)


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element by element; places that one of them lacks are zero.

    A spectrum is as long as its padded series however short the table it came from, so neither is broadcast.
    """
    both = a.join(b.select("k", F.col("re").alias("re2"), F.col("im").alias("im2")).hint("merge"), "k")
    x, y, u, v = (F.col(c) for c in ("re", "im", "re2", "im2"))
    return both.select("k", (x * u - y * v).alias("re"), (x * v + y * u).alias("im"))


@dataclass(frozen=True)
class HalfSpectrum:
    """The frequencies 0 … n // 2 of a real series of length n; the others are their conjugates."""

    df: DataFrame
    n: int

    @classmethod
    def of(cls, df: DataFrame, n: int) -> HalfSpectrum:
        """Of a real series (k, re, im), whose ``im`` is not looked at."""
        return cls(transform(df.withColumn("im", F.lit(0.0)), n).where(F.col("k") <= n // 2), n)

    def written(self) -> HalfSpectrum:
        return HalfSpectrum(materialize(self.df, "spectrum"), self.n)

    def _with(self, re: Column, im: Column) -> HalfSpectrum:
        return HalfSpectrum(self.df.select("k", re.alias("re"), im.alias("im")), self.n)

    def conj(self) -> HalfSpectrum:
        return self._with(F.col("re"), -F.col("im"))

    def abs(self) -> HalfSpectrum:
        return self._with(F.hypot("re", "im"), F.lit(0.0))

    def power(self) -> HalfSpectrum:
        return self._with(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.lit(0.0))

    def mul(self, o: HalfSpectrum) -> HalfSpectrum:
        if self.n != o.n:
            raise ValueError("spectra of series of other lengths")
        return HalfSpectrum(product(self.df, o.df), self.n)

    def scaled(self, k: float) -> HalfSpectrum:
        return self._with(F.col("re") * float(k), F.col("im") * float(k))

    def full(self) -> DataFrame:
        """All n frequencies."""
        mirrored = self.df.where((F.col("k") > 0) & (F.col("k") * 2 < self.n))
        return self.df.unionByName(mirrored.select((F.lit(self.n) - F.col("k")).alias("k"), "re", (-F.col("im")).alias("im")))

    def inverse(self) -> DataFrame:
        """(k, v): the real series."""
        return transform(self.full(), self.n, inverse=True).select("k", F.col("re").alias("v"))


def convolve(a: DataFrame, n: int, b: DataFrame, m: int) -> DataFrame:
    """(k, v): the full convolution of two real series of lengths n and m, through half spectra of one power of two."""
    if n < 1 or m < 1:
        raise ValueError("convolution of an empty series")
    longer = 1 << (n + m - 2).bit_length()
    made = HalfSpectrum.of(a, longer).mul(HalfSpectrum.of(b, longer)).written()
    return made.inverse().where(F.col("k") < n + m - 1)


def impulse(spark: SparkSession, at: int = 0) -> DataFrame:
    """One at one place."""
    return spark.range(at, at + 1).select(F.col("id").alias("k"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
