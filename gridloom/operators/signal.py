"""Signals and polynomials on series held as (k, v), or on matrices of one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import spectrum
from gridloom.operators.matrix import Matrix
from gridloom.operators.scans import BLOCK, lagged, last_and_next, numbered


#: Taps of one block of a convolution.
CONV_BLOCK = 16_384


def conv(a: Matrix, b: Matrix, block: int = CONV_BLOCK) -> Matrix:
    """Full convolution. Two long series go through half spectra; of a long and a short one, every block of the long one is
    transformed with the whole of the short one, which every task is told.
    """
    if a.empty() or b.empty():
        raise ValueError("convolution of an empty series")
    if a.numel() < b.numel():
        a, b = b, a
    flat = lambda m: m.df.select((F.col("i") * m.n + F.col("j")).alias("k"), "v")
    zero, total = F.lit(0).cast("bigint").alias("i"), a.numel() + b.numel() - 1
    if b.numel() > block:
        made = spectrum.convolve(spectrum.series(flat(a), "k", "v"), a.numel(), spectrum.series(flat(b), "k", "v"), b.numel())
        return Matrix(made.select(zero, F.col("k").alias("j"), "v"), 1, total)

    def packed(m: Matrix, name: str) -> DataFrame:
        inner = F.struct((F.col("k") % block).cast("int").alias("k"), "v")
        return flat(m).groupBy(F.floor(F.col("k") / block).alias(name)).agg(F.collect_list(inner).alias(f"{name}_cells"))

    one = F.lit(0).alias("one")
    both = packed(a, "p").withColumn("one", one).join(F.broadcast(packed(b, "q").select(one, "q_cells")), "one").select("p", "p_cells", "q_cells")
    length = 2 * block

    def dense(cells: pa.ListArray, at: int) -> np.ndarray:
        out, own = np.zeros(length), cells[at].values
        out[own.field(0).to_numpy()] = own.field(1).to_numpy()
        return out

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = batch.column(0)[row].as_py() * block
                made = np.fft.irfft(np.fft.rfft(dense(batch.column(1), row)) * np.fft.rfft(dense(batch.column(2), row)), length)
                keep = max(0, min(length, total - at))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + keep)), pa.array(made[:keep])], names=["j", "v"])

    out = both.mapInArrow(products, "j bigint, v double").groupBy("j").agg(F.sum("v").alias("v"))
    return Matrix(out.select(zero, "j", "v"), 1, total)


def polyval(coefficients: list[float], x: Column) -> Column:
    """Horner's scheme as one expression, highest power first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(float(c))
    return out


def fir(df: DataFrame, order: str, value: str, taps: list[float], by: list[str] | None = None) -> DataFrame:
    """Add ``filtered``: the weighted sum of a value and those before it, per series (``by``), whatever a series' length."""
    if not taps:
        raise ValueError("no taps")
    out = F.col(value).cast("double") * F.lit(float(taps[0]))
    for k, t in enumerate(taps[1:]):
        out = out + F.coalesce(F.get("__lag", F.lit(k)), F.lit(0.0)) * F.lit(float(t))
    return lagged(df, by or [], order, value, len(taps) - 1).select(*df.columns, out.alias("filtered"))


def iir(df: DataFrame, order: str, value: str, b: list[float], a: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, order, filtered): the difference equation of each series, whatever its length.

    Ordered rows are cut into blocks. The state that a block leaves is linear in the one it enters with, so
    each block first tells the state it leaves from rest; these are chained, one row a block; and every block
    then runs from the state it enters with.
    """
    if not a or a[0] == 0:
        raise ValueError("a[0] is zero")
    by, size = by or [], max(len(a), len(b)) - 1
    num = np.array([*b, *[0.0] * (size + 1 - len(b))]) / a[0]
    den = np.array([*a, *[0.0] * (size + 1 - len(a))]) / a[0]
    series = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = numbered(df.select(*by, F.col(order), F.col(value).cast("double").alias("__x"), series.alias("__s")), [*by, order])
    rows = rows.withColumn("__b", F.floor(F.col("rank") / BLOCK))

    def through(xs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of one series' values from a state, and the state after them."""
        z, out = state.tolist(), np.empty(len(xs))
        for k, x in enumerate(xs.tolist()):
            y = num[0] * x + (z[0] if size else 0.0)
            z = [num[i + 1] * x + (z[i + 1] if i + 1 < size else 0.0) - den[i + 1] * y for i in range(size)]
            out[k] = y
        return out, np.array(z)

    def pieces(part: pd.DataFrame) -> list[tuple[int, int]]:
        names = part["__s"].to_numpy()
        cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
        return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]))

    def leaves(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        last = pieces(part)[-1]
        z = through(part["__x"].to_numpy()[slice(*last)], np.zeros(size))[1]
        return pd.DataFrame({"__b": [part["__b"].iloc[0]], "first": [part["__s"].iloc[0]], "last": [part["__s"].iloc[-1]], "whole": [last[0] == 0], "n": [len(part)], "z": [z.tolist()]})

    step = np.zeros((size, size))
    for k in range(size):
        step[k, 0] = -den[k + 1]
        if k + 1 < size:
            step[k, k + 1] = 1.0

    def chained(blocks: pd.DataFrame) -> pd.DataFrame:
        z, last, out = np.zeros(size), None, []
        for r in blocks.sort_values("__b").itertuples(index=False):
            enters = z if r.first == last else np.zeros(size)
            out.append(enters.tolist())
            z = np.array(r.z) + (np.linalg.matrix_power(step, r.n) @ enters if r.whole and size else 0.0)
            last = r.last
        return pd.DataFrame({"__b": blocks.sort_values("__b")["__b"].to_numpy(), "enters": out})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        xs, out, z = part["__x"].to_numpy(), np.empty(len(part)), np.array(part["enters"].iloc[0])
        for p, q in pieces(part):
            out[p:q] = through(xs[p:q], z)[0]
            z = np.zeros(size)
        return part[[*by, order]].assign(filtered=out)

    summary = rows.select("__b", "rank", "__s", "__x").groupBy("__b").applyInPandas(leaves, "__b bigint, first string, last string, whole boolean, n bigint, z array<double>")
    enters = summary.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(chained, "__b bigint, enters array<double>")
    schema = T.StructType([*rows.select(*by, order).schema.fields, T.StructField("filtered", T.DoubleType())])
    return rows.join(enters, "__b").groupBy("__b").applyInPandas(run, schema)


def interp1(knots: DataFrame, queries: DataFrame, x: str, y: str, q: str, by: list[str] | None = None, fill: float = float("nan")) -> DataFrame:
    """Add ``interpolated``: knots and queries are ordered together, and each query takes the knots around it.

    One order of the union replaces a range join, and every query's row goes with it. ``by`` names independent series.
    """
    by = by or []
    row = F.struct(*[F.col(c) for c in queries.columns])
    asked = queries.select(*by, F.col(q).cast("double").alias("__p"), F.lit(1).alias("__q"), F.lit(None).cast("double").alias("__y"), row.alias("__row"))
    known = knots.select(*by, F.col(x).cast("double").alias("__p"), F.lit(0).alias("__q"), F.col(y).cast("double").alias("__y"), F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"))
    both = known.unionByName(asked)
    knot = F.when(F.col("__q") == 0, F.struct(F.col("__p").alias("x"), F.col("__y").alias("y")))
    near = last_and_next(both, by, ["__p", "__q"], knot).where("__q = 1")
    lo, hi = F.col("lo"), F.col("hi")
    at = lo["y"] + (hi["y"] - lo["y"]) * F.try_divide(F.col("__p") - lo["x"], hi["x"] - lo["x"])
    value = F.when(lo["x"] == F.col("__p"), lo["y"]).when(lo.isNull() | hi.isNull(), F.lit(fill)).otherwise(at)
    return near.select("__row.*", value.alias("interpolated"))


def dft_power(df: DataFrame, by: list[str], order: str, value: str, n: int) -> DataFrame:
    """(by, f, re, im) of each series' discrete transform of length n, by a join with n twiddles each.

    For short series. Values beyond n are dropped and missing ones are zero, as padding does.
    """
    rows = df.where(F.col(order) < n).select(*by, F.col(order).alias("__k"), F.col(value).cast("double").alias("__v"))
    waves = rows.select(*by, "__k", "__v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("f"))
    turn = F.pmod(F.col("f") * F.col("__k"), F.lit(n)) * F.lit(-2 * 3.141592653589793 / n)
    return waves.groupBy(*by, "f").agg(F.sum(F.col("__v") * F.cos(turn)).alias("re"), F.sum(F.col("__v") * F.sin(turn)).alias("im"))


def polyfit_line(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Coefficients, highest power first, from sums of moments: one aggregate, whatever the rows."""
    moments = [F.sum(F.pow(F.col(x).cast("double"), F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)]
    mixed = [F.sum(F.pow(F.col(x).cast("double"), F.lit(float(k))) * F.col(y)).alias(f"t{k}") for k in range(degree + 1)]
    r = df.agg(*moments, *mixed).first()
    gram = np.array([[r[f"s{p + q}"] for q in range(degree + 1)] for p in range(degree + 1)])
    return np.linalg.solve(gram, np.array([r[f"t{p}"] for p in range(degree + 1)]))[::-1].tolist()


def polyfit(df: DataFrame, x: str | Column, y: str | Column, degree: int) -> list[float]:
    """Coefficients, highest power first, by the triangular factor of the powers beside ``y``: conditions are not squared.

    Every partition reduces its own rows; what reaches the driver has the square of ``degree`` + 2 numbers.
    """
    from gridloom.operators import linalg

    at = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    powers = [F.pow(at(x), F.lit(float(k))) for k in range(degree, -1, -1)]
    rows = df.select(F.array(*powers, at(y)).alias("r")).where(~F.exists("r", lambda v: v.isNull()))
    r = linalg.triangle(rows, degree + 2)
    if len(r) <= degree:
        raise ValueError("fewer rows than coefficients")
    return np.linalg.solve(r[: degree + 1, : degree + 1], r[: degree + 1, degree + 1]).tolist()
