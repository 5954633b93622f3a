"""Transforms of long series and implicit Q against numpy, with strides and trees of many nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import implicit, signal, spectrum
from gridloom.operators.matrix import Matrix

RNG = np.random.default_rng(4)


def put(spark, x):
    return spark.createDataFrame([(k, float(v.real), float(v.imag)) for k, v in enumerate(np.asarray(x, complex))], "k long, re double, im double")


def get(df, n):
    out = np.zeros(n, complex)
    for r in df.collect():
        out[r["k"]] += r["re"] + 1j * r["im"]
    return out


@pytest.mark.parametrize("n, stride", [(1, 4), (2, 4), (12, 4), (30, 6), (13, 4), (22, 4), (64, 8)])
def test_transforms(spark, n, stride, monkeypatch):
    """Lengths of two factors, primes, and lengths with one factor beyond a stride."""
    monkeypatch.setattr(spectrum, "AT_ONCE", 8)
    monkeypatch.setattr(spectrum, "STRIDE", max(stride, 8) if n in (13, 22) else stride)
    x = RNG.normal(size=n) + 1j * RNG.normal(size=n)
    assert np.allclose(get(spectrum.transform(put(spark, x), n), n), np.fft.fft(x))
    assert np.allclose(get(spectrum.transform(put(spark, x), n, inverse=True), n), np.fft.ifft(x))


def test_places_that_are_absent_or_beyond(spark):
    x = np.array([1.0, 0.0, 2.0, 0.0, 0.0, 0.0])
    assert np.allclose(get(spectrum.transform(put(spark, x).where("re <> 0"), 6), 6), np.fft.fft(x))


def test_large_squares_are_exact():
    k = np.array([2**40 + 3, 5, 2**31 + 1])
    for m in (2**33 + 2, 2**41 + 6, 97):
        assert spectrum._square(k, m).tolist() == [int(v) ** 2 % m for v in k.tolist()]


@pytest.mark.parametrize("n", [9, 10])
def test_half_spectra(spark, n):
    x, y = RNG.normal(size=n), RNG.normal(size=n)
    a, b = spectrum.HalfSpectrum.of(put(spark, x), n).written(), spectrum.HalfSpectrum.of(put(spark, y), n).written()
    half = n // 2 + 1
    assert np.allclose(get(a.df, half), np.fft.rfft(x))
    real = lambda s: np.array([r["v"] for r in s.inverse().orderBy("k").collect()])
    assert np.allclose(real(a), x)
    assert np.allclose(real(a.mul(b)), np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), n))
    assert np.allclose(get(a.conj().scaled(2.0).df, half), 2 * np.fft.rfft(x).conj())
    assert np.allclose(get(a.power().df, half), np.abs(np.fft.rfft(x)) ** 2) and np.allclose(get(a.abs().df, half), np.abs(np.fft.rfft(x)))
    with pytest.raises(ValueError):
        a.mul(spectrum.HalfSpectrum.of(put(spark, x), n + 1))


@pytest.mark.parametrize("n, m, block", [(17, 3, 5), (3, 17, 5), (17, 9, 4), (1, 1, 4)])
def test_convolutions(spark, n, m, block):
    """A long and a short series by blocks, two long ones by half spectra."""
    x, y = RNG.normal(size=n), RNG.normal(size=m)
    got = signal.conv(Matrix.of(spark, [x.tolist()]), Matrix.of(spark, [y.tolist()]), block)
    assert got.shape == (1, n + m - 1)
    assert np.allclose([r["v"] for r in got.df.orderBy("j").collect()], np.convolve(x, y))


def test_spectra_of_short_tables_are_not_broadcast(spark):
    """A short series' spectrum has the padded length; sent to all tasks, it would pass the driver."""
    a, b = put(spark, RNG.normal(size=40)), put(spark, RNG.normal(size=3))
    made = spectrum.product(spectrum.transform(a, 64), spectrum.transform(b, 64))
    assert np.allclose(get(made, 64), get(spectrum.transform(a, 64), 64) * get(spectrum.transform(b, 64), 64))
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def cells(a):
    out = np.zeros(a.shape)
    for i, j, v in a.df.select("i", "j", "v").collect():
        out[i, j] = v
    return out


@pytest.mark.parametrize("rows, fan", [(8, 2), (3, 3), (100, 8)])
def test_implicit_q(spark, rows, fan, monkeypatch):
    """Leaves of more and of fewer rows than there are columns, trees of one and of many levels."""
    monkeypatch.setattr(implicit, "FAN_IN", fan)
    a, b = RNG.normal(size=(41, 5)), RNG.normal(size=(41, 3))
    f = implicit.qr(Matrix.of(spark, a.tolist()), rows)
    r = cells(f.r())
    assert np.allclose(np.abs(r), np.abs(np.linalg.qr(a)[1])) and not np.tril(r, -1).any()
    top, stay = f.up(Matrix.of(spark, b.tolist()))
    assert np.allclose(cells(f.down(top, stay, 3)), b)
    q = np.linalg.qr(a)[0]
    assert np.allclose(cells(f.down(top, None, 3)), q @ (q.T @ b))
    assert np.allclose(cells(f.down(f.triangle().select(F.col("r").alias("x")), None, 5)), a)
    x, norms = f.least_squares(Matrix.of(spark, b.tolist()))
    want = np.linalg.lstsq(a, b, rcond=None)[0]
    assert np.allclose(cells(x), want) and np.allclose(norms, np.linalg.norm(b - a @ want, axis=0))


def test_implicit_q_of_dependent_columns(spark):
    a = RNG.normal(size=(20, 3))
    a[:, 2] = a[:, 0]
    f = implicit.qr(Matrix.of(spark, a.tolist()), 6)
    assert np.allclose(cells(f.down(f.triangle().select(F.col("r").alias("x")), None, 3)), a)
    with pytest.raises(Exception, match="depend"):
        f.least_squares(Matrix.of(spark, a[:, :1].tolist()))[0].df.collect()
