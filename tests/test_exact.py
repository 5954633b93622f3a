"""Sums that do not depend on partitions, norms of any magnitude, and medians without an order."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import exact


def rows_of(spark, values, parts=4):
    return spark.createDataFrame([(k % 3, float(v) if v is not None else None) for k, v in enumerate(values)], "k long, v double").repartition(parts)


def test_what_cancels_is_not_lost(spark):
    for parts in (1, 2, 3):
        assert exact.total(rows_of(spark, [1e16, 1.0, -1e16], parts), "v").first()["total"] == 1.0


def test_sums_are_those_of_fractions(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=3000) * 10.0 ** rng.integers(-250, 250, 3000)
    v = [*v, *(-v[:1500]), 5e-324, 0.1, -0.0, None]
    want = {k: float(sum(Fraction(float(x)) for x in v[k::3] if x is not None)) for k in range(3)}
    assert dict(exact.total(rows_of(spark, v), "v", ["k"]).collect()) == want
    assert exact.total(rows_of(spark, v, 7), "v").first()[0] == float(sum(Fraction(float(x)) for x in v if x is not None))


def test_odd_sums(spark):
    of = lambda *v: exact.total(rows_of(spark, v), "v").first()["total"]
    assert of(math.inf, 1.0) == math.inf and of(-math.inf, 1.0) == -math.inf
    assert math.isnan(of(math.inf, -math.inf)) and math.isnan(of(math.nan, 1.0))
    assert of(1.7e308, 1.7e308) == math.inf and of(1.7e308, 1.7e308, -1.7e308) == 1.7e308
    assert exact.total(rows_of(spark, [None]), "v", ["k"]).count() == 0


def test_norms(spark):
    of = lambda *v: exact.norm(rows_of(spark, v), "v").first()["norm"]
    assert math.isclose(of(3e200, 4e200, 1.0), 5e200) and math.isclose(of(3e-200, 4e-200), 5e-200) and of(0.0, -0.0) == 0
    assert of(math.inf, 1.0) == math.inf and math.isnan(of(math.nan, math.inf)) and of(1.7e308, 1.7e308) == math.inf
    v = np.random.default_rng(2).normal(size=500)
    assert math.isclose(of(*v), np.linalg.norm(v))


@pytest.mark.parametrize("bins, sent", [(4, 100), (1024, 0)])
def test_medians(spark, bins, sent, monkeypatch):
    monkeypatch.setattr(exact, "MOST_SENT", sent)
    rng = np.random.default_rng(3)
    groups = {1: rng.normal(size=101), 2: np.append(np.full(300, 7.0), rng.normal(size=299) * 1e6), None: rng.integers(0, 3, 50), 4: [2.0], 5: [1e308, -1e308, 3.0, 4.0], 6: [-0.0, 0.0], 7: [math.inf, 1.0, 2.0, -math.inf, 5.0]}
    data = [(k, float(x)) for k, v in groups.items() for x in v] + [(8, None), (1, math.nan)]
    df = spark.createDataFrame(data, "k long, v double")
    got = dict(exact.median(df, "v", ["k"], bins).collect())
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == np.median(np.asarray(v, float)), k
    every = [x for _, x in data if x is not None and not math.isnan(x)]
    assert exact.median(df, "v", bins=bins).first()[0] == np.median(every)
    assert exact.nth(df, "v", 5, bins=bins).first()[0] == sorted(every)[5]
    assert exact.median(df.where(F.lit(False)), "v").count() == 0


def test_rounding_is_that_of_sql(spark):
    """Halves go away from zero, and what has no decimals, or is not a number, stays."""
    import duckdb

    from gridloom.functions import ieee

    v = [1 / 64, -1 / 64, 2.5e-5, -0.0, 1e300, 1e308, -7.123455, float("inf"), float("nan")]
    want = [r[0] for r in duckdb.sql(f"SELECT round(unnest({[repr(x) for x in v]}::DOUBLE[]), 5) + 0.0").fetchall()]
    got = [r["v"] for r in rows_of(spark, v, 1).select(ieee.rounded(F.col("v"), 5).alias("v")).collect()]
    assert list(map(repr, got)) == list(map(repr, want))
