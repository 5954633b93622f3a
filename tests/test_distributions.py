"""Quantiles, boxes and densities against numpy, with groups of one row, ties, nulls and NaN."""

import math

import numpy as np
import pytest

from gridloom.operators import distributions

GROUPS = {"a": [5.0], "b": [1.0, 1.0, 1.0, 9.0], "c": [float(k * k % 31) for k in range(40)] + [900.0, -700.0], None: [2.0, 4.0]}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g, v) for g, vs in GROUPS.items() for v in vs] + [("b", None), ("c", math.nan), ("d", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(3)


def test_quantiles_are_exact(table):
    at = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {(r["g"], r["q"]): r["v"] for r in distributions.quantiles(table, "g", "v", at).collect()}
    assert set(got) == {(g, q) for g in GROUPS for q in at}
    for (g, q), v in got.items():
        assert v == pytest.approx(np.quantile(GROUPS[g], q))


def test_boxes(table):
    got = {r["g"]: r for r in distributions.boxes(table, "g", "v").collect()}
    assert set(got) == set(GROUPS)
    for g, vs in GROUPS.items():
        a, b = np.quantile(vs, [0.25, 0.75])
        inside = [v for v in vs if a - 1.5 * (b - a) <= v <= b + 1.5 * (b - a)]
        r = got[g]
        assert (r["n"], r["low"], r["high"], r["outside"]) == (len(vs), min(inside), max(inside), len(vs) - len(inside))


def test_density_and_empty_tables(table):
    values = np.array([v for vs in GROUPS.values() for v in vs])
    for r in distributions.density(table, "v", [0.0, 3.5, 900.0], 2.0).collect():
        assert r["d"] == pytest.approx(np.exp(-(((values - r["x"]) / 2.0) ** 2) / 2).mean() / (2.0 * math.sqrt(2 * math.pi)))
    empty = table.where("g = 'none'")
    assert not distributions.density(empty, "v", [0.0], 1.0).collect()
    assert not distributions.boxes(empty, "g", "v").collect()
