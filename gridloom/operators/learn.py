"""Perceptrons over tables of features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that the sequential trainer takes at most; its order matters, so it runs in one place.
MOST_ROWS = 100_000

#: Logic functions by name.
LOGIC: dict[str, Callable] = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "nand": lambda a, b: ~(a & b), "nor": lambda a, b: ~(a | b), "xor": lambda a, b: a != b}


def truth_table(spark: SparkSession, f: Callable, bias: bool = True) -> DataFrame:
    """All pairs of booleans with ``y = f(a, b)`` and, if asked, a constant feature."""
    two = spark.range(2).select((F.col("id") == 1).alias("a"))
    rows = two.crossJoin(two.withColumnRenamed("a", "b")).withColumn("y", f(F.col("a"), F.col("b")))
    return rows.withColumn("one", F.lit(1.0)) if bias else rows


def predict(df: DataFrame, features: list[str], weights: list[float], level: float = 0.0) -> DataFrame:
    """Add ``predicted``: the weighted sum is above ``level``."""
    total = sum((F.col(f).cast("double") * F.lit(float(w)) for f, w in zip(features, weights)), F.lit(0.0))
    return df.withColumn("predicted", total > level)


def train_online(df: DataFrame, features: list[str], target: str, rate: float = 1.0, epochs: int = 100, seed: int = 1) -> tuple[list[float], int]:
    """(weights, epochs used or -1) of the online rule, rows in a new order each epoch."""
    rows = df.select(*[F.col(f).cast("double") for f in features], F.col(target).cast("double")).limit(MOST_ROWS + 1).toPandas().to_numpy()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for the online rule; use train_batch()")
    rng, w = np.random.default_rng(seed), np.zeros(len(features))
    for epoch in range(1, epochs + 1):
        wrong = 0
        for k in rng.permutation(len(rows)):
            x, y = rows[k, :-1], rows[k, -1]
            miss = y - (x @ w > 0)
            w += rate * miss * x
            wrong += miss != 0
        if not wrong:
            return w.tolist(), epoch
    return w.tolist(), -1


def train_batch(df: DataFrame, features: list[str], target: str, rate: float = 1.0, epochs: int = 100) -> tuple[list[float], int]:
    """The same rule over all mistakes at once: one aggregate an epoch, for any number of rows."""
    w, n = [0.0] * len(features), max(1, df.count())
    for epoch in range(1, epochs + 1):
        miss = F.col(target).cast("double") - F.col("predicted").cast("double")
        sums = predict(df, features, w).agg(F.sum(F.abs(miss)).alias("wrong"), *[F.sum(miss * F.col(f).cast("double")).alias(f"s{k}") for k, f in enumerate(features)]).first()
        if not sums["wrong"]:
            return w, epoch
        w = [x + rate * sums[f"s{k}"] / n for k, x in enumerate(w)]
    return w, -1


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts in equal bins, the last one closed."""
    at = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("bigint")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, xs: tuple[float, float], ys: tuple[float, float], bins: int) -> DataFrame:
    """(bx, by, n): counts in a grid of equal bins over both ranges, the last ones closed."""
    at = lambda c, ends: F.least(F.floor((F.col(c) - ends[0]) / (ends[1] - ends[0]) * bins), F.lit(bins - 1)).cast("bigint")
    inside = df.where(F.col(x).between(*xs) & F.col(y).between(*ys))
    return inside.groupBy(at(x, xs).alias("bx"), at(y, ys).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def hexbin(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """(cx, cy, n): counts by the nearest of the hexagon centres, which are two shifted grids of width x width·√3."""
    height = width * 3**0.5
    a = (F.round(F.col(x) / width) * width, F.round(F.col(y) / height) * height)
    b = ((F.floor(F.col(x) / width) + 0.5) * width, (F.floor(F.col(y) / height) + 0.5) * height)
    far = lambda c: (F.col(x) - c[0]) * (F.col(x) - c[0]) + (F.col(y) - c[1]) * (F.col(y) - c[1])
    first = far(a) <= far(b)
    centre = [F.when(first, a[k]).otherwise(b[k]) for k in (0, 1)]
    return df.groupBy(F.round(centre[0], 9).alias("cx"), F.round(centre[1], 9).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
