"""Shapes of distributions as tables: quantiles, boxes, densities, stacked bands."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.shared import materialize
from gridloom.operators.matrix import ROW, Matrix
from gridloom.operators.scans import numbered


def quantiles(df: DataFrame, by: str, value: str, at: Sequence[float]) -> DataFrame:
    """(by, q, v): exact quantiles of each group, between neighbours by straight lines.

    Values are ranked over the whole table and fetched by their rank, so no task holds a group.
    Null and NaN values are left out; a group without values has no rows; a null group is one group.
    """
    kept = df.select(F.col(by).alias("__g"), F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    ranked = materialize(numbered(kept, ["__g", "__v"]), "ranked")
    groups = ranked.groupBy("__g").agg(F.min("rank").alias("__start"), F.count(F.lit(1)).alias("__n"))
    wanted = groups.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at])))
    place = (F.col("__n") - 1) * F.col("q")
    share = place - F.floor(place)
    ends = F.array(F.struct(F.floor(place).alias("p"), (1 - share).alias("w")), F.struct(F.ceil(place).alias("p"), share.alias("w")))
    ends = wanted.withColumn("__e", F.explode(ends)).select("__g", "q", (F.col("__start") + F.col("__e.p")).alias("rank"), F.col("__e.w").alias("w"))
    found = ends.join(ranked.select("rank", "__v"), "rank")
    # A weight of nothing adds nothing, next to infinite values too.
    part = F.when(F.col("w") == 0, F.lit(0.0)).otherwise(F.col("w") * F.col("__v"))
    return found.groupBy("__g", "q").agg(F.sum(part).alias("v")).withColumnRenamed("__g", by)


def boxes(df: DataFrame, by: str, value: str, reach: float = 1.5) -> DataFrame:
    """(by, n, q1, median, q3, low, high, outside): the box of each group.

    Whiskers end at the furthest values within ``reach`` box heights of the box; ``outside`` counts those beyond.
    """
    q = quantiles(df, by, value, (0.25, 0.5, 0.75))
    pick = lambda x: F.max(F.when(F.col("q") == x, F.col("v")))
    box = materialize(q.groupBy(by).agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3")), "boxes")
    v = F.col("__v")
    # Equal values of a group become one row before they meet its box.
    counts = df.select(by, F.col(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v)).groupBy(by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    own, other = counts.alias("a"), box.alias("b")
    met = own.join(other, F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}"))).select(F.col(f"a.{by}").alias(by), "__v", "__c", "q1", "median", "q3")
    span = (F.col("q3") - F.col("q1")) * reach
    inside = v.between(F.col("q1") - span, F.col("q3") + span)
    when = lambda x: F.when(inside, x)
    return met.groupBy(by, "q1", "median", "q3").agg(
        F.sum("__c").alias("n"), F.min(when(v)).alias("low"), F.max(when(v)).alias("high"), F.sum(F.when(inside, 0).otherwise(F.col("__c"))).alias("outside")
    )


def density(df: DataFrame, value: str, points: Sequence[float], width: float) -> DataFrame:
    """(x, d): the Gaussian kernel density of all values at the given points, in one pass. No values, no rows."""
    if width <= 0:
        raise ValueError("a kernel needs a width")
    v = F.col(value).cast("double")
    scale = 1 / (width * math.sqrt(2 * math.pi))
    kernel = lambda x: F.avg(F.exp(-F.pow((v - x) / width, 2) / 2)) * scale
    sums: Column = F.array(*[F.struct(F.lit(float(x)).alias("x"), kernel(x).alias("d")) for x in points])
    return df.where(v.isNotNull() & ~F.isnan(v)).agg(sums.alias("s")).select(F.explode("s").alias("s")).select("s.x", "s.d").where(F.col("d").isNotNull())


def bands(a: Matrix) -> DataFrame:
    """(i, j, low, high): the columns of each row stacked upon one another."""
    top = a.cumsum(ROW).df.select("i", "j", F.col("v").alias("high"))
    return top.join(a.df.select("i", "j", "v"), ["i", "j"]).select("i", "j", (F.col("high") - F.col("v")).alias("low"), "high")
