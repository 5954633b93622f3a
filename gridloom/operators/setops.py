"""Set operations on the values of matrices: distinct, ascending, as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.matrix import Matrix, numbered


def values(a: Matrix) -> DataFrame:
    return a.df.select((F.col("v") + 0.0).alias("v")).distinct()


def _column(found: DataFrame) -> Matrix:
    ranked = numbered(found, ["v"]).select(F.col("rank").alias("i"), F.lit(0).cast("bigint").alias("j"), "v")
    return Matrix(ranked, ranked.count(), 1)


def unique(a: Matrix) -> Matrix:
    return _column(values(a))


def union(a: Matrix, b: Matrix) -> Matrix:
    return _column(values(a).unionByName(values(b)).distinct())


def intersect(a: Matrix, b: Matrix) -> Matrix:
    return _column(values(a).join(values(b), "v", "left_semi"))


def setdiff(a: Matrix, b: Matrix) -> Matrix:
    return _column(values(a).join(values(b), "v", "left_anti"))


def setxor(a: Matrix, b: Matrix) -> Matrix:
    both = values(a).unionByName(values(b)).groupBy("v").count()
    return _column(both.where("count = 1").select("v"))


def ismember(a: Matrix, s: Matrix) -> Matrix:
    """A mask of A's shape."""
    flagged = a.df.join(values(s).withColumn("k", F.lit(True)), "v", "left")
    return Matrix(flagged.select("i", "j", F.coalesce("k", F.lit(False)).alias("v")), a.m, a.n, True)


def issubset(a: Matrix, s: Matrix) -> bool:
    return values(a).join(values(s), "v", "left_anti").isEmpty()
