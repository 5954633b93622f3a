"""Matrices read from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.matrix import Matrix


def from_arrays(df: DataFrame, row_col: str, array_col: str, m: int, n: int) -> Matrix:
    """One row per ``row_col``, its elements from an array; elements become doubles first.

    A null array is no row; rows are at hand for products, where a null element is NaN.
    """
    packed = df.where(F.col(array_col).isNotNull()).select(F.col(row_col).cast("bigint").alias("i"), F.transform(array_col, lambda x: x.cast("double")).alias("r"))
    cells = df.select(F.col(row_col).cast("bigint").alias("i"), F.posexplode(array_col).alias("j", "x"))
    return Matrix(cells.select("i", F.col("j").cast("bigint").alias("j"), F.col("x").cast("double").alias("v")), m, n, packed=packed)


def from_columns(df: DataFrame, row_col: str, columns: list[str], m: int) -> Matrix:
    """Numeric columns side by side; ``row_col`` holds the 0-based row index."""
    pairs = F.array(*[F.struct(F.lit(k).cast("bigint").alias("j"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)])
    cells = df.select(F.col(row_col).cast("bigint").alias("i"), F.inline(pairs))
    return Matrix(cells, m, len(columns))


def from_cells(df: DataFrame, m: int, n: int, i: str = "i", j: str = "j", v: str = "v") -> Matrix:
    return Matrix(df.select(F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j"), F.col(v).cast("double").alias("v")), m, n)


def read_cells(spark: SparkSession, path: str, m: int, n: int, fmt: str = "parquet", **options) -> Matrix:
    """Cells from Parquet, ORC, JSON or CSV with a header."""
    if fmt == "csv":
        options = {"header": True} | options
        return from_cells(spark.read.schema("i bigint, j bigint, v double").options(**options).csv(path), m, n)
    return from_cells(spark.read.format(fmt).options(**options).load(path), m, n)
