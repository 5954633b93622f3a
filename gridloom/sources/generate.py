"""Matrices made from index arithmetic over ``spark.range``: nothing is built on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import ieee
from gridloom.operators.matrix import Matrix

#: Cells that one matrix may have at most (bigint indices of the flat order).
MOST_CELLS = 1 << 62
#: Rows and columns of a tile, whose cells are made together, and tiles that a task makes.
TILE, TILES = 1024, 16
#: Elements of a vector that every task may get, 32 MB.
MOST_SENT = 1 << 22


def require_allocatable(m: int, n: int) -> None:
    if m < 0 or n < 0:
        raise ValueError("a shape is not negative")
    if m * n > MOST_CELLS:
        raise OverflowError("too many cells")


def grid(spark: SparkSession, m: int, n: int, value: Column) -> Matrix:
    """``value``, an expression of i and j, at every cell. The flat range needs no join."""
    require_allocatable(m, n)
    cells = spark.range(m * n).select(F.floor(F.col("id") / max(n, 1)).cast("bigint").alias("i"), (F.col("id") % max(n, 1)).alias("j"))
    return Matrix(cells.select("i", "j", value.cast("double").alias("v")), m, n)


def _tasks(spark: SparkSession, m: int, n: int) -> int:
    """Tasks that make an m x n matrix, of TILES tiles of cells at most where there are more than cores."""
    many = -(-m // TILE) * -(-n // TILE)
    return max(1, min(many, max(spark.sparkContext.defaultParallelism, -(-many // TILES))))


def _tiles(spark: SparkSession, m: int, n: int) -> tuple[DataFrame, int]:
    """(p, q) of every tile of an m x n matrix, and the number of tasks that make them."""
    require_allocatable(m, n)
    along, tasks = -(-n // TILE), _tasks(spark, m, n)
    return spark.range(0, -(-m // TILE) * along, 1, tasks).select(F.floor(F.col("id") / max(along, 1)).cast("bigint").alias("p"), (F.col("id") % max(along, 1)).alias("q")), tasks


def _cells(tiles: DataFrame, m: int, n: int, value: Column) -> Matrix:
    """Cells of tiles, row by row within each; ``value`` is an expression of i, j and the tile's columns.

    A tile has few different indices, which are written as small codes; whole rows of a wide matrix have too many.
    """
    ahead = lambda at, most: F.explode(F.sequence(F.col(at) * TILE, F.least(F.col(at) * TILE + TILE, F.lit(most).cast("bigint")) - 1))
    return Matrix(tiles.withColumn("i", ahead("p", m)).withColumn("j", ahead("q", n)).select("i", "j", value.cast("double").alias("v")), m, n)


def tiled(spark: SparkSession, m: int, n: int, value: Column, told: DataFrame | None = None) -> Matrix:
    """As ``grid``, in strips of as many columns as a tile has, row by row within each, for large matrices that are written.

    ``value`` may use the columns of ``told`` too, one row that every task gets. Only j is exploded: rows of strips are a range, so that
    all is one loop of compiled code, which took a seventh of the time of two explosions.
    """
    require_allocatable(m, n)
    high = max(m, 1)
    rows = spark.range(0, m * -(-n // TILE), 1, _tasks(spark, m, n)).select(F.expr(f"id div {high}").alias("q"), F.expr(f"id % {high}").alias("i"))
    rows = rows if told is None else rows.crossJoin(F.broadcast(told))
    ahead = F.explode(F.sequence(F.col("q") * TILE, F.least(F.col("q") * TILE + TILE, F.lit(n).cast("bigint")) - 1))
    return Matrix(rows.withColumn("j", ahead).select("i", "j", value.cast("double").alias("v")), m, n)


def zeros(spark: SparkSession, m: int, n: int) -> Matrix:
    return grid(spark, m, n, F.lit(0.0))


def full(spark: SparkSession, m: int, n: int, value: float) -> Matrix:
    return grid(spark, m, n, F.lit(float(value)))


def eye(spark: SparkSession, n: int, scale: float = 1.0) -> Matrix:
    return tiled(spark, n, n, F.when(F.col("i") == F.col("j"), F.lit(float(scale))).otherwise(0.0))


def completed(df: DataFrame, m: int, n: int) -> Matrix:
    """Cells with zeros where ``df`` has none."""
    every = zeros(df.sparkSession, m, n).df.drop("v")
    return Matrix(every.join(df, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")), m, n)


def span(spark: SparkSession, start: float, stop: float, step: float = 1.0, half_open: bool = False) -> Matrix:
    """start, start + step, … up to stop, included within 1e-12 or, half open, left out; empty if the sign is wrong."""
    if step == 0:
        raise ValueError("the step is zero")
    if half_open:
        n = max(0, math.ceil((stop - start) / step))
        return grid(spark, 1 if n else 0, n, F.lit(float(start)) + F.col("j") * F.lit(float(step)))
    n = max(0, int((stop - start) / step + 1e-12) + 1) if (stop - start) / step >= -1e-12 else 0
    return grid(spark, 1 if n else 0, n, F.lit(float(start)) + F.col("j") * F.lit(float(step)))


def linspace(spark: SparkSession, a: float, b: float, n: int = 100) -> Matrix:
    """n points with the end set exactly; one point is b."""
    if n <= 0:
        return zeros(spark, 0, 0)
    step = (b - a) / (n - 1) if n > 1 else 0.0
    return grid(spark, 1, n, F.when(F.col("j") == n - 1, F.lit(float(b))).otherwise(F.lit(float(a)) + F.col("j") * step))


def logspace(spark: SparkSession, a: float, b: float, n: int = 50) -> Matrix:
    return linspace(spark, a, b, n).map_elems(lambda x: F.pow(F.lit(10.0), x))


def hilb(spark: SparkSession, n: int, digits: int | None = None) -> Matrix:
    """Reciprocals of i + j + 1, rounded if it is asked for."""
    own = 1.0 / (F.col("i") + F.col("j") + 1)
    return tiled(spark, n, n, own if digits is None else ieee.rounded(own, digits))


def pascal(spark: SparkSession, n: int) -> Matrix:
    """Symmetric binomials; i + j stays below 21, so that factorials are exact."""
    if n > 10:
        raise ValueError("at most 10")
    f = F.factorial
    return grid(spark, n, n, f((F.col("i") + F.col("j")).cast("int")) / (f(F.col("i").cast("int")) * f(F.col("j").cast("int"))))


def wilkinson(spark: SparkSession, n: int) -> Matrix:
    d = F.abs(F.col("i") - F.col("j"))
    return tiled(spark, n, n, F.when(d == 0, F.abs(F.col("i") - (n - 1) / 2)).when(d == 1, 1.0).otherwise(0.0))


def _whole(vector: DataFrame, first: int, many: int) -> DataFrame:
    """(x): the elements ``first``, ``first`` + 1, … of a vector (k, v) as one row; zero where it has none."""
    places = vector.sparkSession.range(first, first + max(many, 0)).withColumnRenamed("id", "k").join(vector, "k", "left")
    held = F.array_sort(F.collect_list(F.struct("k", F.coalesce("v", F.lit(0.0)).alias("v"))))
    return places.agg(F.transform(held, lambda e: e["v"]).alias("x"))


def _from_vector(spark: SparkSession, m: int, n: int, sign: int, vector: DataFrame) -> Matrix:
    """The element i + sign · j of a vector (k, v) at every cell, zero where it has none.

    Every task gets the vector. A very long one is cut into pieces of twice a tile's side, which go to the tiles. No cell is shuffled.
    """
    if m + n <= MOST_SENT:
        first = 0 if sign > 0 else 1 - n
        return tiled(spark, m, n, F.get("x", (F.col("i") + sign * F.col("j") - first).cast("int")), _whole(vector, first, m + n - 1))
    down, along = -(-m // TILE), -(-n // TILE)
    least, most = (0, down + along - 2) if sign > 0 else (1 - along, down - 1)
    start = lambda s: s * TILE if sign > 0 else (s - 1) * TILE + 1
    places = spark.range((most - least + 1) * 2 * TILE).select((F.floor(F.col("id") / (2 * TILE)) + least).cast("bigint").alias("s"), (F.col("id") % (2 * TILE)).alias("at"))
    held = places.withColumn("k", start(F.col("s")) + F.col("at")).join(vector, "k", "left").select("s", F.struct("at", F.coalesce("v", F.lit(0.0)).alias("v")).alias("m"))
    pieces = held.groupBy("s").agg(F.transform(F.array_sort(F.collect_list("m")), lambda e: e["v"]).alias("x"))
    tiles, tasks = _tiles(spark, m, n)
    met = tiles.withColumn("s", F.col("p") + sign * F.col("q")).join(pieces, "s").repartition(tasks, "p", "q")
    return _cells(met, m, n, F.get("x", (F.col("i") + sign * F.col("j") - start(F.col("s"))).cast("int")))


def _flat(x: Matrix) -> DataFrame:
    return x.df.select((F.col("i") * x.n + F.col("j")).alias("k"), "v")


def toeplitz(c: Matrix, r: Matrix | None = None) -> Matrix:
    """From the first column and the first row."""
    r = r or c
    both = _flat(c).unionByName(_flat(r).where("k > 0").select((-F.col("k")).alias("k"), "v"))
    return _from_vector(c.spark, c.numel(), r.numel(), -1, both)


def hankel(c: Matrix, r: Matrix | None = None) -> Matrix:
    """From the first column and the last row; without a row, zeros past the anti-diagonal."""
    m, n = c.numel(), (r or c).numel()
    both = _flat(c)
    if r is not None:
        both = both.unionByName(_flat(r).where("k > 0").select((F.col("k") + m - 1).alias("k"), "v"))
    return _from_vector(c.spark, m, n, 1, both)


def vander(x: Matrix, cols: int = -1) -> Matrix:
    """Descending powers of a vector's elements."""
    n = x.numel() if cols < 0 else cols
    powers = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = _flat(x).select(F.col("k").alias("i"), powers.alias("j"), "v").select("i", F.col("j").cast("bigint").alias("j"), F.pow("v", n - 1 - F.col("j")).alias("v"))
    return Matrix(out, x.numel(), n)


def magic(spark: SparkSession, n: int) -> Matrix:
    """Magic squares in closed form: odd orders by two diagonals, multiples of four by reflection, others from quarters."""
    if n < 1 or n == 2:
        raise ValueError("no magic square of this order")
    i, j = F.col("i"), F.col("j")

    def odd(size: int, a: Column, b: Column) -> Column:
        return size * F.pmod(a + b + 1 + size // 2, F.lit(size)) + F.pmod(a + 2 * b + 1, F.lit(size)) + 1

    # Cells of one anti-diagonal have neighbouring values, and are made together.
    if n % 2:
        require_allocatable(n, n)
        places = spark.range(n * n).select((F.col("id") % n).alias("i"), F.pmod(F.floor(F.col("id") / n) - F.col("id") % n, F.lit(n)).cast("bigint").alias("j"))
        return Matrix(places.select("i", "j", odd(n, i, j).cast("double").alias("v")), n, n)
    if n % 4 == 0:
        straight = i * n + j + 1
        keep = F.when((i % 4).isin(0, 3), (j % 4).isin(0, 3)).otherwise((j % 4).isin(1, 2))
        return grid(spark, n, n, F.when(keep, n * n + 1 - straight).otherwise(straight))
    h, q = n // 2, (n - 2) // 4
    require_allocatable(n, n)
    # Places of one anti-diagonal, each in all four quarters.
    place, turn = F.floor(F.col("id") / 4) % h, F.floor(F.col("id") / (4 * h))
    cells = spark.range(n * n).select(place.cast("bigint").alias("a"), F.pmod(turn - place, F.lit(h)).cast("bigint").alias("b"), (F.col("id") % 4).alias("c"))
    a, b, low, right = F.col("a"), F.col("b"), F.col("c") >= 2, F.col("c") % 2 == 1
    at = F.when(right, b + h).otherwise(b)
    swapped = F.when(a == h // 2, (at >= 1) & (at <= q)).otherwise(at < q) | (at >= n - q + 1)
    down = low != swapped
    quarter = F.when(~down & ~right, 0).when(down & right, 1).when(~down & right, 2).otherwise(3)
    return Matrix(cells.select(F.when(low, a + h).otherwise(a).alias("i"), at.alias("j"), (odd(h, a, b) + F.lit(h * h).cast("bigint") * quarter).cast("double").alias("v")), n, n)


def magic_lines(n: int) -> tuple[int, Callable[[int], Iterator[tuple]]]:
    """(lines, line): the elements of ``magic`` line by line, for tasks that make them as arrays.

    ``line(s)`` yields (i, j, v) in which no i and no j repeats, or i is one row; a line's elements are near one another, as are those of neighbouring lines.
    """
    if n < 1 or n == 2:
        raise ValueError("no magic square of this order")
    require_allocatable(n, n)

    def odd(size: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.arange(size)
        j = (s - i) % size
        return i, j, size * ((s + 1 + size // 2) % size) + (s + j + 1) % size + 1

    def by_four(s: int) -> Iterator[tuple]:
        i, j = n - 1 - s // 2 if s % 2 else s // 2, np.arange(n)
        straight, middle = i * n + j + 1, (j % 4 == 1) | (j % 4 == 2)
        yield i, j, np.where(~middle if i % 4 in (0, 3) else middle, n * n + 1 - straight, straight)

    h, q = n // 2, (n - 2) // 4

    def quarters(s: int) -> Iterator[tuple]:
        a, b, x = odd(h, s)
        for low in (False, True):
            for right in (False, True):
                at = b + h if right else b
                down = low != (np.where(a == h // 2, (at >= 1) & (at <= q), at < q) | (at >= n - q + 1))
                yield a + h if low else a, at, x + h * h * (np.where(down, 1, 2) if right else np.where(down, 3, 0))

    if n % 2:
        return n, lambda s: iter([odd(n, s)])
    return (n, by_four) if n % 4 == 0 else (h, quarters)


def rand(spark: SparkSession, m: int, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Matrix:
    """Uniform in [low, high); equal to other generators in distribution only."""
    return grid(spark, m, n, F.rand(seed) * (high - low) + low)


def randn(spark: SparkSession, m: int, n: int, seed: int = 0, mean: float = 0.0, stddev: float = 1.0) -> Matrix:
    return grid(spark, m, n, F.randn(seed) * stddev + mean)


def randi(spark: SparkSession, low: int, high: int, m: int, n: int, seed: int = 0) -> Matrix:
    """Integers in [low, high]."""
    return grid(spark, m, n, F.floor(F.rand(seed) * (high - low + 1)) + low)


def randperm(spark: SparkSession, n: int, seed: int = 0) -> Matrix:
    """A permutation of 0 … n-1, by sorting on random marks."""
    from gridloom.operators.scans import numbered

    marks = spark.range(n).select("id", F.rand(seed).alias("r"))
    return Matrix(numbered(marks, ["r", "id"]).select(F.lit(0).cast("bigint").alias("i"), F.col("rank").alias("j"), F.col("id").cast("double").alias("v")), 1, n)


def diagonal(x: Matrix) -> Matrix:
    """A vector as the diagonal of a square matrix."""
    if 1 not in x.shape:
        raise ValueError("not a vector")
    n = x.numel()
    if n <= MOST_SENT:
        return tiled(x.spark, n, n, F.when(F.col("i") == F.col("j"), F.get("x", F.col("i").cast("int"))).otherwise(0.0), _whole(_flat(x), 0, n))
    at = F.struct((F.col("k") % TILE).alias("at"), "v")
    pieces = _flat(x).groupBy(F.floor(F.col("k") / TILE).cast("bigint").alias("p")).agg(F.map_from_entries(F.collect_list(at)).alias("x"))
    pieces = pieces.select("p", F.col("p").alias("q"), F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(TILE - 1).cast("bigint")), lambda k: F.coalesce(F.try_element_at("x", k), F.lit(0.0))).alias("x"))
    tiles, tasks = _tiles(x.spark, n, n)
    met = tiles.join(pieces, ["p", "q"], "left").repartition(tasks, "p", "q")
    return _cells(met, n, n, F.when(F.col("i") == F.col("j"), F.get("x", (F.col("i") % TILE).cast("int"))).otherwise(0.0))
