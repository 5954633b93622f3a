"""Aggregates that do not depend on how rows are dealt, and order statistics without an order.

``total`` adds doubles without rounding: each is a whole number of 53 bits at a power of two, in two halves, and Spark adds up
whole numbers by power. Partial sums merge in any order to the same digits, and only the last step rounds.
``norm`` keeps sums of squares by ranges of magnitude, so that none overflows or vanishes. ``median`` narrows the range that
holds the middle value by rounds of counts: rows are neither sorted nor moved, and a value that half of them share is no hot key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions.shared import materialize

#: Bits of the lower half of a significand; bits by which ranges of magnitude of a norm are apart.
LOW_BITS, RANGE_BITS = 26, 256
#: Ranges that a round of counting makes of each range.
BINS = 1024
#: Keys whose ranges are sent to every task; beyond, rows meet them by a shuffle.
MOST_SENT = 100_000

# Powers of two no double has, for what is not finite.
_NAN, _UP, _DOWN = 9001, 9002, 9003


def _keys(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in by]


def _partial(df: DataFrame, value: str, by: Sequence[str], made: Sequence[tuple[str, T.DataType]], run) -> DataFrame:
    """``run(values)`` for the rows of each key in a batch: arrays of equal length, one row each."""
    keys = [T.StructField(f"__k{k}", f.dataType) for k, f in enumerate(_keys(df, by))]
    schema = T.StructType([*keys, *[T.StructField(n, t) for n, t in made]])
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            if not len(v):
                continue
            if keys:
                found = pa.table({f"__k{k}": batch.column(k) for k in range(len(keys))} | {"row": np.arange(len(v))}).group_by([f"__k{k}" for k in range(len(keys))]).aggregate([("row", "list")])
                groups = [(r.as_py(), [found.column(f"__k{k}")[g] for k in range(len(keys))]) for g, r in enumerate(found.column("row_list"))]
            else:
                groups = [(slice(None), [])]
            for rows, own in groups:
                out = run(v[rows])
                n = len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, arrow.field(c).type) for c, k in enumerate(own)] + [pa.array(x, arrow.field(len(own) + c).type) for c, x in enumerate(out)], schema=arrow)

    rows = df.select(*[F.col(c) for c in by], F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    return rows.mapInArrow(each, schema)


def total(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, total): the sum of each key's values as if it were rounded once. Nulls do not count; of nothing it is 0 for no keys."""

    def run(v: np.ndarray) -> tuple[np.ndarray, ...]:
        finite = np.isfinite(v)
        m, e = np.frexp(np.where(finite, v, 0.0))
        whole = np.ldexp(m, 53).astype(np.int64)
        e = np.where(finite, e, np.where(np.isnan(v), _NAN, np.where(v > 0, _UP, _DOWN)))
        powers, at = np.unique(e, return_inverse=True)
        high, low = np.zeros(len(powers), np.int64), np.zeros(len(powers), np.int64)
        np.add.at(high, at, whole >> LOW_BITS)
        np.add.at(low, at, whole & ((1 << LOW_BITS) - 1))
        return powers.astype(np.int64), high, low

    parts = _partial(df, value, by, [("power", T.LongType()), ("high", T.LongType()), ("low", T.LongType())], run)
    keys = [f"__k{k}" for k in range(len(by))]
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    summed = parts.groupBy(*keys, "power").agg(wide("high"), wide("low"))
    lines = summed.groupBy(*keys).agg(F.collect_list(F.struct("power", F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"))).alias("x"))
    schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(by, _keys(df, by))], T.StructField("total", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [_rounded(x) for x in batch.column(len(by)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(k).cast(arrow.field(k).type) for k in range(len(by))] + [pa.array(sums, pa.float64())], schema=arrow)

    return lines.mapInArrow(last, schema)


def _rounded(parts: list[dict]) -> float:
    powers = {p["power"] for p in parts}
    if _NAN in powers or {_UP, _DOWN} <= powers:
        return math.nan
    if powers & {_UP, _DOWN}:
        return math.inf if _UP in powers else -math.inf
    least = min((p["power"] for p in parts), default=0)
    whole = sum(((int(p["high"]) << LOW_BITS) + int(p["low"])) << (p["power"] - least) for p in parts)
    shift = least - 53
    try:
        return float(whole << shift) if shift >= 0 else whole / (1 << -shift)
    except OverflowError:
        return math.copysign(math.inf, whole)


def norm(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, norm): the root of the sum of squares, in one pass, whatever the values' magnitudes."""

    def run(v: np.ndarray) -> tuple[np.ndarray, ...]:
        odd = ~np.isfinite(v)
        _, e = np.frexp(np.where(odd, 0.0, v))
        ranges = np.where(odd, np.where(np.isnan(v), _NAN, _UP), np.floor_divide(e, RANGE_BITS))
        found, at = np.unique(ranges, return_inverse=True)
        near = np.ldexp(np.where(odd, 0.0, v), -RANGE_BITS * np.where(odd, 0, ranges).astype(int))
        return found.astype(np.int64), np.bincount(at, near * near, len(found))

    parts = _partial(df, value, by, [("range", T.LongType()), ("squares", T.DoubleType())], run)
    keys = [f"__k{k}" for k in range(len(by))]
    summed = parts.groupBy(*keys, "range").agg(F.sum("squares").alias("squares"))
    lines = summed.groupBy(*keys).agg(F.collect_list(F.struct("range", "squares")).alias("x"))
    schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(by, _keys(df, by))], T.StructField("norm", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def of(parts: list[dict]) -> float:
        found = {p["range"]: p["squares"] for p in parts if p["squares"] or p["range"] >= _NAN}
        if not found:
            return 0.0
        if max(found) >= _NAN:
            return math.nan if _NAN in found else math.inf
        top = max(found)
        inner = sum(math.ldexp(s, 2 * RANGE_BITS * (r - top)) for r, s in sorted(found.items()))
        try:
            return math.ldexp(math.sqrt(inner), RANGE_BITS * top)
        except OverflowError:
            return math.inf

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [of(x) for x in batch.column(len(by)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(k).cast(arrow.field(k).type) for k in range(len(by))] + [pa.array(made, pa.float64())], schema=arrow)

    return lines.mapInArrow(last, schema)


def median(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """(by, median): the middle value of each key, the mean of both for an even count. Nulls and NaN do not count."""
    return _selected(df, value, by, F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), "median", bins)


def nth(df: DataFrame, value: str, rank: int, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """(by, nth): the value at a 0-based rank of each key, for keys of more values."""
    return _selected(df, value, by, F.lit(rank), F.lit(rank), "nth", bins)


def _selected(df: DataFrame, value: str, by: Sequence[str], first, second, name: str, bins: int) -> DataFrame:
    # -0.0 and 0.0 are one value; a key may be null.
    rows = df.select(*[F.struct(F.col(c)).alias(f"__k{k}") for k, c in enumerate(by)], (F.col(value).cast("double") + 0.0).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v"))
    if not by:
        rows = rows.withColumn("__k0", F.struct(F.lit(0).alias("c")))
    keys = [f"__k{k}" for k in range(max(1, len(by)))]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # ``before``: how many values are below the range.
    now = sizes.select(*keys, "lo", "hi", first.cast("bigint").alias("rank"), second.cast("bigint").alias("other"), "n", F.lit(0).cast("bigint").alias("before")).where(F.col("other") < F.col("n"))
    now = materialize(now, "ranges")
    sent = now.count() <= MOST_SENT
    done = None
    while True:
        ended = now.where("lo = hi")
        done = ended if done is None else done.unionByName(ended)
        open_ = now.where("lo < hi")
        if not open_.head(1):
            break
        told = open_.select(*keys, "lo", "hi")
        inside = rows.join(F.broadcast(told) if sent else told, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        # Halves first: the difference of two doubles may overflow. The ends of a range are never in one bin.
        share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        endless = (F.abs("lo") == math.inf) | (F.abs("hi") == math.inf)
        spot = F.when(F.col("v") == F.col("hi"), bins - 1).when(endless, F.when(F.col("v") == F.col("lo"), 0).otherwise(1)).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins).cast("int"), F.lit(bins - 2)))
        counted = inside.groupBy(*keys, spot.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        # At most ``bins`` rows a key meet in a task here.
        line = F.sort_array(F.collect_list(F.struct("bin", "c", "a", "b")))
        lines = counted.groupBy(*keys).agg(line.alias("x"))
        both = open_.join(lines, keys)
        step = F.aggregate(
            "x",
            F.struct(F.col("before").alias("sum"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("bigint").alias("before")),
            lambda s, b: F.when(s["lo"].isNotNull(), s).when(s["sum"] + b["c"] > F.col("rank"), F.struct((s["sum"] + b["c"]).alias("sum"), b["a"].alias("lo"), b["b"].alias("hi"), s["sum"].alias("before")))
            .otherwise(F.struct((s["sum"] + b["c"]).alias("sum"), s["lo"].alias("lo"), s["hi"].alias("hi"), s["before"].alias("before"))),
        )
        narrowed = both.withColumn("s", step)
        now = materialize(narrowed.select(*keys, F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), "rank", "other", "n", F.col("s.before").alias("before")), "ranges")
    found = done.select(*keys, F.col("lo").alias("m"), "other")
    told = F.broadcast(found) if sent else found
    # The next value stands where no more than ``other`` values are up to the first.
    met = rows.join(told, keys).groupBy(*keys, "m", "other").agg(F.count(F.when(F.col("v") <= F.col("m"), 1)).alias("upto"), F.min(F.when(F.col("v") > F.col("m"), F.col("v"))).alias("next"))
    out = F.when(F.col("upto") > F.col("other"), F.col("m")).otherwise(F.col("m") / 2 + F.col("next") / 2)
    return met.select(*[F.col(f"__k{k}")[c].alias(c) for k, c in enumerate(by)], out.alias(name))


#: Whole numbers of one bit map, and maps that a task holds before it hands them on.
BITS, MAPS = 1 << 18, 128


class _Maps:
    """Bits of the whole numbers that a task has seen. A map that is full is told by its number alone."""

    def __init__(self, bits: int, most: int) -> None:
        self.bits, self.most = bits, most
        self.held: dict[int, np.ndarray] = {}

    def mark(self, k: np.ndarray) -> Iterator[tuple[list[int], list[bytes | None]]]:
        """Marks ``k``; what is held goes on where there would be too many maps."""
        if not len(k):
            return
        least, most = int(k.min()) // self.bits, int(k.max()) // self.bits
        of = k // self.bits if most > least else None
        for m in range(least, most + 1) if most - least < 16 else np.unique(of).tolist():
            own = k if of is None else k[of == m]
            if m not in self.held and len(own):
                if len(self.held) >= self.most:
                    yield self.told()
                self.held[m] = np.zeros(self.bits, bool)
            if len(own):
                self.held[m][own - m * self.bits] = True

    def told(self) -> tuple[list[int], list[bytes | None]]:
        """(numbers of the maps, their bits), and holds none."""
        found = list(self.held), [None if x.all() else np.packbits(x).tobytes() for x in self.held.values()]
        self.held.clear()
        return found


def _different(maps: DataFrame) -> DataFrame:
    """(different) of (map, bits)."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits, n = None, None, 0
        for batch in batches:
            for m, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                if m != now:
                    n += 0 if bits is None else int(np.bitwise_count(bits).sum())
                    now, bits = m, np.zeros(BITS // 8, np.uint8)
                bits |= np.frombuffer(own.as_py(), np.uint8) if own.is_valid else np.uint8(255)
        n += 0 if bits is None else int(np.bitwise_count(bits).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return maps.repartition("map").sortWithinPartitions("map").mapInArrow(met, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("different"))


def distinct(df: DataFrame, column: str) -> DataFrame:
    """(different): how many different whole numbers a column has, exactly, by maps of bits instead of a shuffle of all rows.

    Where neighbouring numbers are near in the table few maps are shuffled.
    """

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row = _Maps(BITS, MAPS), lambda x: pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.binary())], names=["map", "bits"])
        for batch in batches:
            yield from map(row, held.mark(batch.column(0).drop_null().to_numpy()))
        yield row(held.told())

    return _different(df.select(F.col(column).cast("bigint").alias("k")).mapInArrow(maps, "map bigint, bits binary"))


def sums_of_square(spark: SparkSession, n: int, lines: int, line: Callable[[int], Iterator[tuple]]) -> tuple[DataFrame, DataFrame]:
    """((side, at, v), (different)) of a square of n x n whole numbers: the sum of every row (side 0) and column (side 1), and how many
    different elements there are.

    ``line(s)`` makes the elements of one of ``lines`` lines in pieces (i, j, v) of places and numbers: i and j do not repeat in a piece,
    but i may be one number for all of it. Tasks make, add and mark every element, and only their sums and maps of bits are written.
    """
    tasks = max(1, min(lines, 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, down, along = _Maps(BITS, MAPS), np.zeros(n, np.int64), np.zeros(n, np.int64)

        def rows(side: int, at, v, bits) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side)), pa.array(at, pa.int64()), pa.array(v, pa.int64()), pa.array(bits, pa.binary())], names=["side", "at", "v", "bits"])

        maps = lambda x: rows(2, x[0], [None] * len(x[0]), x[1])
        for batch in batches:
            for s in batch.column(0).to_pylist():
                for i, j, v in line(s):
                    down[i] += v.sum() if np.ndim(i) == 0 else v
                    along[j] += v
                    yield from map(maps, held.mark(v))
        yield maps(held.told())
        for side, x in enumerate((down, along)):
            yield rows(side, np.arange(n), x, pa.nulls(n, pa.binary()))

    made = materialize(spark.range(0, lines, 1, tasks).mapInArrow(run, "side bigint, at bigint, v bigint, bits binary"), "sums-of-square")
    sums = made.where("side < 2").groupBy("side", "at").agg(F.sum("v").alias("v"))
    return sums, _different(made.where("side = 2").select(F.col("at").alias("map"), "bits"))
