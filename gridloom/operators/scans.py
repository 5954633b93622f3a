"""Scans of long series: blocks of bounded size, and one carried row a block.

A series of any length is cut into blocks by its positions. Windows run within blocks, so no task
holds a whole series; what a block hands to the next (a sum, its last rows) is one row a block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.shared import materialize

#: Positions of one block.
BLOCK = 65_536


def numbered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Add ``rank``, the 0-based position in the order, without gathering rows in one task.

    Rows are ranged into sorted partitions and written once, so that ties and partitions are settled;
    each partition's offset, of which there is one row a partition, is joined back. Ties are ranged by where
    they were read, so that a value that many rows share is dealt over partitions as well.
    """
    sortable = [*[F.col(c) if isinstance(c, str) else c for c in order], F.col("__tie")]
    held = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*sortable).sortWithinPartitions(*sortable).drop("__tie")
    held = materialize(held.select("*", F.monotonically_increasing_id().alias("__place")), "numbered")
    part = F.shiftright("__place", 33)
    sizes = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    found = held.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    rank = F.col("__before") + F.col("__place") - F.shiftleft("__part", 33)
    return found.withColumn("rank", rank.cast("bigint")).drop("__place", "__part", "__before")


def running(df: DataFrame, stay: str, run: str, length: int, how: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column | DataFrame:
    """``df`` with ``v`` replaced by its running aggregate along ``run``, whose positions are below ``length``."""
    whole = Window.partitionBy(stay).orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    if length <= BLOCK:
        return df.withColumn("v", how(F.col("v")).over(whole))
    blocked = df.withColumn("__b", F.floor(F.col(run) / BLOCK))
    totals = blocked.groupBy(stay, "__b").agg(how(F.col("v")).alias("__t"))
    before = Window.partitionBy(stay).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(stay, "__b", how(F.col("__t")).over(before).alias("__t"))
    inner = Window.partitionBy(stay, "__b").orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("v", how(F.col("v")).over(inner)).join(carried, [stay, "__b"])
    return local.withColumn("v", F.when(F.col("__t").isNull(), F.col("v")).otherwise(join(F.col("__t"), F.col("v")))).select(*df.columns)


def with_neighbours(df: DataFrame, stay: str, run: str, length: int) -> DataFrame:
    """Add ``before`` and ``after``, the values one position back and ahead (null at the ends).

    Rows at the edge of a block are seen by the next block as well, and left out of its result.
    """
    if length <= BLOCK:
        w = Window.partitionBy(stay).orderBy(run)
        return df.select("*", F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"))
    own = F.floor(F.col(run) / BLOCK)
    at = F.col(run) % BLOCK
    places = F.array_compact(F.array(own, F.when((at == 0) & (own > 0), own - 1), F.when(at == BLOCK - 1, own + 1)))
    seen = df.select("*", F.explode(places).alias("__b"))
    w = Window.partitionBy(stay, "__b").orderBy(run)
    found = seen.select("*", F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"))
    return found.where(F.col("__b") == own).drop("__b")


def lagged(df: DataFrame, by: Sequence[str], order: str, value: str, most: int) -> DataFrame:
    """Add ``__lag``: the values 1 … ``most`` rows back in the row's own series, null where there are none.

    Series are numbered together and cut into blocks, whatever their lengths; the last ``most`` rows of a
    block are seen by the next one as well.
    """
    ranked = numbered(df, [*by, order])
    if most == 0:
        return ranked.withColumn("__lag", F.array().cast("array<double>"))
    size = max(BLOCK, most)
    own, at = F.floor(F.col("rank") / size), F.col("rank") % size
    seen = ranked.select("*", F.explode(F.array_compact(F.array(own, F.when(at >= size - most, own + 1)))).alias("__b"))
    w = Window.partitionBy("__b").orderBy("rank")
    series = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    held = seen.withColumn("__s", series)
    back = [F.when(F.lag("__s", k).over(w).eqNullSafe(F.col("__s")), F.lag(F.col(value).cast("double"), k).over(w)) for k in range(1, most + 1)]
    return held.select("*", F.array(*back).alias("__lag")).where(F.col("__b") == own).drop("__b", "__s")


def last_and_next(df: DataFrame, by: Sequence[str], order: Sequence[str], mark: Column) -> DataFrame:
    """Add ``lo`` and ``hi``: the nearest non-null ``mark`` at or before, and at or after, each row of its series.

    Within a block by a window; a block's last and first marks, one row a block, are carried over the blocks.
    """
    series = F.struct(*[F.col(c) for c in by], F.lit(0).alias("__one"))
    ranked = numbered(df, [*by, *order]).withColumn("__b", F.floor(F.col("rank") / BLOCK))
    ranked = ranked.withColumn("__m", F.when(mark.isNotNull(), F.struct(series.alias("s"), mark.alias("m"))))
    ends = ranked.groupBy("__b").agg(F.max_by("__m", F.when(F.col("__m").isNotNull(), F.col("rank"))).alias("l"), F.min_by("__m", F.when(F.col("__m").isNotNull(), F.col("rank"))).alias("f"))
    over = Window.orderBy("__b")
    before = F.last("l", True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("f", True).over(Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("__b", before.alias("__before"), after.alias("__after"))
    w = Window.partitionBy("__b").orderBy("rank")
    low = F.last("__m", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Looking back in falling order keeps one running value; a frame to the end of the block would be read anew for every row.
    falling = Window.partitionBy("__b").orderBy(F.desc("rank"))
    high = F.last("__m", True).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    found = ranked.select("*", low.alias("__l"), high.alias("__h")).join(carried, "__b")
    own = lambda x: F.when(x["s"].eqNullSafe(series), x["m"])
    lo, hi = own(F.coalesce("__l", "__before")), own(F.coalesce("__h", "__after"))
    return found.select(*df.columns, "rank", lo.alias("lo"), hi.alias("hi"))
