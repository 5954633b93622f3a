"""Running sums, differences and trapezoids of keyed series as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, seq bigint, value double, cumsum double, diff double, cumtrapz double"
STATE = "last double, total double, area double, n bigint"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, total, area, n = state.get if state.exists else (None, 0.0, 0.0, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, value in zip(rows["seq"].tolist(), rows["value"].tolist()):
        step = None if last is None else value - last
        area += 0.0 if last is None else (value + last) / 2
        total, last, n = total + value, value, n + 1
        out.append((key[0], seq, value, total, step, area))
    state.update((last, total, area, n))
    yield pd.DataFrame(out, columns=["key", "seq", "value", "cumsum", "diff", "cumtrapz"])


def scans(stream: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Scans of each key's values in order of arrival; within a trigger, of ``seq``."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, time: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, sum, mean and population variance by time window, with a watermark."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
        .select(F.col("window.start").alias("start"), "n", "total", "mean", "var")
    )
