"""Helpers that all training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions.shared import materialize, shared_dir

__all__ = ["join_spread", "map_texts", "materialize", "other_columns", "quoted", "remainder", "shared_dir", "table"]

#: Rows that a Python task handles at once; bounds what its temporary arrays take.
CHUNK_ROWS = 128

#: Rows of one key from which a join treats the key as hot, and how many hot keys there can be at most.
HOT_ROWS, HOT_KEYS = 1_000, 100_000

_ROW_TEXT = "__row_text"


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], size_col: str, total: int) -> DataFrame:
    """Inner join where ``right``, a written table, has one row a key and says how many of the ``total`` rows of ``left`` have it.

    Rows of hot keys stay where they are and meet a broadcast of their keys, of which there are no more than
    ``HOT_KEYS`` by count; the others are shuffled. So no task gets all rows of a large group.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = right.where(F.col(size_col) > most)
    if hot.isEmpty():
        return left.join(right, list(keys))
    few = F.broadcast(hot)
    cold = left.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(right.where(F.col(size_col) <= most), list(keys))
    return left.join(few, list(keys)).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def other_columns(df: DataFrame, taken: Iterable[str], keep: Sequence[str] | None = None) -> list[str]:
    """Columns of ``df`` (or those in ``keep``) whose names do not clash with ``taken``.

    Names clash regardless of case, as Spark resolves them; the operator's own column wins.
    """
    low = {c.lower() for c in taken}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in low]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(
    df: DataFrame,
    text_col: str,
    compute: Callable[[list[str | None]], dict[str, list]],
    fields: Sequence[T.StructField],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add to every row the columns ``fields`` that ``compute`` derives from its text.

    ``compute`` gets the texts of a few rows and returns one list per new column. Rows stay in
    their partition; nothing is shuffled and no state crosses rows. ``keep`` names the input
    columns to carry along (all by default); the text is only sent back if it is among them.
    """
    names = [f.name for f in fields]
    kept = other_columns(df, names, keep)
    by_name = {f.name: f for f in df.schema.fields}
    schema = T.StructType([T.StructField(c, by_name[c].dataType, True) for c in kept] + list(fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                made = compute(part.column(len(kept)).to_pylist())
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
                columns += [pa.array(made[n], type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    source = df.select(*[quoted(c) for c in kept], quoted(text_col).cast("string").alias(_ROW_TEXT))
    return source.mapInArrow(run, schema)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``; -1 for a null id."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % by, F.lit(-1))
