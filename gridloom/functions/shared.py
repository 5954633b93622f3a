"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a plain local session) one is chosen: a temporary
    folder under a local master, else the warehouse, which executors share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local"):
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it ran, not the stages before, and what
    is not determined (an order among ties, a partition's number) is settled once.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
