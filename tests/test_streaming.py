from pyspark.sql import functions as F

from gridloom.streaming import series

SF = "/root/testdata/sf0.001"


def test_keyed_scans(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = series.scans(stream, "user_id", "event_id", "value").writeStream.format("memory").queryName("scans").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("scans").groupBy("key").agg(F.max("cumsum").alias("s"), F.count(F.lit(1)).alias("n"))
    want = events.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.sum("value").alias("t"), F.count(F.lit(1)).alias("k"))
    assert got.join(want, "key").where("n <> k OR abs(s - t) > 1e-6").count() == 0 and got.count() == want.count()


def test_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    out = series.windowed(events, "ts", "value", "1 day").agg(F.sum("n")).first()[0]
    assert out == events.count()
