import math

from pyspark.sql import functions as F

from seriesloom.streaming.observations import observe


def test_streams_carry_state_between_batches(spark, tmp_path):
    df = spark.createDataFrame([("a", i, None if i == 2 else float(2**i)) for i in range(6)], "k string, t long, v double")
    for i in range(3):
        df.where((F.col("t") >= 2 * i) & (F.col("t") < 2 * i + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = observe(stream, "k", "t", "v", 2).writeStream.format("memory").queryName("observed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("observed").orderBy("t").collect()
    assert [r.v for r in rows] == [1, 2, None, 8, 16, 32]
    assert [None if r.dlog is None else round(r.dlog / math.log(2), 6) for r in rows] == [None, 1, None, 2, 1, 1]
    assert [r.rolling_mean for r in rows] == [None, 1.5, 1.5, 5, 12, 24]
