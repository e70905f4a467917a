"""Streamed degrees equal those of the same edges as a table."""

from pyspark.sql import functions as F

from graphloom.streaming.edges import windowed_degrees


def test_windowed_degrees(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a", "b"), ("2024-01-01 00:50:00", "a", "c"), ("2024-01-01 00:55:00", "c", "c"), ("2024-01-01 01:10:00", "b", "a"), ("2024-01-01 05:00:00", "x", "y")]
    table = spark.createDataFrame(rows, "ts string, source string, target string").withColumn("ts", F.to_timestamp("ts"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    run = windowed_degrees(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    key = lambda df: {(str(r.start), r.id): (r.in_degree, r.out_degree) for r in df.collect()}
    want, got = key(windowed_degrees(table)), key(spark.read.parquet(str(tmp_path / "out")))
    assert got.items() <= want.items() and got["2024-01-01 00:00:00", "a"] == (0, 2) and want["2024-01-01 05:00:00", "x"] == (0, 1)
