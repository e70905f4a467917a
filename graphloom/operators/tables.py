"""Tables that end a plan's lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine's, and that only without a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written as Parquet and read again."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(ids: DataFrame) -> DataFrame:
    """id and k, its place among all sorted ids: counted by range, so that no task sees all."""
    parts = stored(ids.select("id").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    before = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = before.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return stored(parts.join(F.broadcast(before.select("part", "first")), "part").select("id", (F.col("first") + own - 1).alias("k")), "numbered")
