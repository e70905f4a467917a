"""Degrees of a stream of edges, in windows of event time, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(edges: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """edges: ts, source and target, a stream or a table. start, id, in_degree and out_degree of each window; self-edges do not count.

    Edges later than the watermark are dropped; state is kept for open windows only.
    """
    fine = edges.withWatermark("ts", late).where("source <> target")
    ends = fine.select("ts", F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    counts = ends.groupBy(F.window("ts", width).alias("w"), F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return counts.select(F.col("w.start").alias("start"), "id", "in_degree", "out_degree")
