"""Graph documents, content manifests and caches as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "nodes array<struct<id:string,kind:string,file:string,name:string,line:int,line_end:int>>, edges array<struct<source:string,target:string,kind:string>>"


def scan_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of whole JSON documents."""
    whole = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return whole.select(F.explode("nodes").alias("n")).select("n.*"), whole.select(F.explode("edges").alias("e")).select("e.*")


def to_graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the canonical document, nodes by id. A document is one string, so this is for graphs that a reader can hold."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("source", "target", "kind"))).alias("edges"))
    return n.join(e).select(F.to_json(F.struct("nodes", "edges"), {"ignoreNullFields": "true"}).alias("json"))


def content_manifest(files: DataFrame, version: str = "1") -> DataFrame:
    """key, hash: by key one digest of all (path, content) pairs in order of path. files: key, path, content."""
    each = files.select("key", "path", F.sha2(F.concat(F.col("path").cast("binary"), F.col("content").cast("binary")), 256).alias("h"))
    return each.groupBy("key").agg(F.sha2(F.concat(F.lit(version), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), "")).cast("binary"), 256).alias("hash"))


def cache_probe(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and work left: key, hash and version must all match."""
    on = ["key", "hash", "version"]
    return wanted.join(cache, on), wanted.join(cache.select(*on).distinct(), on, "left_anti")


def source_windows(nodes: DataFrame, files: DataFrame, most: int = 24_000) -> DataFrame:
    """id and text: the node's lines under a header, of at most so many characters; blank ones are left out. files: file and text."""
    lines = F.split("text", "\n")
    end = F.coalesce("line_end", "line")
    cut = F.array_join(F.slice(lines, F.col("line"), F.greatest(end - F.col("line") + 1, F.lit(1))), "\n")
    joined = nodes.where("line IS NOT NULL").join(files.select("file", "text"), "file").where(F.size(lines) >= F.col("line"))
    return joined.select("id", cut.alias("cut"), "kind").where(F.trim("cut") != "").select("id", F.substring(F.concat(F.lit("# "), F.col("kind"), F.lit(" "), F.col("id"), F.lit("\n"), F.col("cut")), 1, most).alias("text"))


def lines_within(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """spans: file, first and last; lines: file and line. The lines of each span; files are joined by equality, lines compared within."""
    return spans.join(lines, "file").where("line BETWEEN first AND last")
