"""Graphs over the relational tables: nodes (id, kind, file) and edges (source, target, kind), from one SQL text for Spark and its oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

NATIONS = "SELECT n_nationkey AS k, replace(r_name, ' ', '_') AS r, replace(r_name, ' ', '_') || '.' || replace(n_name, ' ', '_') AS n FROM nation JOIN region ON n_regionkey = r_regionkey"
PLACES = f"""SELECT s_suppkey AS k, n || '.Supplier_' || CAST(s_suppkey AS VARCHAR(20)) AS id, n, r FROM supplier JOIN ({NATIONS}) ns ON s_nationkey = k"""
BUYERS = f"""SELECT c_custkey AS k, n || '.Customer_' || CAST(c_custkey AS VARCHAR(20)) AS id, n, r FROM customer JOIN ({NATIONS}) nc ON c_nationkey = k"""
SUPPLY_NODES = f"""SELECT DISTINCT r AS id, 'module' AS kind, r AS file FROM ({NATIONS}) a UNION ALL SELECT n, 'module', r || '/' || n FROM ({NATIONS}) b
 UNION ALL SELECT id, 'class', r || '/' || n FROM ({PLACES}) c UNION ALL SELECT id, 'function', r || '/' || n FROM ({BUYERS}) d"""
CALLS = f"""SELECT b.id AS source, p.id AS target, b.n AS sn, p.n AS tn FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN ({BUYERS}) b ON o_custkey = b.k JOIN ({PLACES}) p ON l_suppkey = p.k"""
SUPPLY_EDGES = f"""SELECT source, target, 'calls' AS kind FROM ({CALLS}) e UNION ALL SELECT DISTINCT sn, tn, 'imports' FROM ({CALLS}) f
 UNION ALL SELECT DISTINCT r, n, 'defines' FROM ({NATIONS}) g UNION ALL SELECT n, id, 'defines' FROM ({PLACES}) h UNION ALL SELECT n, id, 'defines' FROM ({BUYERS}) i"""
NEXT = """SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem"""
SUPP_EDGES = f"""SELECT s.id AS source, t.id AS target, 'calls' AS kind FROM ({NEXT}) x JOIN ({PLACES}) s ON a = s.k JOIN ({PLACES}) t ON b = t.k"""
# a sparse part of the same graph, for what follows paths
FLOW_EDGES = SUPP_EDGES.replace("FROM lineitem", "FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
SUPP_NODES = f"""SELECT id, 'class' AS kind, r || '/' || n AS file FROM ({PLACES}) c"""
STEPS = """SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events"""
EVENT_EDGES = f"""SELECT source, target, 'calls' AS kind FROM ({STEPS}) s WHERE target IS NOT NULL"""
EVENT_NODES = """SELECT DISTINCT event_type AS id, 'function' AS kind, 'events' AS file FROM events"""

GRAPHS = {"supply": (SUPPLY_NODES, SUPPLY_EDGES), "supp": (SUPP_NODES, SUPP_EDGES), "flow": (SUPP_NODES, FLOW_EDGES), "events": (EVENT_NODES, EVENT_EDGES)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the given tables, each read only if the text names it."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def graph(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges."""
    nodes, edges = GRAPHS[name]
    return run(spark, sf_dir, nodes), run(spark, sf_dir, edges)


def oracle(name: str, select: str) -> str:
    """The same graph under the names nodes and edges, for the SQL that a query is held against."""
    nodes, edges = GRAPHS[name]
    return f"WITH RECURSIVE nodes AS ({nodes}), edges AS ({edges}) {select}"
