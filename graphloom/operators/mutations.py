"""Mutations of graphs, whose findings are known, to measure detectors by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.issues import between_modules


def calls(df: DataFrame) -> DataFrame:
    return df.select("source", "target", F.lit("calls").alias("kind"))


def eligible_modules(assign: DataFrame, least: int = 5) -> DataFrame:
    """module and n: modules of at least so many members that are not tests."""
    return assign.where(~F.lower("id").rlike("test|spec|mock")).groupBy("module").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def wide_interface(edges: DataFrame, assign: DataFrame, sources: int = 2) -> DataFrame:
    """Calls from the first members of the largest module to all of the second largest."""
    sizes = assign.groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(2)
    two = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "module"))).alias("s")).select(F.col("s")[0]["module"].alias("one"), F.col("s")[1]["module"].alias("two"))
    first = assign.join(two, F.col("module") == F.col("one")).orderBy("id").limit(sources).select(F.col("id").alias("source"))
    other = assign.join(two, F.col("module") == F.col("two")).select(F.col("id").alias("target"))
    return edges.select("source", "target", "kind").unionByName(calls(first.join(other)))


def layer_violation(edges: DataFrame, assign: DataFrame, more: int = 0) -> DataFrame:
    """Against the pair of modules with the most edges, more edges back than forth, through one pair of nodes, of both kinds."""
    pairs = between_modules(edges, assign).where("sm <> tm").groupBy("sm", "tm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sm", "tm").limit(1)
    least = assign.groupBy("module").agg(F.min("id").alias("id"))
    ends = pairs.join(least.select(F.col("module").alias("tm"), F.col("id").alias("source")), "tm").join(least.select(F.col("module").alias("sm"), F.col("id").alias("target")), "sm")
    back = ends.select("source", "target", F.explode(F.sequence(F.lit(0), F.greatest(3 * F.col("n") + 6, F.lit(6)) + more - 1)).alias("i"))
    return edges.select("source", "target", "kind").unionByName(back.select("source", "target", F.when(F.col("i") % 2 == 0, "calls").otherwise("imports").alias("kind")))


def overloaded_utility(edges: DataFrame, assign: DataFrame, share: float = 0.7) -> DataFrame:
    """Calls from the first member of so many modules (by name) to the least node."""
    utility = assign.agg(F.min("id").alias("target"))
    first = assign.groupBy("module").agg(F.min("id").alias("source"))
    many = first.agg(F.ceil(F.count("*") * share).cast("int").alias("many"))
    chosen = first.join(many).orderBy("module").select("source", F.monotonically_increasing_id().alias("k"), "many").where("k < many")
    return edges.select("source", "target", "kind").unionByName(calls(chosen.join(utility).where("source <> target")))


def near_disconnect(edges: DataFrame, assign: DataFrame, share: float = 0.75) -> DataFrame:
    """Without so large a share of the edges inside modules, chosen by a hash of their ends."""
    a, b = assign.select(F.col("id").alias("source"), F.col("module").alias("sm")), assign.select(F.col("id").alias("target"), F.col("module").alias("tm"))
    both = edges.join(a, "source", "left").join(b, "target", "left")
    gone = (F.col("kind") != "defines") & F.coalesce(F.col("sm") == F.col("tm"), F.lit(False)) & (F.pmod(F.xxhash64("source", "target"), F.lit(1000)) < int(share * 1000))
    return both.where(~gone).select("source", "target", "kind")


def inject_cycle(edges: DataFrame, ids: DataFrame, size: int = 3) -> DataFrame:
    """A ring of calls through the first so many of the sorted ids."""
    ring = ids.select("id").distinct().orderBy("id").limit(size).agg(F.array_sort(F.collect_list("id")).alias("a"))
    k = F.explode(F.sequence(F.lit(0), F.size("a") - 1)).alias("k")
    links = ring.select("a", k).select(F.col("a")[F.col("k")].alias("source"), F.col("a")[(F.col("k") + 1) % F.size("a")].alias("target")).where("source <> target")
    return edges.select("source", "target", "kind").unionByName(calls(links))


MUTATIONS: dict[str, Callable[..., DataFrame]] = {"wide_interface": wide_interface, "layer_violation": layer_violation, "overloaded_utility": overloaded_utility, "near_disconnect": near_disconnect}


def apply(name: str, edges: DataFrame, assign: DataFrame, **severity) -> DataFrame:
    """A mutation by its name. inject_cycle takes the assignment's ids."""
    if name == "inject_cycle":
        return inject_cycle(edges, assign, **severity)
    if name not in MUTATIONS:
        raise ValueError(f"no mutation {name}")
    return MUTATIONS[name](edges, assign, **severity)
