"""Structural issue detectors. Modules come as an assignment (id, module); all else follows from nodes and edges.

Each detector gives one row an issue: what it is about, severity (unrounded) and confidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import binomial_cdf, clamp, cohens_d, direction_significant, leaf_of, package_of
from graphloom.operators.graphs import COUPLING, degrees, of_kinds, percentile_ranks, without_dangling

# Leaf names that are called from everywhere by their nature.
SUPPRESSED = ("log", "trace", "debug", "info", "warn", "error", "println", "print", "serialize", "deserialize", "to_json", "from_json", "encode", "decode", "new", "create", "build", "from", "default", "init")
# Parts of a module's label that mark a place for utilities.
UTILITY_LABELS = ("utils", "helpers", "common", "shared", "lib")


def nearest_rank(values: DataFrame, value: str, *shares: float) -> DataFrame:
    """One row: for each share p the value at place floor(n p) of the sorted ones (the last at most), as p0, p1 and so on. By running counts of distinct values."""
    counts = values.groupBy(value).agg(F.count("*").alias("times"))
    upto = counts.withColumn("upto", F.sum("times").over(Window.orderBy(value))).withColumn("total", F.sum("times").over(Window.partitionBy(F.lit(1))))
    return upto.agg(*[F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * p), F.col("total") - 1), F.col(value))).alias(f"p{k}") for k, p in enumerate(shares)])


def surprisal(p: Column) -> Column:
    """How unlikely, in decades, against three of them."""
    return clamp(-F.log10(F.greatest(p, F.lit(1e-15))) / 3.0)


def between_modules(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Edges of coupling kinds with both ends' modules: source, target, kind, sm and tm."""
    a, b = assign.select(F.col("id").alias("source"), F.col("module").alias("sm")), assign.select(F.col("id").alias("target"), F.col("module").alias("tm"))
    return edges.where("kind <> 'defines'").join(a, "source").join(b, "target")


def layers(pairs: DataFrame, modules: DataFrame) -> DataFrame:
    """pairs: sm, tm and n, edges between different modules; modules: module. Each module's layer: its longest path from the sources of the graph of majority directions.

    Only modules without a cycle before them pass a layer on; what is reached by none keeps 0. The
    module graph is one task's: it has a row for each pair of modules, whatever the number of edges.
    """
    both = pairs.groupBy(F.least("sm", "tm").alias("a"), F.greatest("sm", "tm").alias("b")).agg(F.sum(F.when(F.col("sm") < F.col("tm"), F.col("n")).otherwise(0)).alias("forward"), F.sum(F.when(F.col("sm") > F.col("tm"), F.col("n")).otherwise(0)).alias("backward"))
    along = both.select(F.when(F.col("forward") >= F.col("backward"), F.col("a")).otherwise(F.col("b")).alias("above"), F.when(F.col("forward") >= F.col("backward"), F.col("b")).otherwise(F.col("a")).alias("below"))
    rows = along.unionByName(modules.select(F.col("module").alias("above"), F.lit(None).cast("string").alias("below")))

    def settle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below: dict[str, list[str]] = {}
        waiting: dict[str, int] = {}
        for part in parts:
            for a, b in zip(part["above"], part["below"], strict=True):
                waiting.setdefault(a, 0)
                if b is not None:
                    below.setdefault(a, []).append(b)
                    waiting[b] = waiting.get(b, 0) + 1
        layer = dict.fromkeys(waiting, 0)
        ready = [m for m, n in waiting.items() if n == 0]
        while ready:
            m = ready.pop()
            for t in below.get(m, ()):
                layer[t] = max(layer[t], layer[m] + 1)
                waiting[t] -= 1
                if waiting[t] == 0:
                    ready.append(t)
        yield pd.DataFrame({"module": list(layer), "layer": list(layer.values())})

    return rows.coalesce(1).mapInPandas(settle, "module string, layer int")


def layer_violations(edges: DataFrame, assign: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Edges from a deeper module up to a shallower one, where the direction is significant. components: id and component of strong ones; modules that share one are left to the cycles."""
    pairs = between_modules(edges, assign).where("sm <> tm").groupBy("sm", "tm").agg(F.count("*").alias("n"))
    level = layers(pairs, assign.select("module").distinct())
    back = pairs.select(F.col("sm").alias("tm"), F.col("tm").alias("sm"), F.col("n").alias("reverse"))
    both = pairs.join(back, ["sm", "tm"], "left").withColumn("reverse", F.coalesce("reverse", F.lit(0)))
    both = both.join(level.select(F.col("module").alias("sm"), F.col("layer").alias("ls")), "sm").join(level.select(F.col("module").alias("tm"), F.col("layer").alias("lt")), "tm")
    both = both.join(percentile_ranks(pairs.select("sm", "tm", "n"), "n").select("sm", "tm", "rank"), ["sm", "tm"])
    both = both.join(level.agg(F.greatest(F.max("layer"), F.lit(1)).alias("deepest"))).join(pairs.agg(F.count("*").alias("pairs")))
    total, minority = F.col("n") + F.col("reverse"), F.least("n", "reverse")
    up = both.where("ls > lt").where(direction_significant(minority, total))
    if components is not None:
        own = components.join(assign, "id").select("component", "module").distinct()
        shared = own.select("component", F.col("module").alias("sm")).join(own.select("component", F.col("module").alias("tm")), "component").where("sm <> tm").select("sm", "tm").distinct()
        up = up.join(shared, ["sm", "tm"], "left_anti")
    count = F.when(F.col("pairs") > 1, F.col("rank")).otherwise(0.5)
    severity = 0.4 * surprisal(binomial_cdf(minority, total)) + 0.3 * clamp((F.col("ls") - F.col("lt")) / F.col("deepest")) + 0.3 * count
    h = 2 * (F.asin(F.sqrt(1 - minority / total)) - F.asin(F.sqrt(F.lit(0.5))))
    return up.select(F.col("sm").alias("source_module"), F.col("tm").alias("target_module"), "n", "reverse", F.col("ls").alias("source_layer"), F.col("lt").alias("target_layer"), clamp(severity).alias("severity"), clamp(0.5 + 0.5 * (h / 0.8), 0.5, 1.0).alias("confidence"))


def overloaded_utilities(nodes: DataFrame, edges: DataFrame, assign: DataFrame, betweenness: DataFrame | None = None) -> DataFrame:
    """Nodes above the 85th percentile of in-degree that mostly are called, from more modules than chance would have call them."""
    d = degrees(nodes, edges)
    limits = nearest_rank(d, "in_degree", 0.85, 0.99)
    calls = of_kinds(without_dangling(nodes, edges), COUPLING).join(assign.select(F.col("id").alias("source"), F.col("module").alias("caller")), "source")
    out = calls.groupBy("caller").agg(F.count("*").alias("out"))
    sums = out.agg(F.sum("out").alias("e")).join(assign.agg(F.count_distinct("module").alias("k")))
    total = F.col("in_degree") + F.col("out_degree")
    busy = d.join(limits).where("in_degree > p0 AND in_degree > out_degree").where(direction_significant(F.least("in_degree", "out_degree"), total)).where(~F.lower(leaf_of(F.col("id"))).isin(*SUPPRESSED))
    seen = calls.groupBy(F.col("target").alias("id")).agg(F.count_distinct("caller").alias("observed"))
    # the chance depends on the in-degree alone: modules meet each different one of the few busy nodes' degrees
    misses = out.join(sums).select("k", (1 - F.col("out") / F.col("e")).alias("miss"))
    chance = busy.select("in_degree").distinct().join(misses).groupBy("in_degree").agg(F.sum(1 - F.pow("miss", "in_degree")).alias("expected"), F.max("k").alias("modules"))
    found = busy.join(seen, "id").join(chance, "in_degree").where("observed > expected").join(assign, "id", "left")
    degree = F.when(F.col("p1") > F.col("p0"), clamp((F.col("in_degree") - F.col("p0")) / (F.col("p1") - F.col("p0")))).otherwise(0.5)
    diverse = clamp((F.col("observed") - F.col("expected")) / F.greatest("modules", F.lit(1)) * 2)
    severity = 0.4 * degree + 0.3 * diverse + 0.3 * surprisal(binomial_cdf(F.least("in_degree", "out_degree"), total))
    if betweenness is not None:
        found = found.join(percentile_ranks(betweenness, "betweenness").select("id", F.col("rank").alias("between")), "id", "left")
        severity = severity * F.when(F.coalesce("between", F.lit(0.5)) > 0.9, 1.3).otherwise(1.0)
    utility = F.lit(False)
    for part in UTILITY_LABELS:
        utility = utility | F.contains("module", F.lit(part))
    severity = severity * F.when(utility, 0.7).otherwise(1.0) * F.when(F.col("out_degree") == 0, 0.8).otherwise(1.0)
    return found.select("id", "in_degree", "out_degree", "observed", "expected", clamp(severity).alias("severity"), F.lit(0.7).alias("confidence"))


def circular_dependencies(edges: DataFrame, components: DataFrame, assign: DataFrame) -> DataFrame:
    """components: id and component of strong components. One row a component of more than one node, but for tests' and those of inheritance alone."""
    size = Window.partitionBy("component")
    own = components.withColumn("size", F.count("*").over(size)).where("size > 1").select("id", "component", "size")
    tests = F.avg(F.lower("id").rlike("test|spec").cast("int"))
    facts = own.join(assign, "id", "left").groupBy("component").agg(F.max("size").alias("size"), F.count_distinct("module").alias("modules"), F.count_distinct(package_of(F.col("id"))).alias("packages"), tests.alias("tests"))
    p90 = nearest_rank(own.select("component", "size").distinct(), "size", 0.9)
    ends = edges.where("kind <> 'defines' AND source <> target").join(own.select(F.col("id").alias("source"), "component"), "source").join(own.select(F.col("id").alias("target"), F.col("component").alias("other")), "target").where("component = other")
    kinds = ends.groupBy("component").agg(F.min((F.col("kind") == "inherits").cast("int")).alias("inherited"))
    depth = longest_paths(ends.select("component", "source", "target").distinct())
    all_ = facts.join(kinds, "component").join(depth, "component").join(p90).where("tests <= 0.8 AND inherited = 0")
    s = F.col("size")
    severity = 0.4 * clamp(s / 20) + 0.3 * clamp(F.col("modules") / 5) + 0.3 * clamp(F.col("longest") / 10)
    severity = severity * F.when((F.col("modules") > 2) & (F.col("packages") > 2), 1.4).otherwise(1.0) * F.when(s > F.col("p0"), 1.2).otherwise(1.0) * F.when((s == 2) & (F.col("packages") <= 1), 0.5).otherwise(1.0)
    return all_.select("component", "size", "modules", "longest", clamp(severity).alias("severity"), F.lit(0.9).alias("confidence"))


def farther(starts: np.ndarray, ends: np.ndarray, start: int, narrow: bool) -> np.ndarray:
    """Each node's number of hops from start, along links as offsets and ends; narrow: levels of few nodes, which are followed one by one."""
    far = np.full(len(starts) - 1, -1, np.int32)
    far[start] = 0
    if narrow:
        hops, queue, offsets, follow = far.tolist(), [start], starts.tolist(), ends.tolist()
        for x in queue:
            for t in follow[offsets[x] : offsets[x + 1]]:
                if hops[t] < 0:
                    hops[t] = hops[x] + 1
                    queue.append(t)
        return np.array(hops, np.int32)
    front, depth = np.array([start]), 0
    while front.size:
        many = starts[front + 1] - starts[front]
        heads = ends[np.repeat(starts[front] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        depth += 1
        front = np.unique(heads[far[heads] < 0])
        far[front] = depth
    return far


def diameter(n: int, source: np.ndarray, target: np.ndarray) -> int:
    """The greatest distance between two nodes of a strong component.

    A node's farthest is no farther than its way to a pivot and the pivot's farthest; so too backwards. Pivots are by turns the
    node that could yet have the greatest distance and the most central one, until no node's, forwards or backwards, could exceed what was found.
    """
    ways = []
    for a, b in ((source, target), (target, source)):
        order = np.argsort(a, kind="stable")
        ways.append((np.searchsorted(a[order], np.arange(n + 1)), b[order]))
    found, pivot = 0, int((np.bincount(source, minlength=n) * np.bincount(target, minlength=n)).argmax())
    # of each node, forwards and backwards: how far its farthest can be, and is at least
    most, least, narrow, turn = np.full((2, n), n - 1), np.zeros((2, n), int), False, 0
    while True:
        out, back = (farther(*way, pivot, narrow) for way in ways)
        narrow = narrow or n < 16 * int(out.max())
        found = max(found, int(out.max()), int(back.max()))
        most = np.minimum(most, [back + out.max(), out + back.max()])
        least = np.maximum(least, [back, out])
        most[:, pivot] = out.max(), back.max()
        least[:, pivot] = n  # not again
        left = (most > found).sum(1)
        if not left.all():
            return found
        side, turn = left.argmin(), turn + 1
        pivot = int(most[side].argmax() if turn % 2 else least[side].argmin())


def longest_paths(links: DataFrame) -> DataFrame:
    """links: component, source, target, each once. component and longest, the greatest distance within a strong component; a component is one task's, which holds its links as numbers."""

    def search(part: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(part["source"].unique())
        longest = diameter(len(names), names.get_indexer(part["source"]), names.get_indexer(part["target"]))
        return pd.DataFrame({"component": [part["component"].iloc[0]], "longest": [longest]})

    return links.groupBy("component").applyInPandas(search, "component string, longest int")


def cross_package_coupling(nodes: DataFrame, edges: DataFrame, assign: DataFrame, coherence: DataFrame | None = None, null_mean: float | None = None, null_sd: float | None = None, silhouette: float = 0.0) -> DataFrame:
    """Modules whose members stand in two packages or more. coherence: module and coherence, where members have vectors; else the finding is structural only."""
    own = assign.withColumn("package", package_of(F.col("id")))
    parts = own.groupBy("module", "package").agg(F.count("*").alias("n"))
    spread = parts.groupBy("module").agg(F.count("*").alias("packages"), F.sum("n").alias("total"), F.max("n").alias("most")).where("packages >= 2")
    inside = between_modules(edges, assign).where("source <> target AND sm = tm").select(F.col("sm").alias("module"), package_of(F.col("source")).alias("a"), package_of(F.col("target")).alias("b"))
    dense = inside.groupBy("module").agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("density"))
    ways = inside.where("a <> b").groupBy("module", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum((F.col("a") < F.col("b")).cast("long")).alias("f"), F.sum((F.col("a") > F.col("b")).cast("long")).alias("r"))
    both = ways.groupBy("module").agg((F.sum(F.least("f", "r")) / F.sum(F.greatest("f", "r"))).alias("bidirectional"))
    all_ = spread.join(dense, "module", "left").join(both, "module", "left")
    all_ = all_.join(coherence.select("module", "coherence"), "module", "left") if coherence is not None else all_.withColumn("coherence", F.lit(None).cast("double"))
    coherent, effect = F.coalesce("coherence", F.lit(0.0)), cohens_d(F.coalesce("coherence", F.lit(0.0)), F.lit(null_mean or 0.0), F.lit(max(null_sd if null_sd is not None else 0.1, 2.220446049250313e-16)))
    cause = F.when(F.col("coherence").isNull(), "structural_only").when(effect > 0.8, "shared_domain_concept").when(effect > 0.2, "incomplete_split").otherwise("accidental_coupling")
    balance = 1 - F.col("most") / F.col("total")
    severity = 0.3 * clamp((F.col("packages") - 1) / 4) + 0.3 * balance + 0.2 * F.coalesce("density", balance) + 0.2 * clamp(coherent / 0.6)
    severity = severity * (0.4 + 0.6 * F.coalesce("bidirectional", F.lit(0.0))) * F.when(cause == "shared_domain_concept", 1.3).when(cause == "accidental_coupling", 0.7).otherwise(1.0) * (1.2 if silhouette > 0.5 else 1.0)
    sure = 0.5 + F.when(cause == "structural_only", 0.0).when(effect > 0.8, 0.3).when(effect > 0.2, 0.15).otherwise(0.0) + (0.1 if silhouette > 0.4 else 0.0) + F.when(F.col("total") - F.col("most") >= 3, 0.1).otherwise(0.0)
    kept = all_.where((coherent >= (null_mean or 0.0)) | F.lit(silhouette >= 0.3))
    out = kept.select("module", "packages", "total", cause.alias("root_cause"), F.least(severity, F.lit(1.0)).alias("severity"), F.when(cause == "structural_only", F.least(sure, F.lit(0.5))).otherwise(clamp(sure, 0.3, 1.0)).alias("confidence"))
    return out.where("severity >= 0.35")


def near_disconnects(values: DataFrame, edges: DataFrame, null: DataFrame) -> DataFrame:
    """values: module, size, value (its second smallest eigenvalue), id and side (1 or -1), a row for each member; null: value of random parts, of which half may be zero.

    Modules that hang together by less than the 5th percentile of the null ones, with the edges that a cut by sides would take.
    """
    limit = nearest_rank(null, "value", 0.05, 0.5).join(null.agg(F.count("*").alias("draws"))).select(F.when(F.col("draws") >= 5, F.col("p0")).otherwise(0.01).alias("limit"), F.col("p1").alias("median"))
    sides = values.groupBy("module").agg(F.max("value").alias("value"), F.count("*").alias("size"), F.sum((F.col("side") > 0).cast("long")).alias("s1"), F.sum((F.col("side") < 0).cast("long")).alias("s2"))
    low = sides.where("s1 > 0 AND s2 > 0 AND size >= 5").join(limit).where("value < limit")
    a, b = values.select(F.col("id").alias("source"), F.col("module").alias("m"), F.col("side").alias("x")), values.select(F.col("id").alias("target"), F.col("module").alias("n"), F.col("side").alias("y"))
    inside = edges.where("kind <> 'defines' AND source <> target").join(a, "source").join(b, "target").where("m = n").groupBy(F.col("m").alias("module")).agg(F.count("*").alias("inside"), F.sum((F.col("x") != F.col("y")).cast("long")).alias("crossing"))
    cut = F.floor((F.col("crossing") + 1) / 2)
    expected = 2.0 * F.col("inside") * F.col("s1") * F.col("s2") / (F.col("size") * (F.col("size") - 1))
    severity = 0.4 * clamp(1 - F.col("value") / F.greatest("median", F.lit(2.220446049250313e-16))) + 0.3 * clamp(1 - cut / F.greatest(expected, F.lit(1.0))) + 0.3 * F.least("s1", "s2") / F.greatest("s1", "s2")
    return low.join(inside, "module").select("module", "size", "value", cut.alias("cut"), clamp(severity).alias("severity"), F.lit(0.8).alias("confidence"))
