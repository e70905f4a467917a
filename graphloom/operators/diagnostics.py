"""Roles and issue detectors over degrees, assignments and widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import clamp, direction_significant, package_of, severity_label
from graphloom.operators.graphs import degrees, interface_width, percentile_ranks, portions
from graphloom.operators.tables import stored


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """One row: q1, median, q3 by linear interpolation, and Tukey's fences."""
    p = F.percentile(F.col(value).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    q = df.agg(p.alias("p")).select(F.col("p")[0].alias("q1"), F.col("p")[1].alias("median"), F.col("p")[2].alias("q3"))
    return q.select("q1", "median", "q3", (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_fence"), (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower_fence"))


def roles(nodes: DataFrame, edges: DataFrame, betweenness: DataFrame | None = None) -> DataFrame:
    """id and role: orphan, regular, bridge, utility, entry_point or hub. betweenness: id and betweenness; without it no node is a bridge. One-row thresholds are joined, not collected."""
    all_ = stored(degrees(nodes, edges, None).select("id", (F.col("in_degree") + F.col("out_degree")).alias("full")).join(degrees(nodes, edges), "id"), "degrees")
    d = all_.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    d = d.withColumn("lean", F.when(F.col("degree") > 0, (F.col("out_degree") - F.col("in_degree")) / F.col("degree")).otherwise(0.0))
    hub = quartiles(d, "degree").select(F.col("upper_fence").alias("hub_fence"))
    leaning = quartiles(d.where("degree > 0").select(F.abs("lean").alias("a")), "a").select(clamp(F.col("upper_fence"), 0.5, 0.9).alias("lean_fence"))
    mean = d.agg(F.floor(F.greatest(F.avg("degree") - F.stddev_pop("degree"), F.lit(2.0))).alias("least"))
    ranked = percentile_ranks(d, "degree").join(hub).join(leaning).join(mean)
    bridge = F.lit(False)
    if betweenness is not None:
        ranked = ranked.join(percentile_ranks(betweenness, "betweenness").select("id", "betweenness", F.col("rank").alias("between")), "id")
        bridge = (F.col("betweenness") > 0) & (F.col("between") >= 0.9) & (F.col("rank") < 0.9)
    role = (
        F.when(F.col("full") == 0, "orphan").when(F.col("degree") == 0, "regular").when(bridge, "bridge")
        .when((F.col("degree") >= F.col("least")) & (F.col("lean") <= -F.col("lean_fence")), "utility")
        .when((F.col("degree") >= F.col("least")) & (F.col("lean") >= F.col("lean_fence")), "entry_point")
        .when((F.col("rank") >= 0.9) & (F.col("degree") >= F.col("hub_fence")) & (F.abs("lean") < F.col("lean_fence")), "hub").otherwise("regular")
    )
    return ranked.select("id", role.alias("role"))


def wide_interfaces(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Module pairs whose width is above the truncated fence of all widths, with severity, each by its wider direction (equal: the smaller name first); none below six directed pairs."""
    widths = stored(interface_width(edges, assign), "widths")
    fence = quartiles(widths, "width").join(widths.agg(F.count("*").alias("pairs"))).select(F.floor("upper_fence").cast("long").alias("fence"), "pairs")
    back = widths.select(F.col("source_module").alias("target_module"), F.col("target_module").alias("source_module"), F.col("width").alias("reverse"))
    w = widths.join(back, ["source_module", "target_module"], "left").withColumn("reverse", F.coalesce("reverse", F.lit(0))).join(fence).where("pairs >= 6 AND width > fence")
    w = w.where((F.col("width") > F.col("reverse")) | ((F.col("width") == F.col("reverse")) & (F.col("source_module") < F.col("target_module"))))
    excess = clamp((F.col("width") - F.col("fence")) / F.greatest(F.col("fence"), F.lit(1)))
    asymmetry = 1 - F.least("width", "reverse") / F.greatest("width", "reverse")
    sev = 0.5 * excess + 0.3 * asymmetry + 0.2 * clamp(F.col("max_target") / F.col("width"))
    sev = sev * F.when(F.col("reverse") > F.col("fence"), 1.3).otherwise(1.0) * F.when(package_of(F.col("source_module")) == package_of(F.col("target_module")), 0.7).otherwise(1.0)
    return w.select("source_module", "target_module", "width", "reverse", F.least(F.lit(1.0), sev).alias("severity")).withColumn("label", severity_label(F.col("severity")))


def direction(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Module pairs (a < b) with counts both ways, and whether the direction is significant."""
    a = assign.select(F.col("id").alias("source"), F.col("module").alias("sm"))
    b = assign.select(F.col("id").alias("target"), F.col("module").alias("tm"))
    both = edges.where("kind <> 'defines'").join(a, "source").join(b, "target").where("sm <> tm")
    pairs = both.groupBy(F.least("sm", "tm").alias("a"), F.greatest("sm", "tm").alias("b")).agg(F.sum((F.col("sm") < F.col("tm")).cast("long")).alias("forward"), F.sum((F.col("sm") > F.col("tm")).cast("long")).alias("backward"))
    return pairs.withColumn("significant", direction_significant(F.least("forward", "backward"), F.col("forward") + F.col("backward")))


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Adds rejected: all ranks up to the greatest k with p_k <= k / m * alpha. Equal values share the greatest rank, so the window runs over distinct values."""
    counts = df.groupBy(p).agg(F.count("*").alias("times"))
    ranked = counts.withColumn("k", F.sum("times").over(Window.orderBy(p))).withColumn("m", F.sum("times").over(Window.partitionBy(F.lit(1))))
    small = F.when(F.col("m") == 1, F.col(p) < alpha).otherwise(F.col(p) <= F.col("k") / F.col("m") * alpha)  # one value alone has to be strictly less
    limit = ranked.where(small).agg(F.max(p).alias("limit"))
    return df.join(limit).withColumn("rejected", F.coalesce(F.col(p) <= F.col("limit"), F.lit(False))).drop("limit")


def expected_diversity(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """For each called node: callers' modules, and how many its in-degree would meet by chance, K - sum (1 - d_m / E)^d."""
    a = assign.select(F.col("id").alias("source"), "module")
    calls = edges.where("kind = 'calls'").select("source", "target").repartition(portions(assign), "source").join(a, "source")
    # a row for each target and caller's module is all that the rest needs
    calls = stored(calls.groupBy("target", "module").agg(F.count("*").alias("n")), "callers")
    modules = calls.groupBy("module").agg(F.sum("n").alias("out"))
    total = modules.agg(F.sum("out").alias("e"), F.count("*").alias("k"))
    shares = modules.join(total).select("k", (1 - F.col("out") / F.col("e")).alias("miss"))
    # the chance depends on the in-degree alone: one row for each
    seen = calls.groupBy(F.col("target").alias("id")).agg(F.sum("n").alias("d"), F.count("module").alias("observed"))
    chance = seen.select("d").distinct().join(shares).groupBy("d").agg((F.max("k") - F.sum(F.pow("miss", "d"))).alias("expected"))
    return seen.join(chance, "d").select("id", "observed", "expected")


def relationships(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Directed module pairs as integration (calls and imports), runtime (calls), structural (imports) or hierarchy."""
    from graphloom.operators.graphs import module_dependencies

    kinds = module_dependencies(edges, assign).groupBy("source_module", "target_module").agg(F.max((F.col("kind") == "calls").cast("int")).alias("c"), F.max((F.col("kind") == "imports").cast("int")).alias("i"))
    label = F.when((F.col("c") == 1) & (F.col("i") == 1), "integration").when(F.col("c") == 1, "runtime").when(F.col("i") == 1, "structural").otherwise("hierarchy")
    return kinds.select("source_module", "target_module", label.alias("relationship"))


def suffix_matches(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """name and id: names found as a dotted suffix of one node only. Suffixes are exploded and joined by equality."""
    parts = F.split("id", r"\.")
    ends = nodes.select("id").distinct().select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("name"))
    return ends.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").join(names, "name").select("name", "id")


def web_roles(nodes: DataFrame, edges: DataFrame, betweenness: DataFrame) -> DataFrame:
    """id and role by fixed thresholds, with every edge counted, self-edges and defines too."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    d = stored(nodes.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o")).withColumn("degree", F.col("i") + F.col("o")), "degrees")
    lean = (F.col("o") - F.col("i")) / F.col("degree")
    all_ = percentile_ranks(d, "degree").join(percentile_ranks(betweenness, "betweenness").select("id", F.col("rank").alias("between")), "id").join(d.agg(F.median("degree").alias("middle")))
    role = (
        F.when(F.col("degree") == 0, "orphan").when((F.col("between") >= 0.9) & (F.col("rank") < 0.9), "bridge")
        .when((F.col("degree") >= 3) & (lean <= -0.6), "utility").when((F.col("degree") >= 3) & (lean >= 0.6), "entry_point")
        .when((F.col("rank") >= 0.9) & (F.col("degree") >= F.col("middle") + 2) & (F.abs(lean) < 0.6), "hub").otherwise("regular")
    )
    return all_.select("id", role.alias("role"))
