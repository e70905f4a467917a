"""Modules: their labels, groups, health and place in reports. An assignment is id and module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import package_of, rounded
from graphloom.operators.graphs import defines_parents, modularity, self_edge_ratio
from graphloom.operators.tables import stored


def placed(df: DataFrame, *order) -> DataFrame:
    """df with place, from 1, in this order: counted by range, so that no task sorts all."""
    parts = stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    first = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "first")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(first), "part").withColumn("place", (F.col("first") + own).cast("int")).drop("part", "first")


def labels(assign: DataFrame) -> DataFrame:
    """module and label: of one package the longest common dotted prefix, else the package with most members, and the second if it has over a quarter. Ties go to the smaller name."""
    counts = assign.groupBy("module", package_of(F.col("id")).alias("package")).agg(F.count("*").alias("n"))
    ranked = counts.groupBy("module").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "package"))).alias("r"), F.sum("n").alias("total"))
    level = assign.select("module", F.split("id", r"\.").alias("p")).withColumn("least", F.size("p")).select("module", "least", F.posexplode("p").alias("k", "part"))
    same = level.groupBy("module", "k").agg(F.min("part").alias("part"), (F.min("part") == F.max("part")).alias("one"), F.count("*").alias("have"))
    sizes = assign.groupBy("module").agg(F.count("*").alias("members"))
    fine = same.join(sizes, "module").groupBy("module").agg(F.array_sort(F.collect_list(F.struct("k", "part", (F.col("one") & (F.col("have") == F.col("members"))).alias("one")))).alias("levels"))
    until = F.aggregate("levels", F.struct(F.lit(True).alias("on"), F.lit("").alias("label")), lambda s, x: F.struct((s["on"] & x["one"]).alias("on"), F.when(s["on"] & x["one"], F.concat(s["label"], F.when(s["label"] == "", "").otherwise("."), x["part"])).otherwise(s["label"]).alias("label")), lambda s: s["label"])
    many = F.when((F.size("r") > 1) & (-F.element_at("r", 2)["minus"] * 4 > F.col("total")), F.concat(F.element_at("r", 1)["package"], F.lit(" + "), F.element_at("r", 2)["package"])).otherwise(F.element_at("r", 1)["package"])
    return ranked.join(fine, "module").withColumn("prefix", until).select("module", F.when((F.size("r") == 1) & (F.col("prefix") != ""), F.col("prefix")).otherwise(many).alias("label"))


def distinct_labels(modules: DataFrame) -> DataFrame:
    """modules: id, label and other (a package that is not in the label, or null). Labels that recur get the package, or the id; those that still do, the id."""
    group = lambda x: F.concat(x, F.lit(" (group "), F.col("id").cast("string"), F.lit(")"))
    again = lambda: F.count("*").over(Window.partitionBy("label")) > 1
    first = modules.withColumn("again", again()).withColumn("label", F.when(~F.col("again"), F.col("label")).when(F.col("other").isNotNull(), F.concat("label", F.lit(" (+ "), "other", F.lit(")"))).otherwise(group(F.col("label"))))
    return first.withColumn("again", again()).select("id", F.when(F.col("again"), group(F.col("label"))).otherwise(F.col("label")).alias("label"))


def package_groups(nodes: DataFrame) -> DataFrame:
    """id and cluster: packages numbered by name."""
    ids = nodes.select("id").distinct().withColumn("package", package_of(F.col("id")))
    numbers = placed(ids.select("package").distinct(), "package").select("package", (F.col("place") - 1).alias("cluster"))
    return ids.join(numbers, "package").select("id", "cluster")


def propagated(nodes: DataFrame, edges: DataFrame, given: DataFrame) -> DataFrame:
    """given: id and cluster. Each node's cluster, or that of its nearest ancestor by defines that has one; none above, no row. Pointers skip what has none and double."""
    ids = nodes.select("id").distinct()
    now = stored(ids.join(defines_parents(edges), "id", "left").join(given, "id", "left").select("id", "cluster", F.when(F.col("cluster").isNull(), F.col("parent")).alias("up")), "pointers")
    step, most = 1, now.count()
    while step <= most and not now.where("up IS NOT NULL").isEmpty():
        then = now.select(F.col("id").alias("up"), F.col("cluster").alias("above"), F.col("up").alias("far"))
        now = stored(now.join(then, "up", "left").select("id", F.coalesce("cluster", "above").alias("cluster"), "far").select("id", "cluster", F.when(F.col("cluster").isNull(), F.col("far")).alias("up")), "pointers")
        step *= 2
    return now.where("cluster IS NOT NULL").select("id", "cluster")


def architecture(pairs: DataFrame, modules: DataFrame) -> DataFrame:
    """pairs: sm and tm, different directed pairs. One row: monolith, layered, modular or a number of modules."""
    back = pairs.select(F.col("sm").alias("tm"), F.col("tm").alias("sm"))
    counts = modules.agg(F.count("*").alias("m")).join(pairs.agg(F.count("*").alias("d"))).join(pairs.join(back, ["sm", "tm"]).agg(F.count("*").alias("b")))
    m = F.col("m").cast("string")
    return counts.select(F.when(F.col("m") <= 1, "monolith").when((F.col("d") >= 2) & (F.col("b") == 0), F.concat(F.lit("layered ("), m, F.lit(" tiers)"))).when(F.col("m") > 6, F.concat(F.lit("modular ("), m, F.lit(" modules)"))).otherwise(F.concat(m, F.lit(" modules"))).alias("architecture"))


def context_modules(assign: DataFrame, concerns: DataFrame, all_up_to: int = 15, top: int = 10) -> DataFrame:
    """module and size: all if there are few, else the largest and those of concern."""
    sizes = assign.groupBy("module").agg(F.count("*").alias("size"))
    ranked = placed(sizes, F.desc("size"), "module").join(sizes.agg(F.count("*").alias("n"))).join(concerns.withColumn("told", F.lit(True)), "module", "left")
    return ranked.where((F.col("n") <= all_up_to) | (F.col("place") <= top) | F.col("told")).select("module", "size")


def without_tests(components: DataFrame, is_test: Column) -> DataFrame:
    """component and size of those of which at most four fifths are tests."""
    facts = components.groupBy("component").agg(F.count("*").alias("size"), F.sum(is_test.cast("long")).alias("tests"))
    return facts.where("tests * 5 <= size * 4").select("component", "size")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges between these nodes."""
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "kind")


def health(nodes: DataFrame, edges: DataFrame, assign: DataFrame) -> DataFrame:
    """One row: modularity_q, coverage, self_edge_drop, modules and nodes."""
    q = modularity(edges, assign).select(rounded(F.col("q")).alias("modularity_q"))
    ids = nodes.select("id").distinct()
    cover = ids.join(assign.select("id", "module"), "id", "left").agg(rounded(F.count("module") / F.count("*")).alias("coverage"), F.count_distinct("module").alias("modules"), F.count("*").alias("nodes"))
    drop = self_edge_ratio(nodes, edges, "package").select(rounded(F.col("self_edges") / F.col("scoped")).alias("self_edge_drop"))
    return q.join(cover).join(drop).select("modularity_q", "coverage", "self_edge_drop", "modules", "nodes")
