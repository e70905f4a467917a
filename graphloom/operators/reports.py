"""Issues, repositories and history as tables: filters, reports and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import normalized_name, rounded, severity_label, size_class


def acknowledged(issues: DataFrame, ignored: DataFrame) -> DataFrame:
    """Issues with state: acknowledged if their id is ignored, else active."""
    known = ignored.select("id").distinct().withColumn("known", F.lit(True))
    return issues.join(known, "id", "left").withColumn("state", F.when(F.col("known"), "acknowledged").otherwise("active")).drop("known")


def assembled(issues: DataFrame) -> DataFrame:
    """id as kind and id, severity to 4 digits, labels of the unrounded values."""
    return issues.select(F.concat_ws(":", "kind", F.col("id").cast("string")).alias("id"), rounded(F.col("severity")).alias("severity"), severity_label(F.col("severity")).alias("severity_label"), severity_label(F.col("confidence")).alias("confidence_label"))


def by_first_anchor(issues: DataFrame, assign: DataFrame) -> DataFrame:
    """issues: id and anchors; assign: anchor and module. id and module of the first anchor that has one."""
    each = issues.select("id", F.posexplode("anchors").alias("pos", "anchor")).join(assign, "anchor")
    return each.groupBy("id").agg(F.min_by("module", "pos").alias("module"))


def distribution(issues: DataFrame) -> DataFrame:
    """By kind: in how many repos it fires, the rate and its flag, and mean, median, 90th percentile (nearest rank from above) and maximum of severity. Ranks come from counts of distinct values."""
    repos = issues.agg(F.count_distinct("repo").alias("repos"))
    counts = issues.groupBy("kind", "severity").agg(F.count("*").alias("times"))
    w = Window.partitionBy("kind")
    upto = counts.withColumn("upto", F.sum("times").over(w.orderBy("severity"))).withColumn("n", F.sum("times").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("severity")))
    values = upto.groupBy("kind").agg((F.sum(F.col("severity") * F.col("times")) / F.max("n")).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("severity").alias("most"))
    fires = issues.groupBy("kind").agg(F.count_distinct("repo").alias("fires")).join(repos).withColumn("rate", F.col("fires") / F.col("repos"))
    flag = F.when(F.col("rate") < 0.05, "dead").when(F.col("rate") > 0.6, "noisy").otherwise("")
    return fires.join(values, "kind").select("kind", "fires", rounded(F.col("rate")).alias("rate"), flag.alias("flag"), *[rounded(F.col(c)).alias(c) for c in ("mean", "p50", "p90", "most")])


def cooccurrence(rows: DataFrame) -> DataFrame:
    """rows: group and kind. How many groups have each two kinds; a group's kinds are few, and pair within the group's one row."""
    sets = rows.groupBy("group").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    pairs = sets.select("kinds", F.explode("kinds").alias("a")).select("a", F.explode(F.filter("kinds", lambda k: k > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def scorecard(runs: DataFrame) -> DataFrame:
    """runs: mutation, hit, wrong and collateral. Sensitivity, specificity, their net and the mean collateral."""
    r = runs.groupBy("mutation").agg(F.count("*").alias("repos"), F.avg(F.col("hit").cast("double")).alias("s"), F.avg(F.col("wrong").cast("double")).alias("w"), F.avg("collateral").alias("c"))
    return r.select("mutation", "repos", rounded(F.col("s")).alias("sensitivity"), rounded(1 - F.col("w")).alias("specificity"), rounded(F.col("s") - F.col("w")).alias("net"), rounded(F.col("c")).alias("collateral"))


def new_kinds(clean: DataFrame, mutated: DataFrame) -> DataFrame:
    """repo, kind and new, of the kinds found in what was mutated."""
    old = clean.select("repo", "kind").distinct().withColumn("old", F.lit(True))
    return mutated.select("repo", "kind").distinct().join(old, ["repo", "kind"], "left").select("repo", "kind", F.col("old").isNull().alias("new"))


def coverage(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """labels: label; targets: label, low and high, in percent. Each label's share against its band."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    share = counts.join(counts.agg(F.sum("n").alias("all"))).select("label", (F.col("n") * 100.0 / F.col("all")).alias("pct"))
    both = share.join(targets, "label", "full").withColumn("pct", F.coalesce("pct", F.lit(0.0)))
    state = F.when(F.col("low").isNull(), "no_target").when(F.col("pct") < F.col("low"), "low").when(F.col("pct") > F.col("high"), "high").otherwise("ok")
    return both.select("label", "pct", state.alias("state"))


def prefilter_reason(licenses: tuple[str, ...]) -> Column:
    """Why a repository is not taken, or ok. Columns: license, idle (days, null without dates), kb, people, stars, age (years) and ci."""
    return (
        F.when(F.col("license").isNull() | ~F.col("license").isin(*licenses), F.concat(F.lit("license:"), F.coalesce("license", F.lit("none"))))
        .when(F.col("idle").isNull(), "missing_dates").when(F.col("idle") >= 1095, "inactive").when(F.col("kb") < 50, "size")
        .when((F.col("people") < F.when(F.col("stars") >= 50, 10).otherwise(20)) & (F.col("age") < 2), "contributors").when(~F.col("ci"), "no_ci_cd").otherwise("ok")
    )


def domain(deps: Column, signals: dict[str, tuple[str, ...]], otherwise: str = "other") -> Column:
    """The first domain of which a dependency is a signal."""
    out = F.lit(otherwise)
    for name, own in reversed(list(signals.items())):
        out = F.when(F.arrays_overlap(deps, F.array(*map(F.lit, own))), name).otherwise(out)
    return out


def curated(repos: DataFrame, licenses: tuple[str, ...], cap: int = 8) -> DataFrame:
    """Repositories that pass, with their normal name and size, at most so many of an owner: the report's feature, in order of id."""
    fine = repos.where(prefilter_reason(licenses) == "ok")
    first = fine.withColumn("k", F.row_number().over(Window.partitionBy("org").orderBy("id"))).where(F.col("k") <= cap)
    return first.withColumn("name", normalized_name(F.col("name"))).withColumn("size", size_class(F.col("kb"))).drop("k")


def split(rows: DataFrame, train: float, validation: float) -> DataFrame:
    """rows: id, stratum and draw. id and split, by the order of draws within each stratum; one of each at least is trained on."""
    w = Window.partitionBy("stratum")
    ranked = rows.withColumn("k", F.row_number().over(w.orderBy("draw", "id"))).withColumn("n", F.count("*").over(w))
    upto = F.greatest(F.lit(1), F.floor(F.col("n") * train))
    return ranked.select("id", F.when(F.col("k") <= upto, "train").when(F.col("k") <= upto + F.floor(F.col("n") * validation), "validation").otherwise("test").alias("split"))


def to_process(nodes: DataFrame, done: DataFrame, least: int, most: int) -> DataFrame:
    """nodes: repo and id. repo and nodes, of repos of a size within bounds that are not done."""
    return nodes.groupBy("repo").agg(F.count("*").alias("nodes")).where(F.col("nodes").between(least, most)).join(done, "repo", "left_anti")


def validated(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """By repo: enough nodes, an edge for each two of them, and two kinds of edges."""
    n = nodes.groupBy("repo").agg(F.count("*").alias("n"))
    e = edges.groupBy("repo").agg(F.count("*").alias("e"), F.count_distinct("kind").alias("kinds"))
    both = n.join(e, "repo", "left")
    zero = F.lit(0)
    return both.select("repo", (F.col("n") >= least).alias("enough"), (F.coalesce("e", zero) >= F.col("n") / 2).alias("connected"), (F.coalesce("kinds", zero) >= 2).alias("typed"))


def batch_report(scores: DataFrame) -> DataFrame:
    """scores: split and score."""
    return scores.groupBy("split").agg(F.count("*").alias("repos"), rounded(F.avg("score")).alias("mean"), rounded(F.median("score")).alias("middle"), rounded(F.min("score")).alias("least"), rounded(F.max("score")).alias("most"))


def gate(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: each check, and go if all hold."""
    all_ = F.lit(True)
    for c in checks.values():
        all_ = all_ & c
    return row.select(*[c.alias(k) for k, c in checks.items()], F.when(all_, "go").otherwise("no go").alias("verdict"))


def issue_text(issues: DataFrame) -> DataFrame:
    """One row: a line for each issue, the severest first. A report is one string, so this is for what a reader can take in."""
    line = F.concat(F.lit("["), severity_label(F.col("severity")), F.lit("] "), F.col("kind"), F.lit(" "), F.col("id").cast("string"))
    rows = issues.agg(F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), "id", line.alias("line")))).alias("r"))
    return rows.select(F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))


def trend(history: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """By key: whether the last value is over a tenth above the first, or below it; null for fewer than three days."""
    ends = history.groupBy(key).agg(F.count("*").alias("n"), F.min_by(value, day).alias("first"), F.max_by(value, day).alias("last"))
    label = F.when(F.col("n") < 3, None).when(F.col("last") > F.col("first") * 1.1, "increasing").when(F.col("last") < F.col("first") * 0.9, "decreasing").otherwise("stable")
    return ends.select(key, label.alias("trend"))


def without_paths(files: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Files of which no component of the path is one of these."""
    return files.where(~F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, parts))))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"/tests?/|_test\.|test_|/spec/|_test$")


def module_of_path(path: Column) -> Column:
    """A path as a dotted id; a package is named without its __init__."""
    return F.replace(F.regexp_replace(F.regexp_replace(F.ltrim(path, F.lit("/")), r"\.py$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))


def best_root(path: Column, roots: tuple[str, ...]) -> Column:
    """The longest root that holds the path, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(roots, key=len):
        out = F.when(F.startswith(path, F.lit(r + "/")), r).otherwise(out)
    return out


def relative(module: Column, level: Column, name: Column, most: int) -> Column:
    """The absolute name of an import with so many leading dots from a module, or null above the root."""
    parts = F.split(module, r"\.")
    keep = F.size(parts) - level
    return F.when(level > most, None).otherwise(F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), F.array(name)), "."))


def import_validated(calls: DataFrame, imports: DataFrame, module_of: Callable[[Column], Column]) -> DataFrame:
    """Calls whose module imports a dotted prefix of what is called.

    That is a matter of the caller's module and of what the called name stands in: only such pairs, few beside calls, are
    exploded to prefixes and joined, and travel to the calls.
    """
    module, parent = module_of(F.col("source")), F.regexp_extract("target", r"^(.*)\.[^.]*$", 1)
    parts = F.split("parent", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    wanted = calls.where("instr(target, '.') > 0").select(module.alias("module"), parent.alias("parent")).distinct().withColumn("prefix", F.explode(prefixes))
    fine = wanted.join(imports.select(F.col("source").alias("module"), F.col("target").alias("prefix")).distinct(), ["module", "prefix"]).select(F.col("module").alias("from_module"), F.col("parent").alias("to_parent")).distinct()
    return calls.join(F.broadcast(fine), (module == F.col("from_module")) & (parent == F.col("to_parent")) & (F.instr("target", ".") > 0), "left_semi")


def analysis_row(edges: DataFrame) -> DataFrame:
    """One row, also of an empty graph: no modules, the fallback, and no value."""
    n = edges.agg(F.count("*").alias("n"))
    return n.select(F.lit(0).alias("modules"), (F.col("n") == 0).alias("fallback"), F.lit(None).cast("double").alias("fiedler"))
