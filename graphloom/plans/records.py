"""Queries over tables of issues, repositories, files and history, and the SQL each is held against.

The given tables stand for them: orders are issues, customers repositories, events a history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import components as C
from graphloom.operators import diagnostics as D
from graphloom.operators import graphs as G
from graphloom.operators import kernels as K
from graphloom.operators import modules as M
from graphloom.operators import reports as R
from graphloom.plans.registry import more, query, rnd
from graphloom.sources import documents, views

ISSUES = "i AS (SELECT o_orderkey AS id, c_nationkey AS repo, o_custkey AS node, lower(substring(o_orderpriority, 3)) AS kind, least(o_totalprice / 500000, 1.0) AS severity, CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.6 ELSE 0.3 END AS confidence FROM orders JOIN customer ON o_custkey = c_custkey)"


def issues(spark, d: str) -> DataFrame:
    """id, repo, node, kind, severity and confidence."""
    o, c = views.table(spark, d, "orders"), views.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("repo"))
    sure = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.6).otherwise(0.3)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), "repo", F.col("o_custkey").alias("node"), F.lower(F.expr("substring(o_orderpriority, 3)")).alias("kind"), F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("severity"), sure.alias("confidence"))


@query("filter_issue_ignores", None, f"WITH {ISSUES} SELECT id, CASE WHEN id % 7 = 0 THEN 'acknowledged' ELSE 'active' END AS state FROM i")
def _(spark, d):
    found = issues(spark, d)
    return R.acknowledged(found, found.where("id % 7 = 0").select("id")).select("id", "state")


@query("sort_issues", None, f"WITH {ISSUES} SELECT id, CAST(row_number() OVER (ORDER BY severity DESC, confidence DESC, kind, id) AS INTEGER) AS place FROM i")
def _(spark, d):
    return M.placed(issues(spark, d), F.desc("severity"), F.desc("confidence"), "kind", "id").select("id", "place")


@query("issue_score_assembly", None, f"WITH {ISSUES} SELECT kind || ':' || id AS id, {rnd('severity')} AS severity, CASE WHEN severity >= 0.75 THEN 'high' WHEN severity >= 0.45 THEN 'medium' ELSE 'low' END AS severity_label, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS confidence_label FROM i")
def _(spark, d):
    return R.assembled(issues(spark, d)).select("id", "severity", "severity_label", "confidence_label")


@query("issues_by_module", None, f"WITH {ISSUES}, a AS (SELECT i.id, k, (i.node * 31 + k * 17) % 1000 AS anchor FROM i, range(0, 3) t(k)), f AS (SELECT id, arg_min(c_mktsegment, k) AS module FROM a JOIN customer ON c_custkey = anchor AND c_custkey % 3 = 0 GROUP BY id) SELECT module, count(*) AS n FROM f GROUP BY module")
def _(spark, d):
    anchors = issues(spark, d).select("id", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (F.col("node") * 31 + k * 17) % 1000).alias("anchors"))
    assign = views.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("anchor"), F.col("c_mktsegment").alias("module"))
    return R.by_first_anchor(anchors, assign).groupBy("module").agg(F.count("*").alias("n"))


@query("agg_distribution_report", None, f"WITH {ISSUES}, n AS (SELECT count(DISTINCT repo) AS repos FROM i), s AS (SELECT kind, list_sort(list(severity)) AS v, avg(severity) AS m, count(DISTINCT repo) AS fires FROM i GROUP BY kind) SELECT kind, fires, {rnd('fires / repos')} AS rate, CASE WHEN fires / repos < 0.05 THEN 'dead' WHEN fires / repos > 0.6 THEN 'noisy' ELSE '' END AS flag, {rnd('m')} AS mean, {rnd('v[CAST(floor(len(v) / 2) AS INTEGER) + 1]')} AS p50, {rnd('v[CAST(floor(len(v) * 0.9) AS INTEGER) + 1]')} AS p90, {rnd('v[len(v)]')} AS most FROM s, n")
def _(spark, d):
    return R.distribution(issues(spark, d))


@query("agg_cooccurrence", None, f"WITH {ISSUES}, k AS (SELECT DISTINCT repo, node, kind FROM i) SELECT a.kind AS a, b.kind AS b, count(*) AS n FROM k a JOIN k b ON a.repo = b.repo AND a.node = b.node AND a.kind < b.kind GROUP BY ALL")
def _(spark, d):
    return R.cooccurrence(issues(spark, d).select(F.struct("repo", "node").alias("group"), "kind"))


@query("agg_scorecard", None, f"WITH {ISSUES}, r AS (SELECT kind, repo, max(severity) > 0.9 AS hit, min(severity) < 0.05 AS wrong, count(*) AS n FROM i GROUP BY kind, repo) SELECT kind AS mutation, count(*) AS repos, {rnd('avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)')} AS sensitivity, {rnd('1 - avg(CASE WHEN wrong THEN 1.0 ELSE 0.0 END)')} AS specificity, {rnd('avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN wrong THEN 1.0 ELSE 0.0 END)')} AS net, {rnd('avg(n)')} AS collateral FROM r GROUP BY kind")
def _(spark, d):
    runs = issues(spark, d).groupBy(F.col("kind").alias("mutation"), "repo").agg((F.max("severity") > 0.9).alias("hit"), (F.min("severity") < 0.05).alias("wrong"), F.count("*").alias("collateral"))
    return R.scorecard(runs)


@query("eval_mutations", None, f"WITH {ISSUES}, c AS (SELECT DISTINCT repo, kind FROM i WHERE id % 50 = 0), m AS (SELECT DISTINCT repo, kind FROM i WHERE id % 20 = 0) SELECT m.repo, m.kind, c.kind IS NULL AS new FROM m LEFT JOIN c USING (repo, kind)")
def _(spark, d):
    i = issues(spark, d)
    return R.new_kinds(i.where("id % 50 = 0"), i.where("id % 20 = 0"))


@query("agg_coverage_report", None, "WITH s AS (SELECT c_mktsegment AS label, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM customer GROUP BY c_mktsegment), t(label, low, high) AS (VALUES ('BUILDING', 15, 25), ('MACHINERY', 30, 40), ('NONE', 1, 2), ('FURNITURE', 0, 10)) SELECT coalesce(s.label, t.label) AS label, " + rnd("coalesce(pct, 0)", 2) + " AS pct, CASE WHEN low IS NULL THEN 'no_target' WHEN coalesce(pct, 0) < low THEN 'low' WHEN pct > high THEN 'high' ELSE 'ok' END AS state FROM s FULL JOIN t ON s.label = t.label")
def _(spark, d):
    targets = spark.sql("SELECT * FROM VALUES ('BUILDING', 15, 25), ('MACHINERY', 30, 40), ('NONE', 1, 2), ('FURNITURE', 0, 10) AS t(label, low, high)")
    return R.coverage(views.table(spark, d, "customer").select(F.col("c_mktsegment").alias("label")), targets).withColumn("pct", S.rounded(F.col("pct"), 2))


REPOS = "r AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '-')) AS name, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'WTFPL' ELSE 'MIT' END AS license, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 2000 END AS idle, abs(CAST(floor(c_acctbal) AS INTEGER)) AS kb, c_custkey % 40 AS people, c_custkey % 90 AS stars, c_custkey % 6 AS age, c_custkey % 5 > 0 AS ci, c_mktsegment AS org FROM customer)"


def repos(spark, d: str) -> DataFrame:
    c = views.table(spark, d, "customer")
    k = F.col("c_custkey")
    license_ = F.when(k % 11 == 0, None).when(k % 7 == 0, "WTFPL").otherwise("MIT")
    return c.select(k.alias("id"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("name"), license_.alias("license"), F.when(k % 13 == 0, None).otherwise(k % 2000).alias("idle"), F.abs(F.floor("c_acctbal").cast("int")).alias("kb"), (k % 40).alias("people"), (k % 90).alias("stars"), (k % 6).alias("age"), (k % 5 > 0).alias("ci"), F.col("c_mktsegment").alias("org"))


REASON = "CASE WHEN license IS NULL OR license <> 'MIT' THEN 'license:' || coalesce(license, 'none') WHEN idle IS NULL THEN 'missing_dates' WHEN idle >= 1095 THEN 'inactive' WHEN kb < 50 THEN 'size' WHEN people < CASE WHEN stars >= 50 THEN 10 ELSE 20 END AND age < 2 THEN 'contributors' WHEN NOT ci THEN 'no_ci_cd' ELSE 'ok' END"


@query("repo_prefilter", None, f"WITH {REPOS} SELECT id, {REASON} AS reason FROM r")
def _(spark, d):
    return repos(spark, d).select("id", R.prefilter_reason(("MIT",)).alias("reason"))


@query("ds_curate", None, f"WITH {REPOS}, k AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY id) AS n FROM r WHERE {REASON} = 'ok') SELECT id, replace(replace(name, '-', '_'), '.', '_') AS name, org, CASE WHEN kb < 2000 THEN 'small' WHEN kb < 20000 THEN 'medium' ELSE 'large' END AS size FROM k WHERE n <= 8")
def _(spark, d):
    return R.curated(repos(spark, d), ("MIT",), cap=8).select("id", "name", "org", "size")


@query("fn_classify_size_domain", None, f"WITH {REPOS} SELECT id, CASE WHEN kb < 2000 THEN 'small' WHEN kb < 20000 THEN 'medium' ELSE 'large' END AS size, CASE WHEN org IN ('BUILDING', 'MACHINERY') THEN 'systems' WHEN org = 'HOUSEHOLD' THEN 'web' ELSE 'other' END AS domain FROM r")
def _(spark, d):
    signals = {"systems": ("BUILDING", "MACHINERY"), "web": ("HOUSEHOLD",)}
    return repos(spark, d).select("id", S.size_class(F.col("kb")).alias("size"), R.domain(F.array("org"), signals).alias("domain"))


@query("fn_normalize_name", None, f"WITH {REPOS} SELECT id, replace(replace(lower(name), '-', '_'), '.', '_') AS name FROM r")
def _(spark, d):
    return repos(spark, d).select("id", S.normalized_name(F.col("name")).alias("name"))


@query("ds_split", None, "WITH s AS (SELECT s_suppkey AS id, s_nationkey AS stratum, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey * 7919) % 10007, s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT id, CASE WHEN k <= greatest(1, floor(n * 0.8)) THEN 'train' WHEN k <= greatest(1, floor(n * 0.8)) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM s")
def _(spark, d):
    rows = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("stratum"), ((F.col("s_suppkey") * 7919) % 10007).alias("draw"))
    return R.split(rows, 0.8, 0.1)


@query("ds_preprocess", "supply", "SELECT split_part(id, '.', 1) AS repo, count(DISTINCT id) AS nodes FROM nodes GROUP BY 1 HAVING count(DISTINCT id) BETWEEN 50 AND 50000 AND split_part(any_value(id), '.', 1) <> 'ASIA'")
def _(nodes, edges):
    own = nodes.select(S.package_of(F.col("id")).alias("repo"), "id").distinct()
    return R.to_process(own, own.where("repo = 'ASIA'").select("repo").distinct(), 50, 50_000)


@query("ds_validate", "supply", more("n AS (SELECT split_part(id, '.', 1) AS repo, count(DISTINCT id) AS nodes FROM nodes GROUP BY 1), e AS (SELECT split_part(source, '.', 1) AS repo, count(*) AS edges, count(DISTINCT kind) AS kinds FROM edges GROUP BY 1)", "SELECT repo, nodes >= 50 AS enough, coalesce(edges, 0) >= nodes / 2 AS connected, coalesce(kinds, 0) >= 2 AS typed FROM n LEFT JOIN e USING (repo)"))
def _(nodes, edges):
    return R.validated(nodes.select(S.package_of(F.col("id")).alias("repo"), "id").distinct(), edges.select(S.package_of(F.col("source")).alias("repo"), "kind"), least=50)


@query("registry_scan", None, f"WITH {REPOS} SELECT id, name FROM r WHERE id IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return repos(spark, d).join(views.table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct(), "id", "left_semi").select("id", "name")


@query("health_batch_report", None, f"WITH {ISSUES}, h AS (SELECT repo, 1 - avg(severity) AS score FROM i GROUP BY repo) SELECT repo % 3 AS split, count(*) AS repos, {rnd('avg(score)')} AS mean, {rnd('median(score)')} AS middle, {rnd('min(score)')} AS least, {rnd('max(score)')} AS most FROM h GROUP BY repo % 3")
def _(spark, d):
    scores = issues(spark, d).groupBy("repo").agg((1 - F.avg("severity")).alias("score")).select((F.col("repo") % 3).alias("split"), "score")
    return R.batch_report(scores)


@query("eval_gate_report", None, f"WITH {ISSUES}, m AS (SELECT avg(severity) AS a, stddev_pop(severity) AS b, avg(confidence) AS c FROM i) SELECT a > 0.3 AS mean_fine, b > 0.2 AS spread_fine, c > 0.75 AS sure, CASE WHEN a > 0.3 AND b > 0.2 AND c > 0.75 THEN 'go' ELSE 'no go' END AS verdict FROM m")
def _(spark, d):
    row = issues(spark, d).agg(F.avg("severity").alias("a"), F.stddev_pop("severity").alias("b"), F.avg("confidence").alias("c"))
    return R.gate(row, {"mean_fine": F.col("a") > 0.3, "spread_fine": F.col("b") > 0.2, "sure": F.col("c") > 0.75})


@query("format_issues", None, f"WITH {ISSUES} SELECT string_agg(line, chr(10) ORDER BY severity DESC, id) AS text FROM (SELECT severity, id, '[' || CASE WHEN severity >= 0.75 THEN 'high' WHEN severity >= 0.45 THEN 'medium' ELSE 'low' END || '] ' || kind || ' ' || id AS line FROM i WHERE id % 100 = 0) x")
def _(spark, d):
    return R.issue_text(issues(spark, d).where("id % 100 = 0"))


HISTORY = "h AS (SELECT CAST(ts AS DATE) AS day, event_type AS key, count(*) AS n, avg(value) AS v FROM events GROUP BY ALL)"


def history(spark, d: str) -> DataFrame:
    return views.table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))


@query("health_history", None, f"WITH {HISTORY} SELECT key, CAST(day AS VARCHAR) AS day, n, {rnd('v')} AS v FROM h")
def _(spark, d):
    return history(spark, d).select("key", F.col("day").cast("string").alias("day"), "n", S.rounded(F.col("v")).alias("v"))


@query("win_trend", None, f"WITH {HISTORY}, t AS (SELECT key, count(*) AS n, arg_min(v, day) AS first, arg_max(v, day) AS last FROM h GROUP BY key) SELECT key, CASE WHEN n < 3 THEN NULL WHEN last > first * 1.1 THEN 'increasing' WHEN last < first * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend FROM t")
def _(spark, d):
    return R.trend(history(spark, d), "key", "day", "v")


SAMPLED = f"{HISTORY}, o AS (SELECT DISTINCT key, day FROM h), g AS (SELECT key, min(day) AS day FROM o GROUP BY key UNION ALL SELECT g.key, (SELECT min(o.day) FROM o WHERE o.key = g.key AND o.day >= g.day + 7) FROM g WHERE g.day IS NOT NULL), s AS (SELECT key, day FROM g WHERE day IS NOT NULL UNION SELECT key, max(day) FROM o GROUP BY key)"


@query("win_period_sampling", None, f"WITH RECURSIVE {SAMPLED} SELECT key, CAST(day AS VARCHAR) AS day FROM s")
def _(spark, d):
    return K.period_sample(history(spark, d).select("key", "day"), "key", "day", 7).select("key", F.col("day").cast("string").alias("day"))


@query("limit_commits", None, f"WITH RECURSIVE {SAMPLED} SELECT key, CAST(day AS VARCHAR) AS day FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS k FROM s) x WHERE k <= 3")
def _(spark, d):
    kept = K.period_sample(history(spark, d).select("key", "day"), "key", "day", 7)
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("day"))).where("k <= 3").select("key", F.col("day").cast("string").alias("day"))


@query("exclude_paths", "supply", "SELECT id FROM nodes WHERE NOT list_has_any(string_split(file, '/'), ['ASIA', 'EUROPE.NATION_3'])")
def _(nodes, edges):
    return R.without_paths(nodes, ("ASIA", "EUROPE.NATION_3")).select("id")


PATHS = "f AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '/src/tests/a.py' WHEN 1 THEN '/src/test_' || p_partkey || '.py' WHEN 2 THEN '/src/a_test.py' WHEN 3 THEN '/spec/x' WHEN 4 THEN '/lib/my_test' ELSE '/src/latest.py' END AS path FROM part)"


def paths(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 6 == 0, "/src/tests/a.py").when(k % 6 == 1, F.concat(F.lit("/src/test_"), k.cast("string"), F.lit(".py"))).when(k % 6 == 2, "/src/a_test.py").when(k % 6 == 3, "/spec/x").when(k % 6 == 4, "/lib/my_test").otherwise("/src/latest.py")
    return views.table(spark, d, "part").select(k.alias("id"), path.alias("path"))


@query("filter_test_paths", None, f"WITH {PATHS} SELECT id FROM f WHERE NOT (contains(path, '/test/') OR contains(path, '/tests/') OR contains(path, '_test.') OR contains(path, 'test_') OR contains(path, '/spec/') OR ends_with(path, '_test'))")
def _(spark, d):
    return paths(spark, d).where(~R.is_test_path(F.col("path"))).select("id")


@query("fn_module_id", None, f"WITH {PATHS} SELECT id, replace(regexp_replace(regexp_replace(ltrim(path, '/'), '\\.py$', ''), '/__init__$', ''), '/', '.') AS module FROM f")
def _(spark, d):
    return paths(spark, d).select("id", R.module_of_path(F.col("path")).alias("module"))


@query("fn_best_package_root", None, f"WITH {PATHS}, r(root) AS (VALUES ('/src'), ('/src/tests'), ('/lib')) SELECT id, (SELECT arg_max(root, length(root)) FROM r WHERE starts_with(path, root || '/')) AS root FROM f")
def _(spark, d):
    return paths(spark, d).select("id", R.best_root(F.col("path"), ("/src", "/src/tests", "/lib")).alias("root"))


@query("fn_relative_import", None, "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 2 THEN NULL ELSE array_to_string(list_concat(list_slice(['a', 'b', 'c'], 1, 3 - (p_partkey % 4)), ['name']), '.') END AS name FROM part")
def _(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), R.relative(F.lit("a.b.c.m"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit("name"), most=3).alias("name"))


@query("filter_suppressed_names", "supply", "SELECT id FROM nodes WHERE lower(split_part(id, '.', -1)) NOT IN ('supplier_1', 'supplier_2', 'nation_3')")
def _(nodes, edges):
    return nodes.where(~F.lower(S.leaf_of(F.col("id"))).isin("supplier_1", "supplier_2", "nation_3")).select("id")


@query("join_import_validated", "supply", more("imp AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'imports' AND length(source || target) % 2 = 0)", "SELECT source, target, count(*) AS n FROM edges e WHERE kind = 'calls' AND EXISTS (SELECT 1 FROM imp WHERE imp.source = split_part(e.source, '.', 1) || '.' || split_part(e.source, '.', 2) AND starts_with(e.target, imp.target || '.')) GROUP BY ALL"))
def _(nodes, edges):
    imports = edges.where("kind = 'imports' AND length(concat(source, target)) % 2 = 0")
    return R.import_validated(edges.where("kind = 'calls'"), imports, lambda s: F.substring_index(s, ".", 2)).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("join_range_lines", None, "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber BETWEEN o_orderkey % 3 + 1 AND o_orderkey % 3 + 3 GROUP BY o_orderkey")
def _(spark, d):
    spans = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 3 + 1).alias("first"), (F.col("o_orderkey") % 3 + 3).alias("last"))
    lines = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    return documents.lines_within(spans, lines).groupBy(F.col("file").alias("o_orderkey")).agg(F.count("*").alias("n"))


@query("set_disjoint", "flow", more("t AS (SELECT source, list(DISTINCT target) AS a FROM edges GROUP BY source)", "SELECT x.source AS a, y.source AS b FROM t x JOIN t y ON x.source < y.source WHERE NOT list_has_any(x.a, y.a) AND y.source IN (SELECT unnest(x.a))"))
def _(nodes, edges):
    own = edges.groupBy("source").agg(F.collect_set("target").alias("to"))
    near = edges.select("source", "target").distinct().where("source < target")
    a, b = own.select(F.col("source").alias("a"), F.col("to").alias("x")), own.select(F.col("source").alias("b"), F.col("to").alias("y"))
    return near.select(F.col("source").alias("a"), F.col("target").alias("b")).join(a, "a").join(b, "b").where(~F.arrays_overlap("x", "y")).select("a", "b")


@query("set_union_find", None, "WITH RECURSIVE p AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem WHERE l_quantity = 1 AND l_linenumber = 1), b AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS id, a AS c FROM b UNION SELECT b.b, r.c FROM r JOIN b ON r.id = b.a), g AS (SELECT id, min(c) AS component FROM r GROUP BY id) SELECT component, count(*) AS members FROM g GROUP BY component HAVING count(*) >= 3")
def _(spark, d):
    pairs = views.table(spark, d, "lineitem").where("l_quantity = 1 AND l_linenumber = 1").select(F.col("l_partkey").cast("long").alias("source"), (F.col("l_suppkey") + 1000000).cast("long").alias("target"))
    return C.weak(pairs).groupBy("component").agg(F.count("*").alias("members")).where("members >= 3")


@query("fn_sorted_join", "flow", "SELECT source, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets FROM edges GROUP BY source")
def _(nodes, edges):
    return edges.groupBy("source").agg(S.sorted_join(F.collect_set("target")).alias("targets"))


@query("fn_ln_gamma", None, f"SELECT s_suppkey, {rnd('lgamma(s_suppkey + 0.5)')} AS y FROM supplier")
def _(spark, d):
    return views.table(spark, d, "supplier").select("s_suppkey", S.rounded(S.ln_gamma(F.col("s_suppkey") + 0.5)).alias("y"))


@query("fn_truncate", None, "SELECT doc_id, substring(text, 1, 30) AS text FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", S.truncated(F.col("text"), 30).alias("text"))


@query("fn_json_pointer", None, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn_health_bar", None, "SELECT s_suppkey, repeat('█', CAST(floor(least(1.0, greatest(0.0, s_acctbal / 10000)) * 20 + 0.5) AS INTEGER)) || repeat('░', 20 - CAST(floor(least(1.0, greatest(0.0, s_acctbal / 10000)) * 20 + 0.5) AS INTEGER)) AS bar FROM supplier")
def _(spark, d):
    return views.table(spark, d, "supplier").select("s_suppkey", S.health_bar(F.col("s_acctbal") / 10000).alias("bar"))


@query("fn_tokenize_id", None, "SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 1 AND w NOT IN ('small', 'ring', 'set')), ' ') AS tokens FROM part")
def _(spark, d):
    return views.table(spark, d, "part").select("p_partkey", F.array_join(S.tokens_of(F.replace("p_name", F.lit(" "), F.lit("_")), ("small", "ring", "set")), " ").alias("tokens"))


@query("fn_split_camel", None, "SELECT p_partkey, array_to_string(string_split(regexp_replace(p_type || 'Part', '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' '), '|') AS parts FROM part WHERE strpos(p_type, ' ') = 0")
def _(spark, d):
    return views.table(spark, d, "part").where("instr(p_type, ' ') = 0").select("p_partkey", F.array_join(S.split_camel(F.concat("p_type", F.lit("Part"))), "|").alias("parts"))


@query("fn_is_stopword", None, "SELECT DISTINCT w AS word, w IN ('get', 'set', 'new', 'the', 'is', 'to', 'of', 'in', 'for', 'on', 'at', 'by', 'if', 'or', 'and', 'not', 'an', 'do', 'has', 'was') AS stop FROM (SELECT unnest(['get', 'graph', 'the', 'node', 'not', 'edge', 'was']) AS w) x")
def _(spark, d):
    words = spark.sql("SELECT explode(array('get', 'graph', 'the', 'node', 'not', 'edge', 'was')) AS word")
    return words.select("word", F.col("word").isin(*S.STOPWORDS).alias("stop"))


@query("fn_cohens_d", None, f"WITH m AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier) SELECT s_suppkey, {rnd('CASE WHEN abs(s) < 1e-15 THEN CASE WHEN s_acctbal > m THEN 3.0 ELSE 0.0 END ELSE (s_acctbal - m) / s END')} AS d FROM supplier, m")
def _(spark, d):
    s = views.table(spark, d, "supplier")
    return s.join(s.agg(F.avg("s_acctbal").alias("m"), F.stddev_pop("s_acctbal").alias("sd"))).select("s_suppkey", S.rounded(S.cohens_d(F.col("s_acctbal"), F.col("m"), F.col("sd"))).alias("d"))


@query("fn_direction_significant", "supply", more("assign AS (SELECT id, split_part(id, '.', 1) || '.' || split_part(id, '.', 2) AS module FROM nodes WHERE kind IN ('class', 'function')), p AS (SELECT least(a.module, b.module) AS a, greatest(a.module, b.module) AS b, count(*) FILTER (a.module < b.module) AS f, count(*) FILTER (a.module > b.module) AS r FROM edges JOIN assign a ON source = a.id JOIN assign b ON target = b.id WHERE kind <> 'defines' AND a.module <> b.module GROUP BY 1, 2)", "SELECT a, b, f + r >= 6 AND CASE WHEN least(f, r) >= f + r THEN 1.0 ELSE (SELECT sum(exp(lgamma(f + r + 1) - lgamma(i + 1) - lgamma(f + r - i + 1) + (f + r) * ln(0.5))) FROM range(0, least(f, r) + 1) rng(i)) END < 0.05 AS significant FROM p"))
def _(nodes, edges):
    from graphloom.plans.registry import nations

    return D.direction(edges, nations(nodes)).select("a", "b", "significant")


@query("content_manifest", None, "SELECT c_nationkey AS key, sha256('1' || string_agg(sha256(c_name || c_mktsegment), '' ORDER BY c_name)) AS hash FROM customer GROUP BY c_nationkey")
def _(spark, d):
    return documents.content_manifest(views.table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("content")))


@query("cache_probe", None, "SELECT c_custkey AS key, c_custkey % 3 = 0 AND c_custkey % 5 > 0 AS hit FROM customer")
def _(spark, d):
    wanted = views.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("a").alias("hash"), F.lit("1").alias("version"))
    cache = wanted.where("key % 3 = 0").withColumn("hash", F.when(F.col("key") % 5 > 0, "a").otherwise("b"))
    hits, left = documents.cache_probe(wanted, cache)
    return hits.select("key", F.lit(True).alias("hit")).unionByName(left.select("key", F.lit(False).alias("hit")))


@query("empty_output", "flow", "SELECT 0 AS modules, true AS fallback, CAST(NULL AS DOUBLE) AS fiedler")
def _(nodes, edges):
    return R.analysis_row(edges.where("false"))


@query("spectral_decompose", "flow")
def _(nodes, edges):
    return K.decompose(edges, 4).groupBy("component", "rank").agg(F.count("*").alias("nodes"), S.rounded(F.sum(F.col("x") * F.col("x")), 6).alias("norm"), S.rounded(F.max("value"), 6).alias("value"))


@query("eigengap_k", "flow")
def _(nodes, edges):
    return K.eigengap(K.laplacian_values(edges, 8))


@query("spectral_pe_export", "flow")
def _(nodes, edges):
    return K.fingerprints(edges, 8).select("id", F.size("vector").alias("width"), F.transform("values", lambda x: S.rounded(x, 6)).alias("values"))


@query("subgraph_fiedler", "flow")
def _(nodes, edges):
    assign = nodes.select("id", F.substring_index("id", ".", 1).alias("module"))
    return K.module_fiedler(edges, assign).groupBy("module").agg(F.max("size").alias("size"), S.rounded(F.max("value"), 6).alias("value"))


@query("agg_rollup", "supply", "SELECT CASE WHEN grouping(split_part(id, '.', 1)) = 1 THEN '*' ELSE split_part(id, '.', 1) END AS package, CASE WHEN grouping(kind) = 1 THEN '*' ELSE kind END AS kind, count(*) AS n FROM nodes GROUP BY ROLLUP (split_part(id, '.', 1), kind)")
def _(nodes, edges):
    r = nodes.select(S.package_of(F.col("id")).alias("package"), "kind").rollup("package", "kind").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("package", F.lit("*")).alias("package"), F.coalesce("kind", F.lit("*")).alias("kind"), "n")
