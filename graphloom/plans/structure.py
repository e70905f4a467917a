"""Queries over module structure: detectors, layers, labels, mutations and reports, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import components as C
from graphloom.operators import diagnostics as D
from graphloom.operators import graphs as G
from graphloom.operators import issues as I
from graphloom.operators import kernels as K
from graphloom.operators import modules as M
from graphloom.operators import mutations as X
from graphloom.plans.registry import ASSIGN, CLEAN, STRONG, more, nations, query, rnd
from graphloom.sources import views

DEG = f"clean AS ({CLEAN}), ends AS (SELECT target AS id, 1 AS i, 0 AS o, kind FROM clean UNION ALL SELECT source, 0, 1, kind FROM clean), deg AS (SELECT n.id, CAST(coalesce(sum(i) FILTER (kind <> 'defines'), 0) AS BIGINT) AS in_degree, CAST(coalesce(sum(o) FILTER (kind <> 'defines'), 0) AS BIGINT) AS out_degree, count(kind) AS full_degree FROM (SELECT DISTINCT id FROM nodes) n LEFT JOIN ends USING (id) GROUP BY n.id)"
PAIRS = "pairs AS (SELECT a.module AS sm, b.module AS tm, count(*) AS n FROM edges JOIN assign a ON source = a.id JOIN assign b ON target = b.id WHERE kind <> 'defines' AND a.module <> b.module GROUP BY ALL)"
LAYERS = """along AS (SELECT CASE WHEN f >= r THEN a ELSE b END AS above, CASE WHEN f >= r THEN b ELSE a END AS below FROM (SELECT least(sm, tm) AS a, greatest(sm, tm) AS b, sum(CASE WHEN sm < tm THEN n ELSE 0 END) AS f, sum(CASE WHEN sm > tm THEN n ELSE 0 END) AS r FROM pairs GROUP BY 1, 2) x),
 way AS (SELECT above, below FROM along UNION SELECT way.above, along.below FROM way JOIN along ON way.below = along.above),
 stuck AS (SELECT above AS m FROM way WHERE above = below UNION SELECT w.below FROM way w WHERE w.above IN (SELECT above FROM way WHERE above = below)),
 mods AS (SELECT DISTINCT module AS m FROM assign),
 lay AS (SELECT m, 0 AS d FROM mods UNION SELECT along.below, d + 1 FROM lay JOIN along ON lay.m = along.above WHERE lay.m NOT IN (SELECT m FROM stuck)),
 level AS (SELECT m, max(d) AS layer FROM lay GROUP BY m)"""


def cdf(k: str, n: str) -> str:
    return f"(SELECT least(1.0, sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + {n} * ln(0.5)))) FROM range(0, CAST({k} AS BIGINT) + 1) rng(i))"


def unlikely(p: str) -> str:
    return f"least(1.0, greatest(0.0, -log10(greatest({p}, 1e-15)) / 3.0))"


@query("dag_layers", "supply", more(f"{ASSIGN}, {PAIRS}, {LAYERS}", "SELECT m AS module, layer FROM level"))
def _(nodes, edges):
    assign = nations(nodes)
    pairs = I.between_modules(edges, assign).where("sm <> tm").groupBy("sm", "tm").agg(F.count("*").alias("n"))
    return I.layers(pairs, assign.select("module").distinct())


VIOLATION = f"""v AS (SELECT p.sm, p.tm, p.n, coalesce(q.n, 0) AS reverse, ls.layer AS ls, lt.layer AS lt, least(p.n, coalesce(q.n, 0)) AS k, p.n + coalesce(q.n, 0) AS t, p.rank FROM (SELECT *, percent_rank() OVER (ORDER BY n) AS rank FROM pairs) p LEFT JOIN pairs q ON p.sm = q.tm AND p.tm = q.sm JOIN level ls ON ls.m = p.sm JOIN level lt ON lt.m = p.tm),
 w AS (SELECT *, {cdf('k', 't')} AS p FROM v WHERE ls > lt AND t >= 6)"""


@query("issue_layer_violation", "supply", more(f"{ASSIGN}, {PAIRS}, {LAYERS}, {VIOLATION}", f"SELECT sm AS source_module, tm AS target_module, n, reverse, ls AS source_layer, lt AS target_layer, {rnd(f'least(1.0, 0.4 * {unlikely(chr(112))} + 0.3 * (ls - lt) / (SELECT greatest(max(layer), 1) FROM level) + 0.3 * rank)', 2)} AS severity, {rnd('least(1.0, greatest(0.5, 0.5 + 0.5 * (2 * (asin(sqrt(1 - k / t)) - asin(sqrt(0.5))) / 0.8)))', 2)} AS confidence FROM w WHERE p < 0.05 AND k < t"))
def _(nodes, edges):
    found = I.layer_violations(edges, nations(nodes))
    return found.withColumn("severity", S.rounded(F.col("severity"), 2)).withColumn("confidence", S.rounded(F.col("confidence"), 2))


OVERLOADED = f"""lim AS (SELECT s[CAST(least(floor(len(s) * 0.85), len(s) - 1) AS INTEGER) + 1] AS p85, s[CAST(least(floor(len(s) * 0.99), len(s) - 1) AS INTEGER) + 1] AS p99 FROM (SELECT list_sort(list(in_degree)) AS s FROM deg) x),
 calls AS (SELECT c.source, c.target, a.module FROM clean c JOIN assign a ON c.source = a.id WHERE kind <> 'defines'), outs AS (SELECT module, count(*) AS o FROM calls GROUP BY module), tot AS (SELECT sum(o) AS e, (SELECT count(DISTINCT module) FROM assign) AS k FROM outs),
 busy AS (SELECT d.*, p85, p99, least(in_degree, out_degree) AS lo, in_degree + out_degree AS t FROM deg d, lim WHERE in_degree > p85 AND in_degree > out_degree AND in_degree + out_degree >= 6),
 test AS (SELECT *, {cdf('lo', 't')} AS p FROM busy),
 obs AS (SELECT target AS id, count(DISTINCT module) AS observed FROM calls GROUP BY target),
 exp_ AS (SELECT in_degree, (SELECT sum(1 - power(1 - o / e, g.in_degree)) FROM outs, tot) AS expected FROM (SELECT DISTINCT in_degree FROM test) g)"""


@query("issue_overloaded_utility", "supply", more(f"{ASSIGN}, {DEG}, {OVERLOADED}", f"SELECT id, in_degree, out_degree, observed, {rnd(f'least(1.0, (0.4 * CASE WHEN p99 > p85 THEN least(1.0, (in_degree - p85) / (p99 - p85)) ELSE 0.5 END + 0.3 * least(1.0, greatest(0.0, (observed - expected) / greatest(k, 1) * 2)) + 0.3 * {unlikely(chr(112))}) * CASE WHEN out_degree = 0 THEN 0.8 ELSE 1.0 END)', 2)} AS severity FROM test JOIN obs USING (id) JOIN exp_ USING (in_degree), tot WHERE p < 0.05 AND observed > expected"))
def _(nodes, edges):
    found = I.overloaded_utilities(nodes, edges, nations(nodes))
    return found.select("id", "in_degree", "out_degree", "observed", S.rounded(F.col("severity"), 2).alias("severity"))


FAR = "inside AS (SELECT DISTINCT e.source, e.target, a.component AS c, (SELECT count(*) FROM scc z WHERE z.component = a.component) AS size FROM edges e JOIN scc a ON e.source = a.id JOIN scc b ON e.target = b.id WHERE a.component = b.component AND e.source <> e.target AND kind <> 'defines'), hop AS (SELECT c, source, target, 1 AS d FROM inside UNION SELECT h.c, h.source, i.target, d + 1 FROM hop h JOIN inside i ON h.target = i.source WHERE d + 1 < i.size AND h.source <> i.target), far AS (SELECT c AS component, source AS id, max(d) AS d FROM (SELECT c, source, target, min(d) AS d FROM hop GROUP BY ALL) x GROUP BY ALL)"


@query("scc_longest_path", "flow", more(f"{STRONG}, {FAR}", "SELECT component, max(d) AS longest FROM far GROUP BY component"))
def _(nodes, edges):
    own = C.strong(edges.where("kind <> 'defines'"))
    ends = edges.where("kind <> 'defines' AND source <> target").join(own.select(F.col("id").alias("source"), "component"), "source").join(own.select(F.col("id").alias("target"), F.col("component").alias("other")), "target").where("component = other")
    return I.longest_paths(ends.select("component", "source", "target").distinct())


CIRCLE = f"sz AS (SELECT component, count(*) AS size, count(DISTINCT module) AS modules, count(DISTINCT split_part(scc.id, '.', 1)) AS packages, avg(CASE WHEN regexp_matches(lower(scc.id), 'test|spec') THEN 1 ELSE 0 END) AS tests FROM scc LEFT JOIN assign USING (id) GROUP BY component), p90 AS (SELECT s[CAST(least(floor(len(s) * 0.9), len(s) - 1) AS INTEGER) + 1] AS p FROM (SELECT list_sort(list(size)) AS s FROM sz) x)"
CIRCLE_SEV = "least(1.0, (0.4 * least(1.0, size / 20) + 0.3 * least(1.0, modules / 5) + 0.3 * least(1.0, longest / 10)) * CASE WHEN modules > 2 AND packages > 2 THEN 1.4 ELSE 1.0 END * CASE WHEN size > p THEN 1.2 ELSE 1.0 END * CASE WHEN size = 2 AND packages <= 1 THEN 0.5 ELSE 1.0 END)"
CIRCLES = f"{ASSIGN}, {STRONG}, {FAR}, {CIRCLE}, circ AS (SELECT component, size, modules, longest, {rnd(CIRCLE_SEV, 2)} AS severity, 0.9 AS confidence FROM sz JOIN (SELECT component, max(d) AS longest FROM far GROUP BY component) f USING (component), p90 WHERE tests <= 0.8)"


@query("issue_circular_dependency", "flow", more(CIRCLES, "SELECT component, size, modules, longest, severity FROM circ"))
def _(nodes, edges):
    return circles(nodes, edges).drop("confidence")


def circles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = I.circular_dependencies(edges, C.strong(edges.where("kind <> 'defines'")), nations(nodes))
    return found.withColumn("severity", S.rounded(F.col("severity"), 2))


@query("sort_anomalies", "flow", more(CIRCLES, "SELECT component, severity, CAST(row_number() OVER (ORDER BY severity DESC, confidence DESC, component) AS INTEGER) AS place FROM circ"))
def _(nodes, edges):
    found = circles(nodes, edges)
    return M.placed(found, F.desc("severity"), F.desc("confidence"), "component").select("component", "severity", "place")


THIRDS = "assign AS (SELECT id, 'm' || (length(id) % 3) AS module FROM nodes)"


def thirds(nodes: DataFrame) -> DataFrame:
    """A partition across packages."""
    return nodes.select("id", F.concat(F.lit("m"), (F.length("id") % 3).cast("string")).alias("module"))


COUPLING_SQL = """parts AS (SELECT module, split_part(id, '.', 1) AS package, count(*) AS n FROM assign GROUP BY ALL), sp AS (SELECT module, count(*) AS packages, sum(n) AS total, max(n) AS most FROM parts GROUP BY module HAVING count(*) >= 2),
 ins AS (SELECT a.module, split_part(source, '.', 1) AS x, split_part(target, '.', 1) AS y FROM edges JOIN assign a ON source = a.id JOIN assign b ON target = b.id WHERE kind <> 'defines' AND source <> target AND a.module = b.module),
 dens AS (SELECT module, avg(CASE WHEN x <> y THEN 1.0 ELSE 0.0 END) AS density FROM ins GROUP BY module),
 ways AS (SELECT module, least(x, y) AS p, greatest(x, y) AS q, sum(CASE WHEN x < y THEN 1 ELSE 0 END) AS f, sum(CASE WHEN x > y THEN 1 ELSE 0 END) AS r FROM ins WHERE x <> y GROUP BY ALL), bi AS (SELECT module, sum(least(f, r)) / sum(greatest(f, r)) AS bid FROM ways GROUP BY module)"""
COUPLING_SEV = "least(1.0, (0.3 * least(1.0, (packages - 1) / 4) + 0.3 * (1 - most / total) + 0.2 * coalesce(density, 1 - most / total)) * (0.4 + 0.6 * coalesce(bid, 0)))"


@query("issue_cross_package_coupling", "supp", more(f"{THIRDS}, {COUPLING_SQL}", f"SELECT module, packages, CAST(total AS BIGINT) AS total, 'structural_only' AS root_cause, {rnd(COUPLING_SEV, 2)} AS severity, 0.5 AS confidence FROM sp LEFT JOIN dens USING (module) LEFT JOIN bi USING (module) WHERE {COUPLING_SEV} >= 0.35"))
def _(nodes, edges):
    found = I.cross_package_coupling(nodes, edges, thirds(nodes))
    return found.withColumn("severity", S.rounded(F.col("severity"), 2))


@query("issue_near_disconnect", "flow")
def _(nodes, edges):
    assign = nations(nodes).unionByName(nodes.where("kind = 'class'").select("id", F.substring_index("id", ".", 1).alias("module")))
    found = I.near_disconnects(K.module_fiedler(edges, assign), edges, K.random_fiedler(nodes, edges, assign))
    return found.withColumn("severity", S.rounded(F.col("severity"), 2))


BETWEEN = """st AS (SELECT source, target, count(*) AS w FROM edges WHERE source <> target AND kind <> 'defines' GROUP BY ALL), hops AS (SELECT source AS s, target AS t, 1 AS d FROM st UNION SELECT h.s, e.target, d + 1 FROM hops h JOIN st e ON h.t = e.source WHERE h.s <> e.target AND d < (SELECT count(*) FROM nodes)),
 dist AS (SELECT s, t, min(d) AS d FROM hops GROUP BY ALL), ways AS (SELECT source AS s, target AS t, 1 AS d, CAST(w AS DOUBLE) AS w FROM st UNION ALL SELECT p.s, e.target, p.d + 1, p.w * e.w FROM ways p JOIN st e ON p.t = e.source JOIN dist x ON x.s = p.s AND x.t = e.target AND x.d = p.d + 1),
 sig AS (SELECT s, t, any_value(d) AS d, sum(w) AS n FROM ways GROUP BY s, t), raw AS (SELECT a.t AS id, sum(a.n * b.n / c.n) AS b FROM sig a JOIN sig b ON a.t = b.s AND a.s <> b.t JOIN sig c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d GROUP BY a.t),
 btw AS (SELECT n.id, coalesce(b, 0) / greatest(1, (SELECT (count(DISTINCT id) - 1) * (count(DISTINCT id) - 2) FROM nodes)) AS betweenness FROM (SELECT DISTINCT id FROM nodes) n LEFT JOIN raw USING (id))"""


@query("betweenness_brandes", "flow", more(BETWEEN, f"SELECT id, {rnd('betweenness', 8)} AS betweenness FROM btw"))
def _(nodes, edges):
    return K.betweenness(nodes, edges).select("id", S.rounded(F.col("betweenness"), 8).alias("betweenness"))


ROLES = f"""d AS (SELECT *, in_degree + out_degree AS degree, CASE WHEN in_degree + out_degree > 0 THEN (out_degree - in_degree) / (in_degree + out_degree) ELSE 0.0 END AS lean FROM deg),
 h AS (SELECT q[2] + 1.5 * (q[2] - q[1]) AS hub FROM (SELECT quantile_cont(CAST(degree AS DOUBLE), [0.25, 0.75]) AS q FROM d) x),
 l AS (SELECT greatest(0.5, least(0.9, q[2] + 1.5 * (q[2] - q[1]))) AS lf FROM (SELECT quantile_cont(abs(lean), [0.25, 0.75]) AS q FROM d WHERE degree > 0) x),
 m AS (SELECT floor(greatest(avg(degree) - stddev_pop(degree), 2.0)) AS least_d FROM d), z AS (SELECT d.*, betweenness, percent_rank() OVER (ORDER BY degree) AS pr, percent_rank() OVER (ORDER BY round(betweenness, 12)) AS bp FROM d JOIN btw USING (id)),
 role AS (SELECT id, in_degree, out_degree, degree, betweenness, CASE WHEN full_degree = 0 THEN 'orphan' WHEN degree = 0 THEN 'regular' WHEN betweenness > 0 AND bp >= 0.9 AND pr < 0.9 THEN 'bridge' WHEN degree >= least_d AND lean <= -lf THEN 'utility' WHEN degree >= least_d AND lean >= lf THEN 'entry_point' WHEN pr >= 0.9 AND degree >= hub AND abs(lean) < lf THEN 'hub' ELSE 'regular' END AS role FROM z, h, l, m)"""


def own_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Roles with bridges; equal betweenness is equal whatever the order of its sums."""
    return D.roles(nodes, edges, K.betweenness(nodes, edges).withColumn("betweenness", F.round("betweenness", 12)))


@query("classify_node", "flow", more(f"{DEG}, {BETWEEN}, {ROLES}", "SELECT id, role FROM role"))
def _(nodes, edges):
    return own_roles(nodes, edges)


@query("topk_bridges", "flow", more(BETWEEN + ", x AS (SELECT DISTINCT id FROM (SELECT source AS id FROM edges WHERE split_part(source, '.', 1) <> split_part(target, '.', 1) UNION ALL SELECT target FROM edges WHERE split_part(source, '.', 1) <> split_part(target, '.', 1)) y)", "SELECT id, k AS place FROM (SELECT id, CAST(row_number() OVER (ORDER BY round(betweenness, 12) DESC, id) AS INTEGER) AS k FROM btw WHERE id IN (SELECT id FROM x)) z WHERE k <= 3"))
def _(nodes, edges):
    crossing = edges.where(S.package_of(F.col("source")) != S.package_of(F.col("target")))
    ends = crossing.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    found = K.betweenness(nodes, edges).withColumn("betweenness", F.round("betweenness", 12)).join(ends, "id", "left_semi")
    first = found.orderBy(F.desc("betweenness"), "id").limit(3)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("betweenness"), "id"))).select("id", "place")


@query("classify_roles_web", "flow", more(f"i AS (SELECT id, (SELECT count(*) FROM edges WHERE target = n.id) AS i, (SELECT count(*) FROM edges WHERE source = n.id) AS o FROM (SELECT DISTINCT id FROM nodes) n), {BETWEEN}, w AS (SELECT id, i + o AS d, CASE WHEN i + o > 0 THEN (o - i) / (i + o) END AS lean, percent_rank() OVER (ORDER BY i + o) AS dp, percent_rank() OVER (ORDER BY round(betweenness, 12)) AS bp, (SELECT median(i + o) FROM i) AS mid FROM i JOIN btw USING (id))", "SELECT id, CASE WHEN d = 0 THEN 'orphan' WHEN bp >= 0.9 AND dp < 0.9 THEN 'bridge' WHEN d >= 3 AND lean <= -0.6 THEN 'utility' WHEN d >= 3 AND lean >= 0.6 THEN 'entry_point' WHEN dp >= 0.9 AND d >= mid + 2 AND abs(lean) < 0.6 THEN 'hub' ELSE 'regular' END AS role FROM w"))
def _(nodes, edges):
    return D.web_roles(nodes, edges, K.betweenness(nodes, edges).withColumn("betweenness", F.round("betweenness", 12)))


@query("agg_web_summary", "flow", more(f"{ASSIGN}, {DEG}, {BETWEEN}, {ROLES}", "SELECT coalesce(module, '') AS module, count(*) AS size, count(*) FILTER (role = 'bridge') AS bridges, count(*) FILTER (role = 'hub') AS hubs, count(*) FILTER (role = 'orphan') AS orphans, coalesce(max(degree), 0) AS top_degree FROM role LEFT JOIN assign USING (id) GROUP BY 1"))
def _(nodes, edges):
    d = G.degrees(nodes, edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    all_ = own_roles(nodes, edges).join(d, "id").join(nations(nodes), "id", "left")
    count = lambda r: F.sum((F.col("role") == r).cast("long"))
    return all_.groupBy(F.coalesce("module", F.lit("")).alias("module")).agg(F.count("*").alias("size"), count("bridge").alias("bridges"), count("hub").alias("hubs"), count("orphan").alias("orphans"), F.max("degree").alias("top_degree"))


@query("find_entry_points", "flow", more(f"{ASSIGN}, {DEG}, {BETWEEN}, {ROLES}", "SELECT module, coalesce(max(id) FILTER (role = 'entry_point'), min(id) FILTER (role = 'hub')) AS id FROM role JOIN assign USING (id) WHERE role IN ('entry_point', 'hub') GROUP BY module"))
def _(nodes, edges):
    r = own_roles(nodes, edges).where("role IN ('entry_point', 'hub')").join(nations(nodes), "id")
    return r.groupBy("module").agg(F.coalesce(F.max(F.when(F.col("role") == "entry_point", F.col("id"))), F.min(F.when(F.col("role") == "hub", F.col("id")))).alias("id"))


@query("classify_architecture", "supply", more(f"{ASSIGN}, {PAIRS}, c AS (SELECT (SELECT count(DISTINCT module) FROM assign) AS m, (SELECT count(*) FROM pairs) AS d, (SELECT count(*) FROM pairs p JOIN pairs q ON p.sm = q.tm AND p.tm = q.sm AND p.sm < p.tm) AS b)", "SELECT CASE WHEN m <= 1 THEN 'monolith' WHEN d >= 2 AND b = 0 THEN 'layered (' || m || ' tiers)' WHEN m > 6 THEN 'modular (' || m || ' modules)' ELSE m || ' modules' END AS architecture FROM c"))
def _(nodes, edges):
    assign = nations(nodes)
    return M.architecture(I.between_modules(edges, assign).where("sm <> tm").select("sm", "tm").distinct(), assign.select("module").distinct())


@query("agg_top_package_label", "supply", more("assign AS (SELECT id, CASE WHEN length(id) % 2 = 0 THEN split_part(id, '.', 1) || '.' || split_part(id, '.', 2) ELSE 'x' || (length(id) % 5) END AS module FROM nodes WHERE kind IN ('class', 'function')), c AS (SELECT module, split_part(id, '.', 1) AS p, count(*) AS n FROM assign GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY n DESC, p) AS k, count(*) OVER (PARTITION BY module) AS ps, sum(n) OVER (PARTITION BY module) AS t FROM c), lv AS (SELECT module, k, min(split_part(id, '.', CAST(k AS INTEGER))) AS lo, max(split_part(id, '.', CAST(k AS INTEGER))) AS hi, min(len(string_split(id, '.'))) AS least FROM assign, range(1, 4) t(k) GROUP BY module, k), lcp AS (SELECT module, string_agg(lo, '.' ORDER BY k) AS label FROM lv WHERE k <= least AND NOT EXISTS (SELECT 1 FROM lv o WHERE o.module = lv.module AND o.k <= lv.k AND o.lo <> o.hi) GROUP BY module)", "SELECT a.module, CASE WHEN a.ps = 1 THEN (SELECT label FROM lcp WHERE lcp.module = a.module) WHEN b.n * 4 > a.t THEN a.p || ' + ' || b.p ELSE a.p END AS label FROM r a LEFT JOIN r b ON a.module = b.module AND b.k = 2 WHERE a.k = 1"))
def _(nodes, edges):
    return M.labels(halves(nodes))


def halves(nodes: DataFrame) -> DataFrame:
    """A partition of which some parts cross packages."""
    part = F.when(F.length("id") % 2 == 0, F.substring_index("id", ".", 2)).otherwise(F.concat(F.lit("x"), (F.length("id") % 5).cast("string")))
    return nodes.where("kind IN ('class', 'function')").select("id", part.alias("module"))


@query("dedup_labels", None, "WITH m AS (SELECT n_nationkey AS id, 'group ' || n_nationkey % 4 AS label, n_name AS package FROM nation), c AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM m), l AS (SELECT id, CASE WHEN n = 1 THEN label WHEN strpos(label, package) = 0 AND id % 3 > 0 THEN label || ' (+ P' || id % 5 || ')' ELSE label || ' (group ' || id || ')' END AS label FROM c) SELECT id, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || ' (group ' || id || ')' ELSE label END AS label FROM l")
def _(spark, d):
    n = views.table(spark, d, "nation")
    rows = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("group "), (F.col("n_nationkey") % 4).cast("string")).alias("label"), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("P"), (F.col("n_nationkey") % 5).cast("string"))).alias("other"))
    return M.distinct_labels(rows)


@query("package_grouping", "supply", "SELECT id, CAST(dense_rank() OVER (ORDER BY split_part(id, '.', 1)) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT id FROM nodes) n")
def _(nodes, edges):
    return M.package_groups(nodes)


@query("package_agreement", "supply", more("t AS (SELECT a, b, count(*) AS n FROM (SELECT 'm' || (length(id) % 3) AS a, split_part(id, '.', 1) AS b FROM nodes) x GROUP BY ALL), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM t), s AS (SELECT sum(p * ln(p / (pa * pb))) AS mi, -sum(p * ln(pa)) AS ha, -sum(p * ln(pb)) AS hb FROM p)", f"SELECT a AS module, count(*) AS packages, count(*) >= 2 AS cross_package, {rnd('(SELECT least(1.0, greatest(0.0, 2 * mi / (ha + hb))) FROM s)')} AS nmi FROM t GROUP BY a"))
def _(nodes, edges):
    own = thirds(nodes)
    agree = G.nmi(own.select("id", F.col("module").alias("label")), nodes.select("id", S.package_of(F.col("id")).alias("label"))).select(S.rounded(F.col("nmi")).alias("nmi"))
    spread = own.select("module", S.package_of(F.col("id")).alias("p")).distinct().groupBy("module").agg(F.count("*").alias("packages"))
    return spread.withColumn("cross_package", F.col("packages") >= 2).join(agree)


@query("defines_parent_map", "supply", "SELECT target AS id, max(source) AS parent FROM edges WHERE kind = 'defines' AND source <> target GROUP BY target")
def _(nodes, edges):
    return G.defines_parents(edges)


@query("cluster_propagation", "supply", more("p AS (SELECT target AS id, max(source) AS parent FROM edges WHERE kind = 'defines' AND source <> target GROUP BY target), given AS (SELECT id, split_part(id, '.', 2) AS cluster FROM nodes WHERE kind = 'module' AND strpos(id, '.') > 0), up AS (SELECT id, id AS anc, 0 AS d FROM (SELECT DISTINCT id FROM nodes) n UNION ALL SELECT up.id, p.parent, d + 1 FROM up JOIN p ON up.anc = p.id)", "SELECT up.id, arg_min(cluster, d) AS cluster FROM up JOIN given ON anc = given.id GROUP BY up.id"))
def _(nodes, edges):
    given = nodes.where("kind = 'module' AND instr(id, '.') > 0").select("id", F.split_part("id", F.lit("."), F.lit(2)).alias("cluster"))
    return M.propagated(nodes, edges, given)


@query("win_first_wins", None, "SELECT c_nationkey, c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) x WHERE k = 1")
def _(spark, d):
    c = views.table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(F.min_by(F.struct("c_custkey", "c_mktsegment"), "c_custkey").alias("f")).select("c_nationkey", "f.c_custkey", "f.c_mktsegment")


@query("topk_modules_context", "supply", more(f"{ASSIGN}, s AS (SELECT module, count(*) AS size FROM assign GROUP BY module), c AS (SELECT DISTINCT module FROM assign WHERE id LIKE '%7')", "SELECT module, size FROM (SELECT *, row_number() OVER (ORDER BY size DESC, module) AS k, count(*) OVER () AS n FROM s) x WHERE n <= 15 OR k <= 10 OR module IN (SELECT module FROM c)"))
def _(nodes, edges):
    assign = nations(nodes)
    return M.context_modules(assign, assign.where("id LIKE '%7'").select("module").distinct())


WIDE = "wid AS (SELECT a.module AS sm, b.module AS tm, count(DISTINCT source || '>' || target) AS w FROM edges JOIN assign a ON source = a.id JOIN assign b ON target = b.id WHERE kind <> 'defines' AND a.module <> b.module GROUP BY ALL)"


@query("mutate_wide_interface", "flow", more(f"{ASSIGN}, mem AS (SELECT module, id, row_number() OVER (PARTITION BY module ORDER BY id) AS k FROM assign), two AS (SELECT module, count(*) AS n FROM assign GROUP BY module ORDER BY n DESC, module LIMIT 2), ab AS (SELECT module, row_number() OVER (ORDER BY n DESC, module) AS r FROM two)", "SELECT source, target, kind, count(*) AS n FROM (SELECT source, target, kind FROM edges UNION ALL SELECT x.id, y.id, 'calls' FROM mem x JOIN ab p ON x.module = p.module AND p.r = 1, mem y JOIN ab q ON y.module = q.module AND q.r = 2 WHERE x.k <= 2) z GROUP BY ALL"))
def _(nodes, edges):
    return X.wide_interface(edges, nations(nodes), sources=2).groupBy("source", "target", "kind").agg(F.count("*").alias("n"))


@query("mutate_layer_violation", "flow", more(f"{ASSIGN}, {PAIRS}, top AS (SELECT sm, tm, n FROM pairs ORDER BY n DESC, sm, tm LIMIT 1), ends AS (SELECT (SELECT min(id) FROM assign WHERE module = tm) AS s, (SELECT min(id) FROM assign WHERE module = sm) AS t, greatest(3 * n + 6, 6) AS k FROM top)", "SELECT source, target, kind, count(*) AS n FROM (SELECT source, target, kind FROM edges UNION ALL SELECT s, t, CASE WHEN i % 2 = 0 THEN 'calls' ELSE 'imports' END FROM ends, range(0, k) r(i)) z GROUP BY ALL"))
def _(nodes, edges):
    return X.layer_violation(edges, nations(nodes)).groupBy("source", "target", "kind").agg(F.count("*").alias("n"))


@query("mutation_helpers", "supply", more(f"{ASSIGN}, s AS (SELECT module, count(*) AS n FROM assign WHERE NOT regexp_matches(lower(id), 'test|spec|mock') GROUP BY module HAVING count(*) >= 5)", "SELECT module, n FROM s"))
def _(nodes, edges):
    return X.eligible_modules(nations(nodes), least=5)


@query("agg_node_kind_stats", "supply", more(f"{DEG}", f"SELECT n.kind, count(*) AS nodes, {rnd('avg(in_degree)')} AS mean_in, {rnd('avg(out_degree)')} AS mean_out, {rnd('median(in_degree)')} AS median_in, {rnd('median(out_degree)')} AS median_out FROM nodes n JOIN deg USING (id) GROUP BY n.kind"))
def _(nodes, edges):
    d = nodes.select("id", "kind").join(G.degrees(nodes, edges), "id")
    return d.groupBy("kind").agg(F.count("*").alias("nodes"), *[S.rounded(f(F.col(f"{c}_degree"))).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("median", F.median)) for c in ("in", "out")])


@query("filter_test_cycles", "flow", more(f"{STRONG}, t AS (SELECT component, count(*) AS size, count(*) FILTER (ends_with(id, '1') OR ends_with(id, '3')) AS tests FROM scc GROUP BY component)", "SELECT component, size FROM t WHERE tests * 5 <= size * 4"))
def _(nodes, edges):
    own = C.strong(edges.where("kind <> 'defines'"))
    return M.without_tests(own, F.endswith("id", F.lit("1")) | F.endswith("id", F.lit("3")))


@query("anchor_lookup", "supply", "SELECT id, kind, file, strpos(file, '/') AS line FROM nodes WHERE kind = 'module'")
def _(nodes, edges):
    found = nodes.where("kind = 'module'").select("id", F.struct("file", "kind", F.instr("file", "/").cast("long").alias("line")).alias("anchor"))
    return found.select("id", "anchor.kind", "anchor.file", "anchor.line")


@query("subgraph_extract", "flow", more("m AS (SELECT DISTINCT id FROM nodes WHERE length(id) % 2 = 0), w AS (SELECT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source IN (SELECT id FROM m) AND target IN (SELECT id FROM m) AND source <> target AND kind <> 'defines')", "SELECT a, b, CAST(count(*) AS DOUBLE) AS weight FROM w GROUP BY ALL"))
def _(nodes, edges):
    own = nodes.where("length(id) % 2 = 0").select("id").distinct()
    return G.symmetric_weights(M.induced(edges, own))


@query("health_metrics", "supply", more(f"{ASSIGN}, e AS (SELECT a.module AS sm, b.module AS tm FROM edges LEFT JOIN assign a ON source = a.id LEFT JOIN assign b ON target = b.id WHERE kind <> 'defines' AND source <> target), t AS (SELECT count(*) AS m FROM e), c AS (SELECT c, count(*) AS d, sum(i) AS i FROM (SELECT sm AS c, CASE WHEN sm = tm THEN 1 ELSE 0 END AS i FROM e UNION ALL SELECT tm, 0 FROM e) x WHERE c IS NOT NULL GROUP BY c)", f"SELECT (SELECT {rnd('sum(i / m - power(d / (2.0 * m), 2))')} FROM c, t) AS modularity_q, (SELECT {rnd('count(DISTINCT a.id) / count(DISTINCT n.id)')} FROM nodes n LEFT JOIN assign a ON n.id = a.id) AS coverage, (SELECT {rnd('avg(CASE WHEN split_part(source, $$.$$, 1) = split_part(target, $$.$$, 1) THEN 1.0 ELSE 0.0 END)')} FROM edges) AS self_edge_drop, (SELECT count(DISTINCT module) FROM assign) AS modules, (SELECT count(DISTINCT id) FROM nodes) AS nodes"))
def _(nodes, edges):
    return M.health(nodes, edges, nations(nodes))
