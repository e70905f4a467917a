"""Every registered query of the graph operators, by name, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import components as C
from graphloom.operators import diagnostics as D
from graphloom.operators import graphs as G
from graphloom.operators import kernels as K
from graphloom.operators import semantic as V
from graphloom.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, graph: str | None = None, sql: str | None = None) -> Callable:
    """Register a query over a graph's nodes and edges, or over the tables; sql sees the same nodes and edges."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = (lambda spark, d: f(*views.graph(spark, d, graph))) if graph else f
        if sql:
            ORACLES[name] = views.oracle(graph, sql) if graph else sql
        return f

    return put


def rnd(x: str, digits: int = 4) -> str:
    return f"sign({x}) * floor(abs({x}) * 1{'0' * digits}.0 + 0.5) / 1{'0' * digits}.0"


def nations(nodes: DataFrame) -> DataFrame:
    """The partition by the first two segments, of nodes that have three."""
    return nodes.where("kind IN ('class', 'function')").select("id", F.substring_index("id", ".", 2).alias("module"))


ASSIGN = "assign AS (SELECT id, split_part(id, '.', 1) || '.' || split_part(id, '.', 2) AS module FROM nodes WHERE kind IN ('class', 'function'))"
CLEAN = "SELECT e.* FROM edges e WHERE source <> target AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)"
DEGREES = f"""clean AS ({CLEAN}), deg AS (SELECT id, (SELECT count(*) FROM clean c WHERE c.target = n.id AND kind <> 'defines') AS in_degree, (SELECT count(*) FROM clean c WHERE c.source = n.id AND kind <> 'defines') AS out_degree,
 (SELECT count(*) FROM clean c WHERE c.source = n.id OR c.target = n.id) AS full_degree FROM (SELECT DISTINCT id FROM nodes) n)"""


def more(ctes: str, select: str) -> str:
    """More common tables after nodes and edges."""
    return f", {ctes} {select}"


@query("agg_module_dependencies", "supply", more(ASSIGN, "SELECT a.module AS source_module, b.module AS target_module, kind, count(*) AS n FROM edges JOIN assign a ON source = a.id JOIN assign b ON target = b.id WHERE kind <> 'defines' AND a.module <> b.module GROUP BY ALL"))
def _(nodes, edges):
    return G.module_dependencies(edges, nations(nodes))


@query("filter_edge_kinds", "supply", "SELECT kind, count(*) AS n FROM edges WHERE kind IN ('calls', 'imports') GROUP BY kind")
def _(nodes, edges):
    return G.of_kinds(edges, ("calls", "imports")).groupBy("kind").agg(F.count("*").alias("n"))


@query("filter_dangling_edges", "supply", f"SELECT kind, count(*) AS n FROM ({CLEAN}) c GROUP BY kind")
def _(nodes, edges):
    return G.without_dangling(nodes, edges).groupBy("kind").agg(F.count("*").alias("n"))


@query("filter_node_scope", "supply", "SELECT id, kind, file FROM nodes WHERE starts_with(file, 'ASIA') OR starts_with(file, 'EUROPE/')")
def _(nodes, edges):
    return G.in_scope(nodes, ("ASIA", "EUROPE/"))


@query("owning_module", "supply", "SELECT DISTINCT n.id, coalesce((SELECT arg_max(m.id, length(m.id)) FROM nodes m WHERE m.kind = 'module' AND starts_with(n.id, m.id || '.')), split_part(n.id, '.', 1)) AS module FROM nodes n")
def _(nodes, edges):
    return G.owning_modules(nodes)


@query("project_graph", "supply", more("own AS (SELECT DISTINCT n.id, coalesce((SELECT arg_max(m.id, length(m.id)) FROM nodes m WHERE m.kind = 'module' AND starts_with(n.id, m.id || '.')), split_part(n.id, '.', 1)) AS module FROM nodes n)", "SELECT a.module AS source, b.module AS target, kind, count(*) AS n FROM edges JOIN own a ON source = a.id JOIN own b ON target = b.id WHERE a.module <> b.module GROUP BY ALL"))
def _(nodes, edges):
    return G.project(nodes, edges, "module")[1].groupBy("source", "target", "kind").agg(F.count("*").alias("n"))


@query("lift_node_id", "supply", "SELECT split_part(id, '.', 1) AS id, count(DISTINCT id) AS members FROM nodes GROUP BY split_part(nodes.id, '.', 1)")
def _(nodes, edges):
    return G.project(nodes, edges, "package")[0]


@query("agg_self_edge_ratio", "supply", "SELECT count(*) AS scoped, CAST(sum(CASE WHEN split_part(source, '.', 1) = split_part(target, '.', 1) THEN 1 ELSE 0 END) AS BIGINT) AS self_edges FROM edges")
def _(nodes, edges):
    return G.self_edge_ratio(nodes, edges, "package")


@query("detect_packages", "supply", "SELECT id FROM nodes WHERE kind = 'module' AND strpos(id, '.') = 0")
def _(nodes, edges):
    return nodes.where("kind = 'module' AND instr(id, '.') = 0").select("id")


@query("node_type_index", "supply", "SELECT id, CASE lower(kind) WHEN 'function' THEN 0 WHEN 'module' THEN 1 WHEN 'class' THEN 2 WHEN 'interface' THEN 3 ELSE 4 END AS node_type FROM nodes")
def _(nodes, edges):
    return nodes.select("id", S.node_type_index(F.col("kind")).alias("node_type"))


@query("agg_counts_by_kind", "supply", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(nodes, edges):
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


@query("agg_degrees", "supp", more(DEGREES, "SELECT id, in_degree, out_degree FROM deg"))
def _(nodes, edges):
    return G.degrees(nodes, edges)


@query("agg_full_degrees", "supp", more(DEGREES, "SELECT id, full_degree FROM deg"))
def _(nodes, edges):
    return G.degrees(nodes, edges, None).select("id", (F.col("in_degree") + F.col("out_degree")).alias("full_degree"))


@query("layer_weight", "supply", f"SELECT least(source, target) AS a, greatest(source, target) AS b, {rnd('sum(CASE kind WHEN $$calls$$ THEN 1.0 WHEN $$imports$$ THEN 0.5 ELSE 0.8 END)')} AS weight FROM edges WHERE source <> target AND kind <> 'defines' GROUP BY 1, 2")
def _(nodes, edges):
    return G.symmetric_weights(edges).withColumn("weight", S.rounded(F.col("weight")))


@query("agg_modularity_q", "supply", more(ASSIGN + ", e AS (SELECT a.module AS sm, b.module AS tm FROM edges LEFT JOIN assign a ON source = a.id LEFT JOIN assign b ON target = b.id WHERE kind <> 'defines' AND source <> target), t AS (SELECT count(*) AS m FROM e), c AS (SELECT c, count(*) AS d, sum(i) AS i FROM (SELECT sm AS c, CASE WHEN sm = tm THEN 1 ELSE 0 END AS i FROM e UNION ALL SELECT tm, 0 FROM e) x WHERE c IS NOT NULL GROUP BY c)", f"SELECT {rnd('sum(i / m - power(d / (2.0 * m), 2))')} AS q FROM c, t"))
def _(nodes, edges):
    return G.modularity(edges, nations(nodes)).select(S.rounded(F.col("q")).alias("q"))


WIDTH = "w AS (SELECT a.module AS s, b.module AS t, source, target FROM edges JOIN assign a ON source = a.id JOIN assign b ON target = b.id WHERE kind <> 'defines' AND a.module <> b.module), tg AS (SELECT s, t, target, count(*) AS n, count(DISTINCT source) AS w FROM w GROUP BY ALL), iw AS (SELECT s AS source_module, t AS target_module, CAST(sum(w) AS BIGINT) AS width, CAST(sum(n) AS BIGINT) AS n_edges, CAST(max(n) AS BIGINT) AS max_target FROM tg GROUP BY ALL)"


@query("agg_distinct_pairs", "supply", more(f"{ASSIGN}, {WIDTH}", "SELECT * FROM iw"))
def _(nodes, edges):
    return G.interface_width(edges, nations(nodes))


FENCE = "f AS (SELECT CAST(floor(q[2] + 1.5 * (q[2] - q[1])) AS BIGINT) AS fence, n FROM (SELECT quantile_cont(CAST(width AS DOUBLE), [0.25, 0.75]) AS q, count(*) AS n FROM iw) x)"
SEV = "least(1.0, (0.5 * least(1.0, greatest(0.0, (a.width - fence) / greatest(fence, 1))) + 0.3 * (1 - least(a.width, coalesce(b.width, 0)) / greatest(a.width, coalesce(b.width, 0))) + 0.2 * least(1.0, a.max_target / a.width)) * CASE WHEN coalesce(b.width, 0) > fence THEN 1.3 ELSE 1.0 END * CASE WHEN split_part(a.source_module, '.', 1) = split_part(a.target_module, '.', 1) THEN 0.7 ELSE 1.0 END)"


WIDER = "(a.width > coalesce(b.width, 0) OR (a.width = b.width AND a.source_module < a.target_module))"


@query("issue_wide_interface", "supply", more(f"{ASSIGN}, {WIDTH}, {FENCE}", f"SELECT a.source_module, a.target_module, a.width, coalesce(b.width, 0) AS reverse, {rnd(SEV)} AS severity FROM iw a LEFT JOIN iw b ON a.source_module = b.target_module AND a.target_module = b.source_module, f WHERE n >= 6 AND a.width > fence AND {WIDER}"))
def _(nodes, edges):
    return D.wide_interfaces(edges, nations(nodes)).select("source_module", "target_module", "width", "reverse", S.rounded(F.col("severity")).alias("severity"))


@query("agg_caller_diversity", "supply", more(ASSIGN, "SELECT target AS id, count(DISTINCT a.module) AS callers FROM edges JOIN assign a ON source = a.id WHERE kind = 'calls' GROUP BY target"))
def _(nodes, edges):
    callers = edges.where("kind = 'calls'").join(nations(nodes).withColumnRenamed("id", "source"), "source").select("target", "module").distinct()
    return callers.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers"))


@query("join_reverse_pair", "supply", more(ASSIGN, "SELECT least(a.module, b.module) AS a, greatest(a.module, b.module) AS b, CAST(sum(CASE WHEN a.module < b.module THEN 1 ELSE 0 END) AS BIGINT) AS forward, CAST(sum(CASE WHEN a.module > b.module THEN 1 ELSE 0 END) AS BIGINT) AS backward FROM edges JOIN assign a ON source = a.id JOIN assign b ON target = b.id WHERE kind <> 'defines' AND a.module <> b.module GROUP BY 1, 2"))
def _(nodes, edges):
    return D.direction(edges, nations(nodes)).drop("significant")


@query("agg_package_composition", "supply", "SELECT split_part(id, '.', 2) AS module, split_part(id, '.', 1) AS package, count(*) AS n FROM nodes WHERE kind = 'class' GROUP BY ALL")
def _(nodes, edges):
    return nodes.where("kind = 'class'").groupBy(F.split_part("id", F.lit("."), F.lit(2)).alias("module"), S.package_of(F.col("id")).alias("package")).agg(F.count("*").alias("n"))


NMI_SQL = "t AS (SELECT a, b, count(*) AS n FROM (SELECT split_part(id, '.', 1) AS a, length(id) % 3 AS b FROM nodes) x GROUP BY ALL), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM t), s AS (SELECT sum(p * ln(p / (pa * pb))) AS mi, -sum(p * ln(pa)) AS ha, -sum(p * ln(pb)) AS hb FROM p)"


@query("agg_nmi", "supply", more(NMI_SQL, f"SELECT {rnd('least(1.0, greatest(0.0, 2 * mi / (ha + hb)))')} AS nmi FROM s"))
def _(nodes, edges):
    left = nodes.select("id", S.package_of(F.col("id")).alias("label"))
    return G.nmi(left, nodes.select("id", (F.length("id") % 3).alias("label"))).select(S.rounded(F.col("nmi")).alias("nmi"))


TREE = "p AS (SELECT target AS id, max(source) AS parent FROM edges WHERE kind = 'defines' AND source <> target GROUP BY target), up AS (SELECT id, parent AS anc, 1 AS d FROM p UNION ALL SELECT up.id, p.parent, d + 1 FROM up JOIN p ON up.anc = p.id), dep AS (SELECT id, max(d) AS depth FROM up GROUP BY id), sub AS (SELECT anc AS id, count(*) AS subtree FROM up GROUP BY anc), sib AS (SELECT id, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM p)"


@query("tree_features", "supply", more(TREE, "SELECT n.id, CAST(coalesce(depth, 0) AS BIGINT) AS depth, CAST(coalesce(i, 0) AS BIGINT) AS sibling_index, coalesce(subtree, 0) AS subtree, coalesce(sib.n, 0) AS siblings FROM (SELECT DISTINCT id FROM nodes) n LEFT JOIN dep USING (id) LEFT JOIN sub USING (id) LEFT JOIN sib USING (id)"))
def _(nodes, edges):
    return G.tree_features(nodes, edges)


REACH = "st AS (SELECT DISTINCT source, target FROM edges WHERE source <> target), r AS (SELECT source, target, 1 AS d FROM st UNION SELECT r.source, st.target, d + 1 FROM r JOIN st ON r.target = st.source WHERE d < {k} AND r.source <> st.target)"


@query("bfs_distance", "flow", more(REACH.format(k=4), "SELECT source, target, min(d) AS d FROM r GROUP BY source, target"))
def _(nodes, edges):
    return G.reach(edges, 4)


STRONG = "st AS (SELECT DISTINCT source, target FROM edges WHERE source <> target AND kind <> 'defines'), r AS (SELECT source, target FROM st UNION SELECT r.source, st.target FROM r JOIN st ON r.target = st.source), scc AS (SELECT a.source AS id, min(a.target) AS component FROM r a JOIN r b ON a.source = b.target AND a.target = b.source GROUP BY a.source HAVING count(DISTINCT a.target) > 1)"


@query("scc_tarjan", "flow", more(STRONG, "SELECT * FROM scc"))
def _(nodes, edges):
    return C.strong(edges.where("kind <> 'defines'"))


@query("rwpe", "supp", more(f"b AS (SELECT source, target, count(*) AS w FROM (SELECT source, target FROM edges WHERE source <> target UNION ALL SELECT target, source FROM edges WHERE source <> target) x GROUP BY ALL), p AS (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS p FROM b), w1 AS (SELECT * FROM p), {', '.join(f'w{t} AS MATERIALIZED (SELECT a.source, c.target, sum(a.p * c.p) AS p FROM w{t - 1} a JOIN w1 c ON a.target = c.source GROUP BY ALL)' for t in range(2, 9))}", " UNION ALL ".join(f"SELECT DISTINCT source AS id, {t} AS steps, {rnd(f'round(coalesce((SELECT sum(a.p * c.p) FROM w{t // 2} a JOIN w{t - t // 2} c ON a.source = c.target AND a.target = c.source WHERE a.source = b.source), 0), 9)') if t > 1 else '0.0'} AS p FROM b" for t in range(1, 17))))
def _(nodes, edges):
    # first to 9 digits, so that sums of other order do not fall on both sides of a half
    return G.return_probabilities(edges, 16).select("id", "steps", S.rounded(F.round("p", 9)).alias("p"))


@query("win_percentile_ranks", "supp", more(DEGREES, f"SELECT id, {rnd('percent_rank() OVER (ORDER BY in_degree)')} AS rank FROM deg"))
def _(nodes, edges):
    return G.percentile_ranks(G.degrees(nodes, edges), "in_degree").select("id", S.rounded(F.col("rank")).alias("rank"))


ROLE_SQL = """d AS (SELECT *, in_degree + out_degree AS degree, CASE WHEN in_degree + out_degree > 0 THEN (out_degree - in_degree) / (in_degree + out_degree) ELSE 0.0 END AS lean FROM deg),
 h AS (SELECT q[2] + 1.5 * (q[2] - q[1]) AS hub FROM (SELECT quantile_cont(CAST(degree AS DOUBLE), [0.25, 0.75]) AS q FROM d) x),
 l AS (SELECT greatest(0.5, least(0.9, q[2] + 1.5 * (q[2] - q[1]))) AS lf FROM (SELECT quantile_cont(abs(lean), [0.25, 0.75]) AS q FROM d WHERE degree > 0) x),
 m AS (SELECT floor(greatest(avg(degree) - stddev_pop(degree), 2.0)) AS least_d FROM d), z AS (SELECT *, percent_rank() OVER (ORDER BY degree) AS pr FROM d)"""


@query("classify_roles", "supp", more(f"{DEGREES}, {ROLE_SQL}", "SELECT id, CASE WHEN full_degree = 0 THEN 'orphan' WHEN degree = 0 THEN 'regular' WHEN degree >= least_d AND lean <= -lf THEN 'utility' WHEN degree >= least_d AND lean >= lf THEN 'entry_point' WHEN pr >= 0.9 AND degree >= hub AND abs(lean) < lf THEN 'hub' ELSE 'regular' END AS role FROM z, h, l, m"))
def _(nodes, edges):
    return D.roles(nodes, edges)


@query("win_tukey_fences", None, f"SELECT {rnd('q[1]')} AS q1, {rnd('q[2]')} AS median, {rnd('q[3]')} AS q3, {rnd('q[3] + 1.5 * (q[3] - q[1])')} AS upper_fence, {rnd('q[1] - 1.5 * (q[3] - q[1])')} AS lower_fence FROM (SELECT quantile_cont(s_acctbal, [0.25, 0.5, 0.75]) AS q FROM supplier) x")
def _(spark, d):
    q = D.quartiles(views.table(spark, d, "supplier"), "s_acctbal")
    return q.select(*[S.rounded(F.col(c)).alias(c) for c in q.columns])


@query("win_mean_median_std", None, f"SELECT s_nationkey, {rnd('avg(s_acctbal)')} AS mean, {rnd('median(s_acctbal)')} AS median, {rnd('stddev_pop(s_acctbal)')} AS sd FROM supplier GROUP BY s_nationkey")
def _(spark, d):
    return views.table(spark, d, "supplier").groupBy("s_nationkey").agg(S.rounded(F.avg("s_acctbal")).alias("mean"), S.rounded(F.median("s_acctbal")).alias("median"), S.rounded(F.stddev_pop("s_acctbal")).alias("sd"))


@query("win_org_cap", None, "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) x WHERE k <= 8")
def _(spark, d):
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return views.table(spark, d, "customer").withColumn("k", k).where("k <= 8").select("c_custkey", "c_nationkey")


@query("fn_date_distance", None, "SELECT o_orderkey, CAST(abs((year(o_orderdate) * 365 + month(o_orderdate) * 30 + day(o_orderdate)) - (1995 * 365 + 6 * 30 + 17)) AS INTEGER) AS days FROM orders")
def _(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", S.date_distance(F.col("o_orderdate"), F.lit("1995-06-17").cast("date")).alias("days"))


@query("fn_labels", None, "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 50 >= 0.75 THEN 'high' WHEN l_quantity / 50 >= 0.45 THEN 'medium' ELSE 'low' END AS label FROM lineitem")
def _(spark, d):
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.severity_label(F.col("l_quantity") / 50).alias("label"))


VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query("fn_cosine", None, f"WITH {VECTORS} SELECT a.vec_id AS a, b.vec_id AS b, {rnd('list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))')} AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    v = views.table(spark, d, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return v.select(F.col("vec_id").alias("a"), "embedding").join(b, "a").select("a", "b", S.rounded(S.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("agg_module_centroids", None, f"SELECT module, pos, {rnd('avg(x)')} AS mean FROM (SELECT label AS module, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) t GROUP BY module, pos")
def _(spark, d):
    v = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("module"), F.col("embedding").alias("vector"))
    return V.centroids(v).select("module", F.col("pos").cast("long").alias("pos"), S.rounded(F.col("mean")).alias("mean"))


@query("module_coherence", None, f"WITH {VECTORS} SELECT a.label AS module, CAST(any_value(n) AS BIGINT) AS n, {rnd('avg(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))')} AS coherence FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id JOIN (SELECT label, count(*) AS n FROM v GROUP BY label) c ON a.label = c.label GROUP BY a.label HAVING any_value(n) >= 6")
def _(spark, d):
    v = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("module"), F.col("embedding").alias("vector"))
    return V.coherence(v).select("module", "n", S.rounded(F.col("coherence")).alias("coherence"))


TERMS = "t AS (SELECT lang AS module, w AS term, count(*) AS c FROM (SELECT lang, unnest(string_split(lower(text), ' ')) AS w FROM documents) x WHERE length(w) > 1 GROUP BY ALL), s AS (SELECT module, term, c / sum(c) OVER (PARTITION BY module) * ln((SELECT count(DISTINCT module) FROM t) / count(*) OVER (PARTITION BY term)) AS v, ln((SELECT count(DISTINCT module) FROM t) / count(*) OVER (PARTITION BY term)) AS idf FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY v DESC, term) AS rank FROM s WHERE idf >= 0.01)"


@query("top_terms", None, f"WITH {TERMS} SELECT module, term, CAST(rank AS INTEGER) AS rank, {rnd('v', 6)} AS tfidf FROM k WHERE rank <= 5")
def _(spark, d):
    words = views.table(spark, d, "documents").select(F.col("lang").alias("module"), F.explode(F.split(F.lower("text"), " ")).alias("term")).where("length(term) > 1")
    return V.top_terms(words, 5).withColumn("tfidf", S.rounded(F.col("tfidf"), 6))


@query("set_dedup_edges", "supply", "SELECT DISTINCT source, target, kind FROM edges")
def _(nodes, edges):
    return edges.dropDuplicates(["source", "target", "kind"])


@query("join_anti_edges", "supp", "SELECT source, target, kind FROM edges WHERE (source, target) NOT IN (SELECT target, source FROM edges)")
def _(nodes, edges):
    gone = edges.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    return edges.join(gone, ["source", "target"], "left_anti").select("source", "target", "kind")


@query("mutate_inject_cycle", "supp", more("m AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM nodes)", "SELECT source, target, kind FROM edges UNION ALL SELECT a.id, b.id, 'calls' FROM m a JOIN m b ON b.k = a.k % 3 + 1 WHERE a.k <= 3"))
def _(nodes, edges):
    ring = nodes.select("id").orderBy("id").limit(3).withColumn("k", F.row_number().over(Window.orderBy("id")))
    to = ring.select(F.col("id").alias("target"), F.when(F.col("k") == 1, 3).otherwise(F.col("k") - 1).alias("k"))
    return edges.unionByName(ring.join(to, "k").select(F.col("id").alias("source"), "target", F.lit("calls").alias("kind")))


@query("set_jaccard", "flow", more("o AS (SELECT DISTINCT source, target FROM edges), n AS (SELECT source, count(*) AS n FROM o GROUP BY source), x AS (SELECT a.source AS a, b.source AS b, count(*) AS both_n FROM o a JOIN o b ON a.target = b.target AND a.source < b.source GROUP BY ALL)", f"SELECT a, b, {rnd('both_n / (p.n + q.n - both_n)')} AS jaccard FROM x JOIN n p ON a = p.source JOIN n q ON b = q.source"))
def _(nodes, edges):
    own = edges.select("source", "target").distinct()
    n = own.groupBy("source").agg(F.count("*").alias("n"))
    pairs = own.select(F.col("source").alias("a"), "target").join(own.select(F.col("source").alias("b"), "target"), "target").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = pairs.join(n.select(F.col("source").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("source").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", S.rounded(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


CC = "b AS (SELECT DISTINCT source, target FROM (SELECT source, target FROM edges WHERE source <> target UNION ALL SELECT target, source FROM edges WHERE source <> target) x), r AS (SELECT source AS id, source AS c FROM b UNION SELECT b.target, r.c FROM r JOIN b ON r.id = b.source)"


@query("connected_components", "flow", more(CC, "SELECT id, min(c) AS component FROM r GROUP BY id"))
def _(nodes, edges):
    return K.connected(edges)


@query("laplacian_eigh", "flow", None)
def _(nodes, edges):
    return K.laplacian_values(edges).select("component", "rank", S.rounded(F.col("value"), 6).alias("value"))


@query("win_nearest_rank_pctl", "supp", more(DEGREES, "SELECT list_sort(list(in_degree))[CAST(least(floor(count(*) * 0.85), count(*) - 1) AS INTEGER) + 1] AS p85 FROM deg"))
def _(nodes, edges):
    d = G.degrees(nodes, edges)
    # by running counts of distinct values, so that no list of all values is formed
    c = d.groupBy("in_degree").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("in_degree"))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    return c.where(F.col("upto") > F.least(F.floor(F.col("total") * 0.85), F.col("total") - 1)).agg(F.min("in_degree").alias("p85"))


@query("win_edge_count_rank", "supply", more(ASSIGN, f"SELECT source_module, target_module, {rnd('percent_rank() OVER (ORDER BY n)')} AS rank FROM (SELECT a.module AS source_module, b.module AS target_module, count(*) AS n FROM edges JOIN assign a ON source = a.id JOIN assign b ON target = b.id WHERE kind <> 'defines' AND a.module <> b.module GROUP BY ALL) x"))
def _(nodes, edges):
    pairs = G.module_dependencies(edges, nations(nodes)).groupBy("source_module", "target_module").agg(F.sum("n").alias("n"))
    return G.percentile_ranks(pairs, "n").select("source_module", "target_module", S.rounded(F.col("rank")).alias("rank"))


@query("agg_max_target_count", "supply", more(f"{ASSIGN}, {WIDTH}", "SELECT source_module, target_module, max_target FROM iw"))
def _(nodes, edges):
    return G.interface_width(edges, nations(nodes)).select("source_module", "target_module", "max_target")


@query("fn_binomial_cdf", None, f"SELECT k, n, {rnd('p', 5)} AS p FROM (SELECT k, n, CASE WHEN k >= n THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))) FROM range(0, k + 1) t(i)) END AS p FROM (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS n, CAST(l_linenumber AS INTEGER) AS k FROM lineitem) x) y")
def _(spark, d):
    x = views.table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("n"), F.col("l_linenumber").cast("int").alias("k")).distinct()
    return x.select("k", "n", S.rounded(S.binomial_cdf(F.col("k"), F.col("n")), 5).alias("p"))


@query("agg_ari", "supply", more("t AS (SELECT a, b, count(*) AS n FROM (SELECT split_part(id, '.', 1) AS a, length(id) % 3 AS b FROM nodes) x GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS i, (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM t GROUP BY a) p) AS x, (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM t GROUP BY b) q) AS y, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM t) AS z)", f"SELECT {rnd('(i - x * y / z) / ((x + y) / 2 - x * y / z)')} AS ari FROM s"))
def _(nodes, edges):
    t = G.agreement(nodes.select("id", S.package_of(F.col("id")).alias("label")), nodes.select("id", (F.length("id") % 3).alias("label")))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    i, x, y = (t.agg(pairs("n").alias("i"), F.sum("n").alias("t")), t.groupBy("a").agg(F.sum("n").alias("m")).agg(pairs("m").alias("x")), t.groupBy("b").agg(F.sum("n").alias("m")).agg(pairs("m").alias("y")))
    z, both = F.col("t") * (F.col("t") - 1) / 2, F.col("x") * F.col("y")
    return i.join(x).join(y).select(S.rounded((F.col("i") - both / z) / ((F.col("x") + F.col("y")) / 2 - both / z)).alias("ari"))


@query("filter_non_test_nodes", "supply", "SELECT id FROM nodes WHERE NOT regexp_matches(lower(id), 'test|spec|mock')")
def _(nodes, edges):
    return nodes.where(~F.lower("id").rlike("test|spec|mock")).select("id")


@query("set_union_edges", "supp", "SELECT source, target, kind, count(*) AS n FROM (SELECT * FROM edges UNION ALL SELECT target, source, 'imports' FROM edges) x GROUP BY ALL")
def _(nodes, edges):
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("imports").alias("kind"))
    return edges.unionByName(back).groupBy("source", "target", "kind").agg(F.count("*").alias("n"))


@query("edges_between", "supply", "SELECT kind, count(*) AS n FROM edges WHERE kind <> 'defines' AND starts_with(source, 'ASIA.') AND starts_with(target, 'EUROPE.') GROUP BY kind")
def _(nodes, edges):
    a = nodes.where("startswith(id, 'ASIA.')").select(F.col("id").alias("source")).distinct()
    b = nodes.where("startswith(id, 'EUROPE.')").select(F.col("id").alias("target")).distinct()
    return edges.where("kind <> 'defines'").join(a, "source", "left_semi").join(b, "target", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


@query("local_variation", None, f"WITH {VECTORS}, e AS (SELECT vec_id AS a, (vec_id * 7 + 3) % (SELECT count(*) FROM v) AS b FROM v), s AS (SELECT a, b FROM e WHERE a <> b UNION ALL SELECT b, a FROM e WHERE a <> b) SELECT a AS id, {rnd('sum(1 - list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e)))) / count(*)')} AS variation FROM s JOIN v x ON a = x.vec_id JOIN v y ON b = y.vec_id GROUP BY a")
def _(spark, d):
    v = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    e = v.join(v.agg(F.count("*").alias("n"))).select(F.col("vec_id").alias("a"), ((F.col("vec_id") * 7 + 3) % F.col("n")).alias("b")).where("a <> b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    x, y = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return both.join(x, "a").join(y, "b").groupBy(F.col("a").alias("id")).agg(S.rounded(F.sum(1 - S.cosine(F.col("x"), F.col("y"))) / F.count("*")).alias("variation"))


@query("cycle_freedom", "flow", more(STRONG.replace(" AND kind <> 'defines'", ""), f"SELECT {rnd('1 - (SELECT count(*) FROM scc) / (SELECT count(DISTINCT id) FROM nodes)')} AS cycle_freedom"))
def _(nodes, edges):
    caught = C.strong(edges).agg(F.count("*").alias("c"))
    return nodes.agg(F.count_distinct("id").alias("n")).join(caught).select(S.rounded(1 - F.col("c") / F.col("n")).alias("cycle_freedom"))


@query("win_bh_fdr", None, "WITH p AS (SELECT s_suppkey, (s_suppkey * 7919 % 1000) / 1000.0 * ((s_suppkey % 10) / 10.0) AS p FROM supplier), r AS (SELECT *, count(*) OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p) SELECT s_suppkey, coalesce(p <= (SELECT max(p) FROM r WHERE CAST(p AS DOUBLE) <= CAST(k AS DOUBLE) / m * 0.05), false) AS rejected FROM r")
def _(spark, d):
    p = views.table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 7919 % 1000) / 1000.0 * ((F.col("s_suppkey") % 10) / 10.0)).alias("p"))
    return D.benjamini_hochberg(p, "p").select("s_suppkey", "rejected")


@query("fn_expected_diversity", "supply", more(ASSIGN + ", c AS (SELECT source, target, module FROM edges JOIN assign ON source = id WHERE kind = 'calls'), m AS (SELECT module, count(*) AS o FROM c GROUP BY module), t AS (SELECT sum(o) AS e, count(*) AS k FROM m), s AS (SELECT target AS id, count(*) AS d, count(DISTINCT module) AS observed FROM c GROUP BY target)", f"SELECT id, observed, {rnd('(SELECT max(k) - sum(power(1 - o / e, s.d)) FROM m, t)')} AS expected FROM s"))
def _(nodes, edges):
    return D.expected_diversity(edges, nations(nodes)).select("id", "observed", S.rounded(F.col("expected")).alias("expected"))


@query("classify_relationship", "supply", more(ASSIGN, "SELECT a.module AS source_module, b.module AS target_module, CASE WHEN bool_or(kind = 'calls') AND bool_or(kind = 'imports') THEN 'integration' WHEN bool_or(kind = 'calls') THEN 'runtime' WHEN bool_or(kind = 'imports') THEN 'structural' ELSE 'hierarchy' END AS relationship FROM edges JOIN assign a ON source = a.id JOIN assign b ON target = b.id WHERE kind <> 'defines' AND a.module <> b.module GROUP BY ALL"))
def _(nodes, edges):
    return D.relationships(edges, nations(nodes))


@query("join_suffix_unique", "supply", more("p AS (SELECT DISTINCT id, string_split(id, '.') AS a FROM nodes), e AS (SELECT id, array_to_string(a[k:], '.') AS name FROM p, range(1, 4) t(k) WHERE k <= len(a))", "SELECT name, min(id) AS id FROM e WHERE starts_with(name, 'Supplier_') GROUP BY name HAVING count(*) = 1"))
def _(nodes, edges):
    return D.suffix_matches(nodes, nodes.where("kind = 'class'").select(S.leaf_of(F.col("id")).alias("name")).distinct())


@query("topk_anomalous_nodes", "supp", more(DEGREES, "SELECT id, in_degree FROM (SELECT *, row_number() OVER (ORDER BY in_degree DESC, id) AS k, count(*) OVER () AS n FROM deg) x WHERE k <= ceil(0.2 * n)"))
def _(nodes, edges):
    d = G.degrees(nodes, edges).select("id", "in_degree")
    # degrees that begin among the first; of the last such one, the least ids
    c = d.groupBy("in_degree").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("in_degree")))).withColumn("top", F.ceil(F.sum("n").over(Window.partitionBy(F.lit(1))) * 0.2))
    own = d.join(c.where("upto - n < top"), "in_degree").withColumn("k", F.row_number().over(Window.partitionBy("in_degree").orderBy("id")))
    return own.where("upto - n + k <= top").select("id", "in_degree")


@query("filter_issue_severity", "supply", more(f"{ASSIGN}, {WIDTH}, {FENCE}", f"SELECT a.source_module, a.target_module, CASE WHEN {SEV} >= 0.75 THEN 'high' ELSE 'medium' END AS label FROM iw a LEFT JOIN iw b ON a.source_module = b.target_module AND a.target_module = b.source_module, f WHERE n >= 6 AND a.width > fence AND {WIDER} AND {SEV} >= 0.45"))
def _(nodes, edges):
    return D.wide_interfaces(edges, nations(nodes)).where("label IN ('high', 'medium')").select("source_module", "target_module", "label")


@query("mutate_overloaded_utility", "supply", more(ASSIGN + ", u AS (SELECT min(id) AS id FROM nodes WHERE kind = 'class'), c AS (SELECT module, min(id) AS id FROM assign GROUP BY module)", "SELECT source, target, kind, count(*) AS n FROM (SELECT source, target, kind FROM edges UNION ALL SELECT c.id, u.id, 'calls' FROM c, u WHERE c.id <> u.id) x GROUP BY ALL"))
def _(nodes, edges):
    utility = nodes.where("kind = 'class'").agg(F.min("id").alias("target"))
    callers = nations(nodes).groupBy("module").agg(F.min("id").alias("source")).join(utility).where("source <> target")
    return edges.unionByName(callers.select("source", "target", F.lit("calls").alias("kind"))).groupBy("source", "target", "kind").agg(F.count("*").alias("n"))


@query("mutate_near_disconnect", "supply", more(ASSIGN, "SELECT kind, count(*) AS n FROM edges LEFT JOIN assign a ON source = a.id LEFT JOIN assign b ON target = b.id WHERE NOT (kind <> 'defines' AND a.module IS NOT DISTINCT FROM b.module AND a.module IS NOT NULL AND (length(source) + length(target)) % 4 > 0) GROUP BY kind"))
def _(nodes, edges):
    a, b = (nations(nodes).select(F.col("id").alias(c), F.col("module").alias(m)) for c, m in (("source", "sm"), ("target", "tm")))
    both = edges.join(a, "source", "left").join(b, "target", "left")
    gone = (F.col("kind") != "defines") & F.coalesce(F.col("sm") == F.col("tm"), F.lit(False)) & ((F.length("source") + F.length("target")) % 4 > 0)
    return both.where(~gone).groupBy("kind").agg(F.count("*").alias("n"))


@query("sort_components", "flow", more(CC + ", k AS (SELECT id, min(c) AS component FROM r GROUP BY id)", "SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS place FROM k GROUP BY component"))
def _(nodes, edges):
    sizes = K.connected(edges).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "component")).cast("long"))


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def _load() -> None:
    """The other modules of queries register theirs when they are imported."""
    from graphloom.plans import records, structure, vectors  # noqa: F401
