"""Queries over embeddings as the vectors of a graph's nodes, and the SQL each is held against.

The vectors of the tables point all ways alike, so each is moved along its label's axis: then labels are coherent
modules. The assignment puts every 17th vector into the next label's module, where it does not belong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import semantic as V
from graphloom.plans.registry import query, rnd
from graphloom.sources import views

SQL = """WITH n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id AS id, label, CASE WHEN vec_id % 17 = 0 THEN (label + 1) % 10 ELSE label END AS module, list_transform(list_zip(embedding, range(0, len(embedding))), lambda z: CAST(z[1] AS DOUBLE) + CASE WHEN z[2] = label THEN 1.5 ELSE 0.0 END) AS e FROM embeddings),
 edges AS (SELECT id AS source, (id * 7 + 3) % n AS target FROM v, n WHERE id <> (id * 7 + 3) % n UNION ALL SELECT id, (id + 10) % n FROM v, n WHERE id <> (id + 10) % n UNION ALL SELECT id, (id + 23) % n FROM v, n WHERE id <> (id + 23) % n)"""
COS = "(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))))"
PAIR = COS.format("a.e", "b.e")
CENTROIDS = "c AS (SELECT module, list(m ORDER BY pos) AS c FROM (SELECT module, pos, avg(x) AS m FROM (SELECT module, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) t GROUP BY module, pos) u GROUP BY module)"


def vectors(spark, d: str) -> DataFrame:
    """id, label, module and vector."""
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), 1.5).otherwise(0.0))
    module = F.when(F.col("vec_id") % 17 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", module.alias("module"), moved.alias("vector"))


def links(v: DataFrame) -> DataFrame:
    """source and target of three calls for each vector."""
    n = v.agg(F.count("*").alias("n"))
    to = F.explode(F.array((F.col("id") * 7 + 3) % F.col("n"), (F.col("id") + 10) % F.col("n"), (F.col("id") + 23) % F.col("n")))
    return v.select("id").join(n).select(F.col("id").alias("source"), to.alias("target")).where("source <> target")


@query("pairwise_cosine_stats", None, f"{SQL}, p AS (SELECT {PAIR} AS s FROM v a JOIN v b ON a.id < b.id) SELECT {rnd('avg(s)')} AS mean, {rnd('var_pop(s)')} AS variance FROM p")
def _(spark, d):
    return V.pair_statistics(vectors(spark, d)).select(S.rounded(F.col("mean")).alias("mean"), S.rounded(F.col("variance")).alias("variance"))


@query("within_across_similarity", None, f"{SQL}, p AS (SELECT a.module = b.module AS same, {PAIR} AS s FROM v a JOIN v b ON a.id < b.id) SELECT {rnd('avg(s) FILTER (same)')} AS within, {rnd('avg(s) FILTER (NOT same)')} AS across FROM p")
def _(spark, d):
    return V.within_across(vectors(spark, d)).select(S.rounded(F.col("within")).alias("within"), S.rounded(F.col("across")).alias("across"))


@query("signal_quality_gate", None)
def _(spark, d):
    return V.quality_gate(vectors(spark, d))


@query("null_coherence", None, f"{SQL}, g AS (SELECT g, (g * 37 + k * k * 11 + k * 101) % n AS id FROM range(0, 100) a(g), range(0, 8) b(k), n), p AS (SELECT a.g, {COS.format('x.e', 'y.e')} AS s FROM (SELECT DISTINCT g, id FROM g) a JOIN (SELECT DISTINCT g, id FROM g) b ON a.g = b.g AND a.id < b.id JOIN v x ON a.id = x.id JOIN v y ON b.id = y.id), c AS (SELECT g, avg(s) AS c FROM p GROUP BY g) SELECT {rnd('avg(c)')} AS mean, {rnd('stddev_pop(c)')} AS sd FROM c")
def _(spark, d):
    v = vectors(spark, d)
    groups = spark.range(100).select(F.col("id").alias("g")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).join(v.agg(F.count("*").alias("n"))).select("g", ((F.col("g") * 37 + F.col("k") * F.col("k") * 11 + F.col("k") * 101) % F.col("n")).alias("id")).distinct()
    return V.null_coherence(v, groups).select(S.rounded(F.col("mean")).alias("mean"), S.rounded(F.col("sd")).alias("sd"))


SYM = "s AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS w FROM edges GROUP BY ALL), deg AS (SELECT id, sum(w) AS d FROM (SELECT a AS id, w FROM s UNION ALL SELECT b, w FROM s) x GROUP BY id)"


@query("rayleigh_quotient", None, f"{SQL}, {SYM}, f AS (SELECT w * list_sum(list_transform(list_zip(x.e, y.e), lambda z: power(z[1] / sqrt(p.d) - z[2] / sqrt(q.d), 2))) AS f FROM s JOIN v x ON a = x.id JOIN v y ON b = y.id JOIN deg p ON a = p.id JOIN deg q ON b = q.id) SELECT {rnd('(SELECT sum(f) FROM f) / (SELECT sum(list_dot_product(e, e)) FROM v)')} AS rayleigh")
def _(spark, d):
    v = vectors(spark, d)
    return V.rayleigh(v, links(v)).select(S.rounded(F.col("rayleigh")).alias("rayleigh"))


@query("join_cross_centroids", None, f"{SQL}, {CENTROIDS}, x AS (SELECT v.id, c.module, {COS.format('v.e', 'c.c')} AS s FROM v JOIN c ON v.module <> c.module) SELECT id, arg_max(module, round(s, 9) - module * 1e-12) AS module, {rnd('max(s)')} AS similarity FROM x GROUP BY id")
def _(spark, d):
    v = vectors(spark, d)
    return V.nearest_other(v, V.centroid_vectors(v)).select("id", F.col("best").alias("module"), S.rounded(F.col("similarity")).alias("similarity"))


@query("agg_cohesion_separation", None, f"{SQL}, {CENTROIDS}, o AS (SELECT v.module, avg(list_distance(v.e, c.c)) AS cohesion FROM v JOIN c USING (module) GROUP BY v.module), p AS (SELECT a.module, min(list_distance(a.c, b.c)) AS separation FROM c a JOIN c b ON a.module <> b.module GROUP BY a.module) SELECT module, {rnd('cohesion')} AS cohesion, {rnd('separation')} AS separation, {rnd('least(1.0, greatest(0.0, 0.5 * 0.4 + 0.5 * separation / (separation + cohesion + 1e-9)))')} AS confidence FROM o LEFT JOIN p USING (module)")
def _(spark, d):
    v = vectors(spark, d)
    q = V.module_quality(v, V.centroid_vectors(v), silhouette=0.4)
    return q.select("module", *[S.rounded(F.col(c)).alias(c) for c in ("cohesion", "separation", "confidence")])


@query("annotate_modules", None, f"{SQL}, {CENTROIDS}, o AS (SELECT v.module, count(*) AS n, avg(list_distance(v.e, c.c)) AS cohesion FROM v JOIN c USING (module) GROUP BY v.module) SELECT CAST(dense_rank() OVER (ORDER BY module) - 1 AS INTEGER) AS id, 'label ' || module AS label, n AS members, {rnd('cohesion')} AS cohesion FROM o")
def _(spark, d):
    v = vectors(spark, d)
    return V.annotated(v, V.module_quality(v, V.centroid_vectors(v), silhouette=0.4)).select("id", "label", "members", S.rounded(F.col("cohesion")).alias("cohesion"))


@query("silhouette_centroid", None, f"{SQL}, {CENTROIDS}, x AS (SELECT v.id, max(CASE WHEN v.module = c.module THEN list_distance(v.e, c.c) END) AS a, min(CASE WHEN v.module <> c.module THEN list_distance(v.e, c.c) END) AS b FROM v, c GROUP BY v.id) SELECT {rnd('avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END)')} AS silhouette FROM x")
def _(spark, d):
    v = vectors(spark, d)
    return V.silhouette(v, V.centroid_vectors(v)).select(S.rounded(F.col("silhouette")).alias("silhouette"))


@query("is_degenerate_legacy", None, f"{SQL}, z AS (SELECT module, count(*) AS n FROM v GROUP BY module) SELECT (SELECT max(n) FROM z) > 0.8 * (SELECT sum(n) FROM z) AS dominated, count(*) AS modules FROM z")
def _(spark, d):
    sizes = vectors(spark, d).groupBy("module").agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") > 0.8 * F.sum("n")).alias("dominated"), F.count("*").alias("modules"))


RECON = f"r AS (SELECT v.id, 1 - {COS.format('v.e', 'c.c')} AS err FROM v JOIN c USING (module))"


@query("eval_recon_error", None, f"{SQL}, {CENTROIDS}, {RECON} SELECT id, {rnd('err')} AS error FROM r")
def _(spark, d):
    v = vectors(spark, d)
    return V.reconstruction_error(v, V.centroid_vectors(v)).select("id", S.rounded(F.col("error")).alias("error"))


@query("coherence", None, f"{SQL}, {CENTROIDS}, {RECON} SELECT {rnd('least(1.0, greatest(0.0, 1 - median(err)))')} AS coherence FROM r")
def _(spark, d):
    v = vectors(spark, d)
    return V.health_coherence(V.reconstruction_error(v, V.centroid_vectors(v))).select(S.rounded(F.col("coherence")).alias("coherence"))


FLOW = "z AS (SELECT source, target, 1 / (1 + exp(-(list_extract(y.e, 1) * list_extract(x.e, 2) - list_extract(y.e, 2) * list_extract(x.e, 1)))) - 1 / (1 + exp(-(list_extract(x.e, 1) * list_extract(y.e, 2) - list_extract(x.e, 2) * list_extract(y.e, 1)))) AS ds FROM edges JOIN v x ON source = x.id JOIN v y ON target = y.id)"


@query("layer_conformance", None, f"{SQL}, {FLOW} SELECT {rnd('1 - sum(greatest(ds, 0)) / sum(abs(ds))')} AS conformance FROM z")
def _(spark, d):
    v = vectors(spark, d)
    return V.layer_conformance(v, links(v), {(0, 1): 1.0, (1, 0): -1.0}).select(S.rounded(F.col("conformance")).alias("conformance"))


@query("health_score", None, f"{SQL}, {CENTROIDS}, {RECON}, {FLOW}, k AS (SELECT least(1.0, greatest(0.0, 1 - median(err))) AS c FROM r), l AS (SELECT 1 - sum(greatest(ds, 0)) / sum(abs(ds)) AS f FROM z) SELECT {rnd('CASE WHEN c <= 0 OR f <= 0 THEN 0.0 ELSE power(c, 0.7) * power(f, 0.3) END')} AS score FROM k, l")
def _(spark, d):
    v = vectors(spark, d)
    c = V.health_coherence(V.reconstruction_error(v, V.centroid_vectors(v)))
    return V.health_score(c, V.layer_conformance(v, links(v), {(0, 1): 1.0, (1, 0): -1.0})).select(S.rounded(F.col("score")).alias("score"))


SCORES = f"{CENTROIDS}, {RECON}, dg AS (SELECT id, count(*) AS d FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) x GROUP BY id), sc AS (SELECT r.id, round(err, 9) AS a, round(list_distance(v.e, c.c), 9) AS b, d FROM r JOIN dg USING (id) JOIN v ON v.id = r.id JOIN c USING (module)), rk AS (SELECT id, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM sc)"


def scores(spark, d: str) -> DataFrame:
    """id, a (reconstruction error), b (distance to the centroid) and d (degree)."""
    v = vectors(spark, d)
    c = V.centroid_vectors(v)
    degree = links(v).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    far = v.join(c, "module").select("id", F.round(S.euclidean(F.col("vector"), F.col("centroid")), 9).alias("b"))
    return V.reconstruction_error(v, c).select("id", F.round("error", 9).alias("a")).join(far, "id").join(degree, "id")


@query("win_spearman", None, f"{SQL}, {SCORES} SELECT {rnd('corr(ra, rb)')} AS spearman FROM rk")
def _(spark, d):
    return V.spearman(scores(spark, d)).select(S.rounded(F.col("spearman")).alias("spearman"))


@query("set_topk_overlap", None, f"{SQL}, {SCORES}, t AS (SELECT id, row_number() OVER (ORDER BY a DESC, id) <= ceil(0.2 * count(*) OVER ()) AS x, row_number() OVER (ORDER BY b DESC, id) <= ceil(0.2 * count(*) OVER ()) AS y FROM sc) SELECT {rnd('count(*) FILTER (x AND y) / count(*) FILTER (x OR y)')} AS overlap FROM t")
def _(spark, d):
    return V.top_overlap(scores(spark, d)).select(S.rounded(F.col("overlap")).alias("overlap"))


@query("eval_tiers", None, f"{SQL}, {SCORES}, o AS (SELECT ra, id % 17 = 0 AS bad FROM rk) SELECT {rnd('(sum(ra) FILTER (bad) - count(*) FILTER (bad) * (count(*) FILTER (bad) + 1) / 2.0) / (count(*) FILTER (bad) * count(*) FILTER (NOT bad))')} AS auc FROM o")
def _(spark, d):
    return V.rank_auc(scores(spark, d).select("id", F.col("a").alias("score"), (F.col("id") % 17 == 0).alias("positive"))).select(S.rounded(F.col("auc")).alias("auc"))


@query("eval_baselines", None, f"{SQL}, {SCORES} SELECT id, {rnd('b')} AS centroid_distance, d AS degree, id * 7919 % 1000 / 1000.0 AS random FROM sc")
def _(spark, d):
    return scores(spark, d).select("id", S.rounded(F.col("b")).alias("centroid_distance"), F.col("d").alias("degree"), (F.col("id") * 7919 % 1000 / 1000.0).alias("random"))


NEIGHBOURS = "nb AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges)"


@query("topk_knn", None, f"{SQL}, {NEIGHBOURS}, s AS (SELECT nb.a AS id, {COS.format('x.e', 'y.e')} AS s FROM nb JOIN v x ON nb.a = x.id JOIN v y ON nb.b = y.id WHERE x.module = y.module) SELECT id, {rnd('list_extract(list_sort(list(s), $$DESC$$), 3)')} AS third FROM s GROUP BY id HAVING count(*) >= 3")
def _(spark, d):
    v = vectors(spark, d)
    return V.third_neighbour(v, links(v)).select("id", S.rounded(F.col("third")).alias("third"))


COHERENT = f"coh AS (SELECT a.module, avg({PAIR}) AS coherence FROM v a JOIN v b ON a.module = b.module AND a.id < b.id GROUP BY a.module), sz AS (SELECT module, count(*) AS n FROM v GROUP BY module)"
MISPLACED = f"""{NEIGHBOURS}, x AS (SELECT v.id, v.module AS own, c.module AS other, {COS.format('v.e', 'c.c')} AS s FROM v, c), o AS (SELECT id, own, s AS sim_own FROM x WHERE own = other), bs AS (SELECT id, max(s) AS sim_best, arg_max(other, round(s, 9) - other * 1e-12) AS best FROM x JOIN coh ON other = coh.module JOIN sz ON sz.module = other WHERE own <> other AND n >= 6 AND coherence >= 0.3 GROUP BY id),
 th AS (SELECT id, list_extract(list_sort(list(s), 'DESC'), 3) AS third FROM (SELECT nb.a AS id, {COS.format('x.e', 'y.e')} AS s FROM nb JOIN v x ON nb.a = x.id JOIN v y ON nb.b = y.id WHERE x.module = y.module) t GROUP BY id),
 f AS (SELECT o.id, own, best, sim_own, sim_best FROM o JOIN bs USING (id) JOIN sz ON own = sz.module LEFT JOIN th USING (id) WHERE n >= 6 AND sim_best > sim_own AND sim_best - sim_own >= 0.09 AND sim_own < 0.3 AND EXISTS (SELECT 1 FROM nb JOIN v y ON nb.b = y.id WHERE nb.a = o.id AND y.module = best) AND NOT coalesce(third > sim_best, false)),
 k AS (SELECT own, count(*) AS flagged FROM f GROUP BY own)"""


@query("issue_misplaced_concern", None, f"{SQL}, {CENTROIDS}, {COHERENT}, {MISPLACED} SELECT f.id, f.own, f.best, {rnd('least(1.0, 0.5 * least(1.0, (sim_best - sim_own) / 0.4) + 0.3 * least(1.0, greatest(0.0, sim_best / 0.8)) + 0.2 * (SELECT 1 - count(*) FILTER (y.module = f.own) / count(*) FROM edges e JOIN v y ON e.target = y.id WHERE e.source = f.id))')} AS severity FROM f JOIN k USING (own) JOIN sz ON sz.module = f.own WHERE flagged / n <= 0.15 + 3 * sqrt(0.1275 / n)")
def _(spark, d):
    v = vectors(spark, d)
    return V.misplaced(v, links(v), null=0.3).select("id", "own", "best", S.rounded(F.col("severity")).alias("severity"))


@query("cross_package_semantics", None, f"{SQL}, {COHERENT} SELECT module, {rnd('coherence')} AS coherence, CASE WHEN (coherence - 0.05) / 0.1 > 0.8 THEN 'shared_domain_concept' WHEN (coherence - 0.05) / 0.1 > 0.2 THEN 'incomplete_split' ELSE 'accidental_coupling' END AS root_cause FROM coh JOIN sz USING (module) WHERE n >= 6")
def _(spark, d):
    c = V.coherence(vectors(spark, d))
    effect = S.cohens_d(F.col("coherence"), F.lit(0.05), F.lit(0.1))
    return c.select("module", S.rounded(F.col("coherence")).alias("coherence"), F.when(effect > 0.8, "shared_domain_concept").when(effect > 0.2, "incomplete_split").otherwise("accidental_coupling").alias("root_cause"))


NEAR = f"{NEIGHBOURS}, h2 AS (SELECT a, b FROM nb UNION SELECT x.a, y.b FROM nb x JOIN nb y ON x.b = y.a WHERE x.a <> y.b), h3 AS (SELECT a, b FROM h2 UNION SELECT x.a, y.b FROM h2 x JOIN nb y ON x.b = y.a WHERE x.a <> y.b), cand AS (SELECT a.id AS a, b.id AS b, {PAIR} AS s FROM v a JOIN v b ON a.id < b.id WHERE a.module <> b.module AND {PAIR} > 0.8)"


@query("issue_shadow_dependency", None, f"{SQL}, {NEAR} SELECT a, b, {rnd('s')} AS similarity FROM cand WHERE NOT EXISTS (SELECT 1 FROM h3 WHERE h3.a = cand.a AND h3.b = cand.b)")
def _(spark, d):
    v = vectors(spark, d)
    return V.shadow_dependencies(v, links(v), least=0.8).select("a", "b", S.rounded(F.col("similarity")).alias("similarity"))


@query("issue_redundant_api", None)
def _(spark, d):
    v = vectors(spark, d)
    return V.redundant_apis(v, links(v), least=0.7, overlap=0.2)


@query("issue_incoherent_module", None)
def _(spark, d):
    return V.incoherent_modules(vectors(spark, d), null=0.9)


@query("fn_l2_normalize", None, f"{SQL} SELECT id, CAST(k AS INTEGER) AS k, {rnd('list_extract(e, k) / sqrt(list_sum(list_transform(list_slice(e, 1, 8), lambda y: y * y)))')} AS x FROM v, range(1, 9) t(k)")
def _(spark, d):
    return vectors(spark, d).select("id", F.posexplode(S.l2_normalized(F.col("vector"), 8)).alias("k", "x")).select("id", (F.col("k") + 1).alias("k"), S.rounded(F.col("x")).alias("x"))


@query("fn_distances", None, f"{SQL} SELECT a.id, {rnd('list_distance(a.e, b.e)')} AS distance, {rnd('power(list_distance(a.e, b.e), 2)', 3)} AS squared FROM v a JOIN v b ON b.id = a.id + 1")
def _(spark, d):
    v = vectors(spark, d)
    both = v.join(v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("w")), "id")
    x = S.euclidean(F.col("vector"), F.col("w"))
    return both.select("id", S.rounded(x).alias("distance"), S.rounded(x * x, 3).alias("squared"))


@query("agg_coverage", None, f"{SQL} SELECT {rnd('avg(CASE WHEN abs(list_extract(e, 1)) > 0.01 OR abs(list_extract(e, 2)) > 0.01 THEN 1.0 ELSE 0.0 END)')} AS coverage FROM v")
def _(spark, d):
    return vectors(spark, d).agg(S.rounded(F.avg(F.exists(F.slice("vector", 1, 2), lambda x: F.abs(x) > 0.01).cast("double"))).alias("coverage"))


@query("kmeans_multi_start", None)
def _(spark, d):
    return V.kmeans_best(vectors(spark, d), k=10)


@query("estimate_k", None)
def _(spark, d):
    return V.k_sweep(vectors(spark, d), range(2, 13))


@query("random_baseline", None)
def _(spark, d):
    return V.random_silhouette(vectors(spark, d), k=10)


@query("ami", None)
def _(spark, d):
    return V.adjusted_information(V.kmeans_best(vectors(spark, d), k=10).select("id", F.col("cluster").alias("a")), vectors(spark, d).select("id", F.col("module").alias("b")))
