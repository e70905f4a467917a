"""Graph operators against closed forms and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import components as C
from graphloom.operators import diagnostics as D
from graphloom.operators import graphs as G
from graphloom.operators import issues as I
from graphloom.operators import kernels as K
from graphloom.operators import modules as M
from graphloom.operators import mutations as X
from graphloom.operators import semantic as V


@pytest.fixture(scope="module")
def edges(spark):
    def make(pairs, kind="calls"):
        return spark.createDataFrame([(str(a), str(b), kind) for a, b in pairs], "source string, target string, kind string")

    return make


def reachable(pairs):
    nodes = {x for p in pairs for x in p}
    far = {n: {b for a, b in pairs if a == n} for n in nodes}
    while True:
        new = {n: far[n].union(*(far[m] for m in far[n])) for n in nodes}
        if new == far:
            return far
        far = new


def found_components(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.component, set()).add(r.id)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("in_task", [0, 1_000_000])
def test_strong_components_of_any_length(edges, in_task):
    ring = [(f"r{k:02}", f"r{(k + 1) % 15:02}") for k in range(15)]
    pairs = [*ring, ("r03", "x"), ("x", "y"), ("y", "x"), ("z", "r00"), ("s", "s")]
    assert found_components(C.strong(edges(pairs), in_task)) == {frozenset(f"r{k:02}" for k in range(15)), frozenset("xy")}


def test_strong_components_by_brute_force(edges):
    for seed in range(3):
        r = random.Random(seed)
        pairs = sorted({(f"n{r.randrange(12):02}", f"n{r.randrange(12):02}") for _ in range(18)})
        far = reachable(pairs)
        want = {frozenset(m for m in far if m in far[n] and n in far[m]) | {n} for n in far if n in far[n]}
        assert found_components(C.strong(edges(pairs))) == {w for w in want if len(w) > 1}


def test_weak_components(edges):
    pairs = [(1, 2), (3, 2), (3, 4), (9, 8), (7, 7)]
    assert {r.id: r.component for r in C.weak(edges(pairs)).collect()} == {"1": "1", "2": "1", "3": "1", "4": "1", "8": "8", "9": "8"}


def test_tree_of_depth_forty_and_a_cycle(spark, edges):
    chain = [(f"c{k:02}", f"c{k + 1:02}") for k in range(40)]
    all_ = edges([*chain, ("a", "b"), ("b", "a"), ("b", "under")], "defines")
    nodes = spark.createDataFrame([(f"c{k:02}",) for k in range(41)] + [("a",), ("b",), ("under",)], "id string")
    got = {r.id: r for r in G.tree_features(nodes, all_).collect()}
    assert all((got[f"c{k:02}"].depth, got[f"c{k:02}"].subtree) == (k, 40 - k) for k in range(41))
    assert all((got[n].depth, got[n].subtree, got[n].siblings) == (0, 0, 0) for n in ("a", "b", "under"))


def test_propagated_clusters(spark, edges):
    chain = edges([(f"c{k:02}", f"c{k + 1:02}") for k in range(40)] + [("x", "y"), ("y", "x")], "defines")
    nodes = spark.createDataFrame([(f"c{k:02}",) for k in range(41)] + [("x",), ("y",)], "id string")
    given = spark.createDataFrame([("c00", "top"), ("c30", "low")], "id string, cluster string")
    assert {r.id: r.cluster for r in M.propagated(nodes, chain, given).collect()} == {f"c{k:02}": "low" if k >= 30 else "top" for k in range(41)}


def test_return_probabilities_of_a_cycle(edges):
    got = {(r.id, r.steps): r.p for r in G.return_probabilities(edges([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]), 16).collect()}
    assert all(abs(got[n, t] - (0.5 if t % 2 == 0 else 0.0)) < 1e-12 for n in "abcd" for t in range(2, 17))


def test_layers_and_violations(spark, edges):
    assign = spark.createDataFrame([("a", "top"), ("b", "mid"), ("c", "low")], "id string, module string")
    e = edges([("a", "b")] * 20 + [("b", "c")] * 20 + [("c", "a")])
    level = {r.module: r.layer for r in I.layers(I.between_modules(e, assign).groupBy("sm", "tm").agg(F.count("*").alias("n")).where("n > 1"), assign.select("module")).collect()}
    assert level == {"top": 0, "mid": 1, "low": 2}
    e = edges([("a", "b")] * 20 + [("b", "a")])
    got = I.layer_violations(e, assign).collect()
    assert [(r.source_module, r.target_module, r.n, r.reverse) for r in got] == [("mid", "top", 1, 20)] and 0.5 <= got[0].severity <= 1


def test_circular_dependencies(spark, edges):
    assign = spark.createDataFrame([("p.a", "m"), ("p.b", "m"), ("p.test_a", "m"), ("p.test_b", "m")], "id string, module string")
    e = edges([("p.a", "p.b"), ("p.b", "p.a"), ("p.test_a", "p.test_b"), ("p.test_b", "p.test_a")])
    got = I.circular_dependencies(e, C.strong(e), assign).collect()
    # two nodes of one package: half of 0.4 * 2/20 + 0.3 * 1/5 + 0.3 * 1/10
    assert [(r.component, r.size, r.longest) for r in got] == [("p.a", 2, 1)] and abs(got[0].severity - 0.5 * (0.04 + 0.06 + 0.03)) < 1e-12
    inherits = e.withColumn("kind", F.lit("inherits"))
    assert I.circular_dependencies(inherits, C.strong(inherits), assign).count() == 0


def test_near_disconnect(spark, edges):
    left, right = [f"l{k}" for k in range(6)], [f"r{k}" for k in range(6)]
    cliques = [(a, b) for part in (left, right) for a in part for b in part if a < b]
    e = edges([*cliques, ("l0", "r0")])
    assign = spark.createDataFrame([(n, "m") for n in left + right], "id string, module string")
    null = spark.createDataFrame([(0.5 + k / 100,) for k in range(20)], "value double")
    got = I.near_disconnects(K.module_fiedler(e, assign), e, null).collect()
    assert [(r.module, r.cut) for r in got] == [("m", 1)] and got[0].severity > 0.8


def test_spectrum_of_two_cliques(edges):
    n = 5
    pairs = [(f"a{i}", f"a{j}") for i in range(n) for j in range(i)]
    values = [r.value for r in K.laplacian_values(edges(pairs), 4).orderBy("rank").collect()]
    assert np.allclose(values, n / (n - 1))
    assert K.eigengap(K.laplacian_values(edges(pairs), 4)).count() == 1


def test_web_roles_and_bridges(spark, edges):
    star = [(f"x{k}", "hub") for k in range(5)]
    nodes = spark.createDataFrame([(f"x{k}",) for k in range(5)] + [("hub",), ("alone",)], "id string")
    e = edges(star)
    got = {r.id: r.role for r in D.web_roles(nodes, e, K.betweenness(nodes, e)).collect()}
    assert got["hub"] == "utility" and got["alone"] == "orphan"


def test_mutations(spark, edges):
    assign = spark.createDataFrame([(f"{m}.{k}", m) for m in "abc" for k in range(6)], "id string, module string")
    e = edges([(f"a.{k}", f"a.{k + 1}") for k in range(5)])
    assert C.strong(X.inject_cycle(e, assign, 5)).count() >= 5
    assert X.overloaded_utility(e, assign, 1.0).count() == e.count() + 2
    assert X.near_disconnect(e, assign, 1.0).count() == 0
    with pytest.raises(ValueError):
        X.apply("nothing", e, assign)


def test_redundant_apis(spark):
    vectors = spark.createDataFrame([(k, 0, [1.0, k / 100]) for k in range(6)] + [(9, 1, [0.0, 1.0])], "id long, module int, vector array<double>")
    links = spark.createDataFrame([(9, k) for k in range(3)] + [(k, t) for k in range(3) for t in (3, 4, 5)], "source long, target long")
    got = V.redundant_apis(vectors, links).collect()
    assert [(r.members, r.mean_overlap) for r in got] == [(3, 1.0)] and got[0].mean_similarity > 0.99


def test_quality_gate(spark):
    r = np.random.default_rng(1)
    near = [(k, k % 3, (np.eye(8)[k % 3] * 3 + r.normal(size=8)).tolist()) for k in range(90)]
    far = [(k, k % 3, r.normal(size=8).tolist()) for k in range(90)]
    schema = "id long, module int, vector array<double>"
    assert V.quality_gate(spark.createDataFrame(near, schema)).first().passed
    assert not V.quality_gate(spark.createDataFrame(far, schema)).first().passed


def test_adjusted_information(spark):
    same = spark.createDataFrame([(k, k % 4) for k in range(40)], "id long, a int")
    assert abs(V.adjusted_information(same, same.withColumnRenamed("a", "b")).first().ami - 1) < 1e-9
    r = random.Random(2)
    other = spark.createDataFrame([(k, r.randrange(4)) for k in range(40)], "id long, b int")
    assert abs(V.adjusted_information(same, other).first().ami) < 0.2


def test_near_disconnects_where_random_parts_fall_apart(spark, edges):
    # half of the random parts have a value of zero: no division by it, and a module at zero is not below zero
    values = spark.createDataFrame([("m", 6, 0.0, x, 1 if x in "abc" else -1) for x in "abcdef"], "module string, size long, value double, id string, side int")
    own = edges([("a", "b"), ("b", "c"), ("d", "e"), ("e", "f"), ("c", "d")])
    null = spark.createDataFrame([(x,) for x in (0.0, 0.0, 0.0, 0.0, 0.5)], "value double")
    assert I.near_disconnects(values, own, null).collect() == []
    above = spark.createDataFrame([(x,) for x in (0.1, 0.1, 0.1, 0.1, 0.5)], "value double")
    assert [(r.module, r.cut) for r in I.near_disconnects(values, own, above).collect()] == [("m", 1)]
    low = spark.createDataFrame([(x,) for x in (0.0, 0.0, 0.0)], "value double")
    assert [r.severity for r in I.near_disconnects(values, own, low).collect()] == [pytest.approx(0.4 + 0.3 * (1 - 1 / 3.0) + 0.3)]


def test_longest_paths_are_those_of_all_pairs(spark):
    draw = random.Random(3)
    for n, more in ((2, 0), (7, 3), (40, 12), (90, 60), (60, 0)):
        pairs = {(i, (i + 1) % n) for i in range(n)} | {(a, b) for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(more)) if a != b}
        far = 0
        for start in range(n):
            hops, queue = {start: 0}, [start]
            for x in queue:
                for a, b in sorted(pairs):
                    if a == x and b not in hops:
                        hops[b] = hops[x] + 1
                        queue.append(b)
            far = max(far, *hops.values())
        source, target = np.array(sorted(pairs)).T
        assert I.diameter(n, source, target) == far
    two = spark.createDataFrame([("a", "a", "b"), ("a", "b", "a"), ("x", "x", "y"), ("x", "y", "z"), ("x", "z", "x")], "component string, source string, target string")
    assert {(r.component, r.longest) for r in I.longest_paths(two).collect()} == {("a", 1), ("x", 2)}


def test_longest_path_takes_few_searches(monkeypatch):
    # a component of some ten thousand nodes: a search from each would be far more
    r, n = np.random.default_rng(1), 12_000
    source, target = np.concatenate([np.arange(n), r.integers(0, n, n // 2)]), np.concatenate([(np.arange(n) + 1) % n, r.integers(0, n, n // 2)])
    own, asked = I.farther, []
    monkeypatch.setattr(I, "farther", lambda *a: asked.append(1) or own(*a))
    assert I.diameter(n, source, target) > 0 and len(asked) < 1000


def test_return_probabilities_of_parts_and_chunks(spark, edges):
    draw = random.Random(9)
    pairs = [(f"a{draw.randrange(40)}", f"a{draw.randrange(40)}") for _ in range(90)] + [("b1", "b2"), ("b2", "b3"), ("b1", "b2")] + [(f"c{x}", f"c{(x + 1) % 5}") for x in range(5)]
    pairs = [(a, b) for a, b in pairs if a != b]
    ids = sorted({x for p in pairs for x in p})
    m = np.zeros((len(ids), len(ids)))
    for a, b in pairs:
        m[ids.index(a), ids.index(b)] += 1
        m[ids.index(b), ids.index(a)] += 1
    w = m / m.sum(1, keepdims=True)
    want = {(x, t): np.linalg.matrix_power(w, t)[i, i] for i, x in enumerate(ids) for t in range(1, 17)}
    for chunk in (4_000_000, 50):  # the same from one chunk of links as from several
        got = {(r.id, r.steps): r.p for r in G.return_probabilities(edges(pairs), 16, chunk).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_rwpe_reads_all_lines():
    from graphloom.plans import registry

    assert "l_quantity" not in registry.oracle_sql()["rwpe"]


def test_clusters_are_held_in_pieces():
    """The same as with all distances at once, without an array of them."""
    import tracemalloc

    data = np.random.default_rng(4).random((20_000, 16))
    tracemalloc.start()
    labels, centers = K.kmeans(data, 8, 42, steps=3)
    s = K.silhouette(data, labels, centers)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * data.nbytes  # all differences are 8 times the data, and twice that in the making
    far = np.sqrt(((data[:, None, :] - centers[None, :, :]) ** 2).sum(2))
    own = far[np.arange(len(data)), labels]
    far[np.arange(len(data)), labels] = np.inf
    other = far.min(1)
    assert s == pytest.approx(float(((other - own) / np.maximum(own, other)).mean()), abs=1e-12)
    assert K.centers_of(data, labels, 9)[:8] == pytest.approx(np.stack([data[labels == c].mean(0) for c in range(8)]), abs=1e-12)
    assert not K.centers_of(data, labels, 9)[8].any()


def test_vectors_of_tasks_are_in_the_order_of_ids():
    import pyarrow as pa

    parts = [pa.table({"id": pa.array(ids, pa.int64()), "vector": pa.array([[float(x), 0.5] for x in ids], pa.list_(pa.float64()))}) for ids in ([5, 1], [], [3])]
    ids, data = V.as_matrix(pa.concat_tables(parts))
    assert ids.tolist() == [1, 3, 5] and data.tolist() == [[1, 0.5], [3, 0.5], [5, 0.5]]


def test_shadow_dependencies_of_tiles(spark):
    r = np.random.default_rng(2)
    data = r.standard_normal((60, 3))
    vectors = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(data)], "id long, module long, vector array<double>")
    pairs = {(i, (i * 7 + 3) % 60) for i in range(60)} | {(0, 1), (1, 2), (2, 4)}
    links = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "source long, target long")
    near = {i: {b for a, b in pairs | {(b, a) for a, b in pairs} if a == i and a != b} for i in range(60)}
    u = data / np.linalg.norm(data, axis=1, keepdims=True)
    want = set()
    for a in range(60):
        two = {y for x in near[a] for y in near[x]}
        reached = near[a] | two | {z for y in two for z in near[y]}
        want |= {(a, b) for b in range(a + 1, 60) if a % 3 != b % 3 and u[a] @ u[b] > 0.8 and b not in reached}
    for tile in (2048, 3):
        assert {(x.a, x.b) for x in V.shadow_dependencies(vectors, links, 0.8, 2, tile).collect()} == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_interfaces_become_more_as_nodes_do(spark, edges):
    own = edges([("a.x", "b.y"), ("a.x", "b.z"), ("a.w", "b.y"), ("b.y", "a.x")])
    for many in (10, 40_000):
        assign = spark.range(many).selectExpr("concat('n', id) AS id", "'m' AS module").unionByName(spark.createDataFrame([(f"{m}.{x}", m) for m, x in ("ax", "aw", "by", "bz")], "id string, module string"))
        for found in (G.interface_width(own, assign), D.expected_diversity(own, assign)):
            rows = {tuple(r) for r in found.collect()}
        assert rows == {("b.y", 1, 2 - 0.25**2 - 0.75**2), ("b.z", 1, 1.0), ("a.x", 1, 1.0)}
        assert {tuple(r) for r in G.interface_width(own, assign).collect()} == {("a", "b", 3, 3, 2), ("b", "a", 1, 1, 1)}
        assert "RepartitionByExpression [target" in plan_of(G.interface_width(own, assign)) and G.portions(assign) == max(4, -(-(many + 4) // 5000))


def test_imports_are_matched_by_modules_not_by_calls(edges):
    from graphloom.operators import reports as R

    calls = edges([("a.b.f", "c.d.g"), ("a.b.f", "c.d.g"), ("a.b.h", "c.e.g"), ("a.x.f", "c.d.g"), ("a.b.f", "c"), ("a.b.f", "z.q")])
    imports = edges([("a.b", "c.d"), ("a.x", "c"), ("a.b", "z.q"), ("a.b", "c")], "imports").where("target <> 'c' OR source = 'a.x'")
    found = R.import_validated(calls, imports, lambda s: F.substring_index(s, ".", 2))
    assert sorted((r.source, r.target) for r in found.collect()) == [("a.b.f", "c.d.g"), ("a.b.f", "c.d.g"), ("a.x.f", "c.d.g")]
    assert "strategy=broadcast" in plan_of(found)
