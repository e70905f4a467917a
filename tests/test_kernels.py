"""Closed-form cases of the numeric kernels."""

import numpy as np
import pytest

from graphloom.operators import kernels as K


def graph(spark, pairs):
    ids = sorted({x for p in pairs for x in p})
    return spark.createDataFrame([(i, "class", "") for i in ids], "id string, kind string, file string"), spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source string, target string, kind string")


def test_betweenness(spark):
    star = {r.id: r.betweenness for r in K.betweenness(*graph(spark, [("0", c) for c in "1234"])).collect()}
    assert set(star.values()) == {0.0}
    path = {r.id: r.betweenness for r in K.betweenness(*graph(spark, [("a", "b"), ("b", "c")])).collect()}
    assert path["b"] == pytest.approx(0.5)
    # two parallel edges are two paths: half of what passes goes through each of three
    twin = {r.id: r.betweenness for r in K.betweenness(*graph(spark, [("s", "x"), ("s", "x"), ("s", "y"), ("x", "t"), ("y", "t")])).collect()}
    assert twin["x"] == pytest.approx(2 / 3 / 6) and twin["y"] == pytest.approx(1 / 3 / 6)


def test_laplacian_of_a_complete_graph(spark):
    _, edges = graph(spark, [(a, b) for a in "abcde" for b in "abcde" if a < b])
    got = sorted(r.value for r in K.laplacian_values(edges).collect())
    assert got == pytest.approx([1.25] * 4)


def test_connected(spark):
    _, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")])
    assert {r.id: r.component for r in K.connected(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_kmeans_and_silhouette():
    data = np.array([[0, 0], [0.1, 0], [0, 0.1], [9, 9], [9.1, 9], [9, 9.1]])
    labels, centroids = K.kmeans(data, 2, 42)
    assert len(set(labels[:3])) == 1 and len(set(labels[3:])) == 1 and labels[0] != labels[3]
    assert K.silhouette(data, labels, centroids) > 0.9
    line = np.array([[0.0], [0.1], [10.0], [10.1]])
    assert K.silhouette(line, np.array([0, 0, 1, 1]), np.array([[0.05], [10.05]])) > 0.9


def test_xorshift():
    r = K.Xorshift(0)
    assert r.next() == K.Xorshift(1).next() == 1082269761 and 0 <= r.unit() < 1 and r.below(7) < 7 and r.weighted(np.zeros(3)) == 0


def test_period_sample(spark):
    rows = spark.createDataFrame([("r", f"2024-01-{d:02d}") for d in (1, 3, 8, 9, 16, 17)], "k string, day string").selectExpr("k", "to_date(day) AS day")
    assert sorted(r.day.day for r in K.period_sample(rows, "k", "day", 7).collect()) == [1, 8, 16, 17]


def random_part(n, m, seed):
    r = np.random.default_rng(seed)
    i, j = r.integers(0, n, m), r.integers(0, n, m)
    return i[i != j], j[i != j], r.integers(1, 4, m)[i != j].astype(float)


def test_sparse_values_are_those_of_the_matrix():
    i, j, w = random_part(400, 700, 5)
    great = np.bincount(K.pieces(400, i, j)).argmax()
    own = K.pieces(400, i, j)[i] == great
    ids, at = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
    i, j, w = at[: own.sum()], at[own.sum() :], w[own]
    values, vectors = np.linalg.eigh(K.normalised_laplacian(len(ids), i, j, w))
    got, x = K.sparse_lowest(len(ids), i, j, w, 8)
    assert got == pytest.approx(values[:9], abs=1e-9)
    assert np.abs((vectors[:, :9] * x).sum(0)) == pytest.approx(np.ones(9), abs=1e-6)
    # five equal arms at one node: every value but the middle ones is there four times
    arms = np.arange(30)
    i, j, w = np.where(arms % 6 == 0, 0, arms), arms + 1, np.ones(30)
    assert K.sparse_lowest(31, i, j, w, 8)[0] == pytest.approx(np.linalg.eigvalsh(K.normalised_laplacian(31, i, j, w))[:9], abs=1e-9)
    # two triangles and a node alone: zero twice, and the sides are the components
    values, vectors = K.sparse_lowest(7, np.array([0, 1, 2, 3, 4, 5, 6]), np.array([1, 2, 0, 4, 5, 3, 6]), np.array([1.0] * 6 + [0]), 1)
    assert list(values) == [0, 0] and vectors[0, 1] * vectors[3, 1] < 0 and vectors[6, 1] == 0
    path = np.arange(2999)
    assert K.sparse_lowest(3000, path, path + 1, np.ones(2999), 3)[0] == pytest.approx(1 - np.cos(np.pi * np.arange(4) / 2999), abs=1e-9)


def test_spectra_of_parts_beyond_a_matrix(spark):
    many = K.MOST_NODES + 50
    nodes, edges = graph(spark, [("hub", f"n{x}") for x in range(many)])
    assert {(r.rank, round(r.value, 9)) for r in K.laplacian_values(edges).collect()} == {(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)}
    assert K.fingerprints(edges, 4).count() == many + 1
    parts = K.module_fiedler(edges, nodes.selectExpr("id", "'m' AS module")).groupBy("module").agg({"value": "max", "size": "max", "id": "count"}).first()
    assert parts["max(value)"] == pytest.approx(1) and parts["max(size)"] == parts["count(id)"] == many + 1
