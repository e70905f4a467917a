"""Closed-form cases of single operators."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import components as C
from graphloom.operators import diagnostics as D
from graphloom.operators import graphs as G


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "source string, target string, kind string")


def test_bfs_is_capped(spark):
    d = {(r.source, r.target): r.d for r in G.reach(edges(spark, [(str(i), str(i + 1)) for i in range(5)]), 4).collect()}
    assert ("0", "5") not in d and d["0", "4"] == 4 and d["0", "3"] == 3


def test_cycle_is_one_component(spark):
    found = {r.id: r.component for r in C.strong(edges(spark, [("0", "1"), ("1", "2"), ("2", "0"), ("3", "0")])).collect()}
    assert found == {"0": "0", "1": "0", "2": "0"}


def test_percentile_ranks(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    got = sorted(r.rank for r in G.percentile_ranks(df, "v").collect())
    assert got == [0.0, 0.25, 0.5, 0.75, 1.0]
    ties = spark.createDataFrame([(1.0,)] * 3, "v double")
    assert {r.rank for r in G.percentile_ranks(ties, "v").collect()} == {0.0}


def test_quartiles(spark):
    q = D.quartiles(spark.createDataFrame([(float(i),) for i in range(1, 8)], "v double"), "v").first()
    assert (q.q1, q.median, q.q3) == (2.5, 4.0, 5.5)


@pytest.mark.parametrize(("k", "n", "p"), [(5, 10, 0.623046875), (0, 6, 0.015625), (6, 6, 1.0)])
def test_binomial(spark, k, n, p):
    assert spark.range(1).select(S.binomial_cdf(F.lit(k), F.lit(n)).alias("p")).first().p == pytest.approx(p)


def test_sign_test(spark):
    got = [spark.range(1).select(S.direction_significant(F.lit(a), F.lit(b)).alias("x")).first().x for a, b in ((0, 6), (2, 6), (0, 3))]
    assert got == [True, False, False]


def test_tokens(spark):
    df = spark.createDataFrame([("pkg.module.getUserName",), ("pkg.auth.validate_jwt_token",), ("a.HTMLParser",)], "id string")
    got = [r.t for r in df.select(S.tokens_of(F.col("id"), ("get",)).alias("t")).collect()]
    assert got == [["user", "name"], ["validate", "jwt", "token"], ["html", "parser"]]


def test_rwpe_of_ring_and_star(spark):
    ring = {r.id: r.p for r in G.return_probabilities(edges(spark, [(str(i), str((i + 1) % 6)) for i in range(6)]), 2).where("steps = 2").collect()}
    assert set(ring.values()) == {0.5}
    star = {r.id: r.p for r in G.return_probabilities(edges(spark, [("h", c) for c in "abcd"]), 2).where("steps = 2").collect()}
    assert star["h"] == 1.0 and star["a"] == 0.25


def test_tree(spark):
    e = edges(spark, [("p", "p.m"), ("p.m", "p.m.a"), ("p.m", "p.m.b"), ("p.m", "p.m.c")], "defines")
    n = spark.createDataFrame([(x, "module", "") for x in ("p", "p.m", "p.m.a", "p.m.b", "p.m.c", "q")], "id string, kind string, file string")
    got = {r.id: [r.depth, r.sibling_index, r.subtree, r.siblings] for r in G.tree_features(n, e).collect()}
    assert got["p"] == [0, 0, 4, 0] and got["p.m"] == [1, 0, 3, 1] and got["p.m.c"] == [2, 2, 0, 3] and got["q"] == [0, 0, 0, 0]


def test_nmi(spark):
    a = spark.createDataFrame([(str(i), i // 2) for i in range(4)], "id string, label int")
    b = spark.createDataFrame([(str(i), i % 2) for i in range(4)], "id string, label int")
    assert G.nmi(a, a).first().nmi == pytest.approx(1.0)
    assert G.nmi(a, b).first().nmi < 0.01
