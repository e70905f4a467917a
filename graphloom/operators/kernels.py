"""Numeric kernels: one group of bounded size in a task, everything around them in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import weak
from graphloom.operators.tables import numbered, stored

MOST_NODES = 3000
"""A part of more nodes is not made a dense matrix: its smallest values come from products with its edges."""


class Xorshift:
    """The 64-bit generator with shifts 13, 7 and 17; a seed of 0 is 1."""

    def __init__(self, seed: int):
        self.state = seed or 1

    def next(self) -> int:
        x = self.state
        x ^= x << 13 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= x << 17 & 0xFFFFFFFFFFFFFFFF
        self.state = x
        return x

    def unit(self) -> float:
        return (self.next() >> 11) / 2.0**53

    def below(self, n: int) -> int:
        return self.next() % n

    def weighted(self, weights: np.ndarray) -> int:
        total = float(weights.sum())
        if total <= 0:
            return 0
        r = self.unit() * total
        at = int(np.searchsorted(np.cumsum(weights), r))
        return min(at, len(weights) - 1)


def connected(edges: DataFrame) -> DataFrame:
    """id and component (its least id) of nodes with coupling edges."""
    return weak(edges.where("kind <> 'defines'"))


def betweenness(nodes: DataFrame, edges: DataFrame, exact: int = 5000, most_edges: int = 20_000_000) -> DataFrame:
    """id and betweenness of directed, unweighted shortest paths; parallel edges count as paths. Scale 1/((n-1)(n-2)).

    Sources are spread over tasks; each has the adjacency as three arrays, whose size is checked before it is sent
    (12 bytes an edge). Beyond ``exact`` nodes every (n/sqrt n)-th source is taken and the result scaled up.
    """
    spark = nodes.sparkSession
    places = numbered(nodes)
    a, b = places.select(F.col("id").alias("source"), F.col("k").alias("s")), places.select(F.col("id").alias("target"), F.col("k").alias("t"))
    pairs = stored(edges.where("source <> target AND kind <> 'defines'").groupBy("source", "target").agg(F.count("*").alias("w")).join(a, "source").join(b, "target").select(F.col("s").cast("int"), F.col("t").cast("int"), F.col("w").cast("int")), "pairs")
    if pairs.count() > most_edges:
        raise ValueError(f"more than {most_edges} different edges: lift the graph to modules first")
    n, table = places.count(), pairs.toPandas().sort_values(["s", "t"])
    ends, weights = table["t"].to_numpy(np.int32), table["w"].to_numpy(np.int32)
    starts = np.searchsorted(table["s"].to_numpy(), np.arange(n + 1)).astype(np.int64)
    stride = 1 if n <= exact else max(1, n // int(np.sqrt(n)))
    shared = spark.sparkContext.broadcast((starts, ends, weights))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, ends, weights = shared.value
        size = len(starts) - 1
        total = np.zeros(size)
        for part in parts:
            for source in part["id"]:
                distance, paths = np.full(size, -1, np.int32), np.zeros(size)
                distance[source], paths[source] = 0, 1.0
                front, steps = np.array([source]), []
                while front.size:
                    many = starts[front + 1] - starts[front]
                    at = np.repeat(starts[front] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    tails, heads, times = np.repeat(front, many), ends[at], weights[at]
                    distance[heads[distance[heads] < 0]] = distance[front[0]] + 1
                    down = distance[heads] == distance[front[0]] + 1
                    tails, heads, times = tails[down], heads[down], times[down]
                    np.add.at(paths, heads, paths[tails] * times)
                    steps.append((tails, heads, times))
                    front = np.unique(heads)
                back = np.zeros(size)
                for tails, heads, times in reversed(steps):
                    np.add.at(back, tails, paths[tails] * times / paths[heads] * (1 + back[heads]))
                back[source] = 0
                total += back
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": at, "b": total[at]})

    count = len(range(0, n, stride))
    sums = spark.range(0, n, stride, max(1, min(count, 64))).mapInPandas(run, "k long, b double").groupBy("k").agg(F.sum("b").alias("b"))
    scale = (n / count) / max(1, (n - 1) * (n - 2)) if count else 0.0
    return places.join(sums, "k", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def numbers(part: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """part: a, b and w of each undirected edge. The sorted nodes, both ends as places among them, and the weights."""
    names = pd.Index(pd.unique(pd.concat([part["a"], part["b"]], ignore_index=True))).sort_values()
    return list(names), names.get_indexer(part["a"]), names.get_indexer(part["b"]), part["w"].to_numpy(float)


def normalised_laplacian(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """I - D^-1/2 A D^-1/2; a node without weight keeps a row of zeros but for the diagonal."""
    m = np.zeros((n, n))
    np.add.at(m, (i, j), w)
    np.add.at(m, (j, i), np.where(i != j, w, 0.0))
    d = m.sum(1)
    scale = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0.0)
    return np.eye(n) - scale[:, None] * m * scale[None, :]


def pieces(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each node's component, as the place of its least node."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def sparse_lowest(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, k: int, most: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The k + 1 smallest values of the same matrix, and their vectors as columns, in memory of the edges and some 3 (k + 9) columns.

    A block of k + 8 random columns is filtered by Chebyshev polynomials, which lift what is below the block's greatest
    value, until all k residuals are within 1e-10; so equal values are found as often as they are there. What the
    matrix maps to zero is known (a component's root degrees) and kept out.
    """
    loop = i == j
    rows, cols, vals = np.concatenate([i, j[~loop]]), np.concatenate([j, i[~loop]]), np.concatenate([w, w[~loop]])
    d = np.bincount(rows, vals, n)
    keep = np.argsort(rows, kind="stable")
    keep = keep[vals[keep] > 0]
    rows, cols = rows[keep], cols[keep]
    root_d = np.sqrt(d)
    scale = np.where(d > 0, 1 / np.where(d > 0, root_d, 1), 0.0)
    vals = vals[keep] * scale[rows] * scale[cols]
    piece = pieces(n, rows, cols)
    mass = np.bincount(piece, d, n)
    inner = np.flatnonzero(mass > 0)
    first = root_d / max(np.linalg.norm(root_d), 1e-300)
    if len(inner) > 1:  # of several components the greatest against the others
        great = piece == inner[mass[inner].argmax()]
        share = (first[great] ** 2).sum()
        contrast = np.where(great, np.sqrt((1 - share) / share), -np.sqrt(share / (1 - share))) * first
        if k > 1:
            raise ValueError("more than two values are asked of connected parts only")
        return np.zeros(2), np.stack([first, contrast], 1)

    mean = np.divide(1.0, mass, out=np.zeros(n), where=mass > 0)

    def apart(x: np.ndarray) -> np.ndarray:
        return x - root_d * (np.bincount(piece, root_d * x, n) * mean)[piece]

    def times(x: np.ndarray) -> np.ndarray:
        return np.stack([c - np.bincount(rows, vals * c[cols], n) for c in x])

    zeros, size = len(inner), min(k + 8, n - len(inner))
    x = np.stack([apart(c) for c in np.random.default_rng(7).standard_normal((size, n))])
    wanted, low, top = k + 1 - zeros, 0.0, 1.0
    for _ in range(most):
        # T_m of what maps (top, 2) to (-1, 1), of a degree that does not outgrow the digits of a column
        half, middle = (2 - top) / 2 + 1e-9, (2 + top) / 2
        degree = int(np.clip(23 / np.arccosh(max((middle - low) / half, 1 + 1e-6)), 8, 5000))
        before, now = x, (times(x) - middle * x) / half
        for _ in range(degree - 1):
            before, now = now, 2 * (times(now) - middle * now) / half - before
        x = np.linalg.qr(np.stack([apart(c) for c in now]).T)[0].T
        lx = times(x)
        values, turn = np.linalg.eigh(x @ lx.T)
        x, lx = turn.T @ x, turn.T @ lx
        if np.linalg.norm(lx[:wanted] - values[:wanted, None] * x[:wanted], axis=1).max() < 1e-10:
            values = np.concatenate([np.zeros(zeros), values[:wanted]])
            return values, np.concatenate([first[None, :] if zeros else x[:0], x[:wanted]]).T
        low, top = max(float(values[0]), 0.0), float(min(values[-1], 1.9))
    raise ValueError(f"the smallest values of a part of {n} nodes did not settle")


def lowest(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k + 1 smallest values (all, if there are fewer) and their vectors as columns; a value within rounding of zero is zero."""
    values, vectors = np.linalg.eigh(normalised_laplacian(n, i, j, w)) if n <= MOST_NODES else sparse_lowest(n, i, j, w, k)
    return np.where(np.abs(values[: k + 1]) < 1e-12, 0.0, values[: k + 1]), vectors[:, : k + 1]


def decompose(edges: DataFrame, k: int = 8, least: int = 4) -> DataFrame:
    """component, rank (from 1), value, id and x: of each weak component of at least so many nodes its smallest eigenvalues but the first, with their vectors."""
    weights = edges.where("source <> target AND kind <> 'defines'").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").cast("double").alias("w"))
    own = weights.join(connected(edges).select(F.col("id").alias("a"), "component"), "a")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        names, i, j, w = numbers(part)
        if len(names) < least:
            return pd.DataFrame({"component": pd.Series(dtype=object), "rank": pd.Series(dtype=int), "value": pd.Series(dtype=float), "id": pd.Series(dtype=object), "x": pd.Series(dtype=float)})
        many = min(k, len(names) - 1)
        values, vectors = lowest(len(names), i, j, w, many)
        return pd.DataFrame({"component": part["component"].iloc[0], "rank": np.repeat(np.arange(1, many + 1), len(names)), "value": np.repeat(values[1 : many + 1], len(names)), "id": names * many, "x": vectors[:, 1 : many + 1].T.ravel()})

    return own.groupBy("component").applyInPandas(solve, "component string, rank long, value double, id string, x double")


def laplacian_values(edges: DataFrame, k: int = 4) -> DataFrame:
    """For each component of four nodes or more: its k smallest eigenvalues but the first, of the normalised Laplacian."""
    return decompose(edges, k).select("component", "rank", "value").distinct()


def eigengap(values: DataFrame) -> DataFrame:
    """values: component, rank and value. component and k: after which value the widest gap is, of equal ones the last; two at least."""
    gaps = values.withColumn("gap", F.lead("value").over(Window.partitionBy("component").orderBy("rank")) - F.col("value"))
    return gaps.where("gap IS NOT NULL").groupBy("component").agg(F.greatest(F.max_by("rank", F.struct("gap", "rank")) + 1, F.lit(2)).alias("k"))


def fingerprints(edges: DataFrame, k: int = 8) -> DataFrame:
    """id, vector and values of length k: a node's places in its component's vectors, and their values, padded with zeros."""
    rows = decompose(edges, k).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "value"))).alias("r"))
    padded = lambda f: F.slice(F.concat(F.transform("r", lambda e: e[f]), F.array_repeat(F.lit(0.0), k)), 1, k)
    return rows.select("id", padded("x").alias("vector"), padded("value").alias("values"))


def part_fiedler(links: DataFrame, least: int) -> DataFrame:
    """links: part, a, b and w. Of each part of so many nodes its second smallest value, and on which side of zero each node is."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        names, i, j, w = numbers(group)
        if len(names) < least:
            return pd.DataFrame({"part": pd.Series(dtype=object), "value": pd.Series(dtype=float), "id": pd.Series(dtype=object), "side": pd.Series(dtype=int)})
        values, vectors = lowest(len(names), i, j, w, 1)
        return pd.DataFrame({"part": [group["part"].iloc[0]] * len(names), "value": values[1], "id": names, "side": np.where(vectors[:, 1] >= 0, 1, -1)})

    return links.groupBy("part").applyInPandas(solve, "part string, value double, id string, side int")


def module_fiedler(edges: DataFrame, assign: DataFrame, least: int = 5) -> DataFrame:
    """module, size, value, id and side, for modules of at least so many nodes. Nodes without an edge inside have a weight of zero, on the diagonal."""
    fine = edges.where("source <> target AND kind <> 'defines'")
    a, b = assign.select(F.col("id").alias("source"), F.col("module").alias("part")), assign.select(F.col("id").alias("target"), F.col("module").alias("other"))
    inside = fine.join(a, "source").join(b, "target").where("part = other").groupBy("part", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").cast("double").alias("w"))
    alone = assign.select(F.col("module").alias("part"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))
    sizes = assign.groupBy("module").agg(F.count("*").alias("size"))
    return part_fiedler(inside.unionByName(alone), least).withColumnRenamed("part", "module").join(sizes, "module").select("module", "size", "value", "id", "side")


def random_fiedler(nodes: DataFrame, edges: DataFrame, assign: DataFrame, draws: int = 50) -> DataFrame:
    """value: the same of random parts of all nodes, of the modules' median size, drawn by hashes."""
    size = assign.groupBy("module").count().where("count >= 5").agg(F.percentile_approx("count", 0.5).alias("size"))
    share = size.join(nodes.agg(F.count_distinct("id").alias("n"))).select((F.col("size") / F.col("n")).alias("share"))
    drawn = nodes.select("id").distinct().join(share).withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(draws)))).where((F.pmod(F.xxhash64("id", "part"), F.lit(1 << 20)) / (1 << 20)) < F.col("share"))
    own = drawn.select("id", F.col("part").cast("string").alias("module"))
    return module_fiedler(edges, own, 2).select("module", "value").distinct().select("value")


ROWS = 4096
"""So many vectors at a time are held against all centroids."""


def centers_of(data: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """The mean of each cluster; an empty cluster's is zero."""
    total = np.zeros((k, data.shape[1]))
    for at in range(0, len(data), ROWS):
        part, own = data[at : at + ROWS], labels[at : at + ROWS]
        for c in np.unique(own):
            total[c] = np.add.reduce(np.concatenate([total[c][None, :], part[own == c]]), 0)
    return total / np.maximum(np.bincount(labels, minlength=k), 1)[:, None]


def squares(data: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows and their squared distances to all centroids, some rows at a time."""
    for at in range(0, len(data), ROWS):
        rows = slice(at, at + ROWS)
        yield rows, ((data[rows, None, :] - centroids[None, :, :]) ** 2).sum(2)


def kmeans(data: np.ndarray, k: int, seed: int, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centroids: seeds by squared distance, labels start at 0, ties to the lower label, an empty cluster's centroid is zero."""
    random = Xorshift(seed)
    chosen = [random.below(len(data))]
    near = np.full(len(data), np.inf)
    while len(chosen) < min(k, len(data)):
        for rows, d in squares(data, data[chosen[-1:]]):
            near[rows] = np.minimum(near[rows], d[:, 0])
        chosen.append(random.weighted(near))
    centroids, labels = data[chosen].copy(), np.zeros(len(data), int)
    for _ in range(steps):
        new = np.concatenate([d.argmin(1) for _, d in squares(data, centroids)])
        if (new == labels).all():
            break
        labels = new
        centroids = centers_of(data, labels, len(centroids))
    return labels, centroids


def silhouette(data: np.ndarray, labels: np.ndarray, centroids: np.ndarray) -> float:
    """(b - a) / max(a, b) with distances to centroids, averaged."""
    if len(centroids) < 2 or not len(data):
        return 0.0
    each = np.zeros(len(data))
    for rows, d in squares(data, centroids):
        d = np.sqrt(d)
        at = np.arange(len(d)), labels[rows]
        a = d[at]
        d[at] = np.inf
        b = d.min(1)
        top = np.maximum(a, b)
        each[rows] = np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0)
    return float(each.mean())


def period_sample(rows: DataFrame, key: str, day: str, days: int) -> DataFrame:
    """Greedy per key: a row is kept if so many days have passed since the last kept one; the last row always is."""

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(day).reset_index(drop=True)
        kept, last = [], None
        for i, d in enumerate(pd.to_datetime(part[day])):
            if last is None or (d - last).days >= days or i == len(part) - 1:
                kept.append(i)
                last = d
        return part.iloc[kept]

    return rows.groupBy(key).applyInPandas(pick, rows.schema)
