"""Approximate nearest neighbours by shifted space-filling curves.

Several Hilbert curves order the vectors, each through a projection and a shift of its
own, fitted on a bounded sample. Splitters of the sample's keys cut a curve into ranges,
and rows are dealt by range in Spark. A query meets the ranges within a window around
its own key on each curve; what the windows of all curves find is merged and ranked by
the exact inner product of the original vectors.

How many curves and how wide a window is measured, not set: the true neighbours of a
bounded sample of queries, from one pass over all rows, show which share of them each
choice would meet, and the cheapest that meets ``target`` is taken. Vectors without any
structure (all directions alike) leave only the window of all ranges, which is a scan of
the query set against all rows in blocks, and exact.

Ranges that hold many rows, such as one vector that a third of all rows have, are dealt
to several tasks by row, and so are queries; no task holds more than some ten thousand of
either, and no candidate is dropped.

Defined results: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; a query does not meet rows of its own id;
repeated rows of one id count once for a query, with their best score; ties go to the
smaller vec_id; fewer candidates than k give all of them; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored

AXES, BITS = 6, 8


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Each row of whole numbers below 2**bits, as its place on the Hilbert curve (the transpose method, all rows in step)."""
    x = points.astype(np.uint64).T.copy()
    axes = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(axes):
            on = (x[i] & q) != 0
            t = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, t)
            x[i] ^= t
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> np.uint64(b)) & one != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


@dataclass
class Curves:
    """Projections, scales and shifts of the curves, and where their ranges are cut."""

    project: np.ndarray  # curves x dimensions x axes
    low: np.ndarray
    scale: np.ndarray
    cuts: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, curves: int, ranges: int, seed: int = 7) -> Curves:
        random = np.random.default_rng(seed)
        size = sample.shape[1]
        axes = min(AXES, size)
        project = np.stack([np.linalg.qr(random.normal(size=(size, axes)))[0] for _ in range(curves)])
        low, scale = np.empty((curves, axes)), np.empty((curves, axes))
        for c in range(curves):
            y = sample @ project[c]
            width = np.maximum(y.max(0) - y.min(0), 1e-9) * 1.5
            low[c] = y.min(0) - width * (0.05 + 0.25 * random.random(axes))  # the shift
            scale[c] = (1 << BITS) / width
        out = cls(project, low, scale, [])
        out.cuts = [np.unique(np.quantile(k, np.arange(1, ranges) / ranges, method="lower")) for k in out.keys(sample)] if len(sample) else [np.zeros(0)] * curves
        return out

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [hilbert(((vectors @ self.project[c] - self.low[c]) * self.scale[c]).clip(0, (1 << BITS) - 1), BITS) for c in range(len(self.project))]

    def ranges(self, vectors: np.ndarray) -> np.ndarray:
        """Rows x curves."""
        return np.stack([np.searchsorted(cut, k, side="right") for cut, k in zip(self.cuts, self.keys(vectors), strict=True)], 1)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def first_of_each(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """order without the places whose id came before."""
    return order[np.sort(np.unique(ids[order], return_index=True)[1])]


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best k ids among these rows, each by its best row: place of the query, places of the rows and exact scores."""
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], ids[by_id][1:] != ids[by_id][:-1]])) if len(ids) else np.zeros(0, np.int64)
    for start in range(0, len(queries), 64):
        part = queries[start : start + 64]
        scores = part @ vectors.T
        scores[query_ids[start : start + 64, None] == ids[None, :]] = -np.inf
        if len(starts) > k:
            tops = scores if len(starts) == len(ids) else np.maximum.reduceat(scores[:, by_id], starts, axis=1)
            floor = np.partition(tops, len(starts) - k, axis=1)[:, len(starts) - k]
        else:
            floor = np.full(len(part), -np.inf)
        for j in range(len(part)):
            at = np.flatnonzero((scores[j] >= floor[j] - 1e-9 * (1 + abs(floor[j]))) & (scores[j] > -np.inf)) if np.isfinite(floor[j]) else np.flatnonzero(scores[j] > -np.inf)
            exact = (vectors[at] * part[j]).sum(1)  # summed alike wherever a row stands, so equal vectors tie
            order = first_of_each(ids[at], np.lexsort((ids[at], -exact)))[:k]
            yield start + j, at[order], exact[order]


def valid(df: DataFrame, vector: str) -> DataFrame:
    """Rows that take part, with components as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.col(vector).isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.withColumn("v", v).where(fine)


def search(df: DataFrame, is_query: str, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", curves: int = 8, ranges: int | None = None, target: float = 0.95, sample_rows: int = 20_000, sample_queries: int = 200) -> DataFrame:
    """Each query's k nearest: query_id, rank, vec_id and score. is_query: a condition on the rows that are queries too."""
    rows = valid(df.where(F.col(vec_id).isNotNull()), vector).select(F.col(vec_id).cast("long").alias("id"), "v", F.expr(is_query).alias("asks"))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return df.sparkSession.createDataFrame([], schema)
    size, total = sizes["size"], sizes["count"]
    rows = rows.where(F.size("v") == size)
    ranges = ranges or int(min(4096, max(8, total // 20_000)))
    share = min(1.0, sample_rows / total * 1.2)
    # the sample is one of hashes, so that it is the same at each run
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    drawn = rows.where(mark < int(share * (1 << 20)) + 1).select("v").limit(sample_rows).toArrow()
    model = Curves.fit(matrix(drawn.column(0).combine_chunks(), size), curves, ranges)
    asks = min(1.0, 1.3 * sample_queries * 20 / total)
    probes = rows.where(F.col("asks") & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < int(asks * (1 << 20)) + 1)).select("id", "v").limit(sample_queries).toArrow()
    spark = df.sparkSession
    count, window = _measure(rows, model, matrix(probes.column(1).combine_chunks(), size), probes.column(0).to_numpy(), size, k, target) if probes.num_rows else (1, 0)
    return _search(spark, rows, model, count, window, size, k)


def _measure(rows: DataFrame, model: Curves, probes: np.ndarray, probe_ids: np.ndarray, size: int, k: int, target: float) -> tuple[int, int]:
    """How many curves and ranges to each side meet the target share of the probes' true neighbours at the least cost."""
    shared = rows.sparkSession.sparkContext.broadcast((model, probes, probe_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, ids = shared.value
        kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(own.project)), np.int64))] * len(q)
        for b in batches:
            vectors = matrix(b.column(1), size)
            there = b.column(0).to_numpy()
            places = own.ranges(vectors)
            for j, found, scores in best(q, ids, vectors, there, k):
                old = kept[j]
                i, s = np.concatenate([old[0], there[found]]), np.concatenate([old[1], scores])
                p = np.concatenate([old[2], places[found]])
                order = first_of_each(i, np.lexsort((i, -s)))[:k]
                kept[j] = (i[order], s[order], p[order])
        out = [(j, int(i), float(s), p.tolist()) for j, (ids_, ss, ps) in enumerate(kept) for i, s, p in zip(ids_, ss, ps, strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int64())), strict=True)], names=["j", "id", "score", "places"])

    near = rows.select("id", "v").mapInArrow(run, "j int, id long, score double, places array<long>")
    near = near.groupBy("j", "id").agg(F.max(F.struct("score", "places")).alias("m")).select("j", "id", "m.score", "m.places")
    top = near.groupBy("j").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "id", "places"))), 1, k).alias("top")).select("j", F.explode("top.places").alias("p")).collect()
    if not top:
        return 1, 0
    own = model.ranges(probes)
    apart = np.array([np.abs(own[r["j"]] - np.array(r["p"])) for r in top])
    widest = max(len(c) for c in model.cuts)
    cheapest = (widest + 1, 1, widest)
    for count in range(1, apart.shape[1] + 1):
        nearest = np.sort(apart[:, :count].min(1))
        window = int(nearest[min(len(nearest) - 1, int(np.ceil(target * len(nearest))) - 1)])
        cost = count * (2 * window + 1)
        if cost < cheapest[0]:
            cheapest = (cost, count, window)
    return cheapest[1], cheapest[2]


def _search(spark, rows: DataFrame, model: Curves, count: int, window: int, size: int, k: int, vectors_each: int = 32_768, queries_each: int = 4096) -> DataFrame:
    model = Curves(model.project[:count], model.low[:count], model.scale[:count], model.cuts[:count])
    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.ranges(matrix(b.column(1), size)).tolist(), pa.list_(pa.int64()))], names=["id", "v", "asks", "places"])

    placed = stored(rows.mapInArrow(place, "id long, v array<double>, asks boolean, places array<long>"), "placed")
    dealt = placed.select("id", "v", F.posexplode("places").alias("curve", "range"))
    ends = F.array(*[F.lit(len(c)) for c in model.cuts])
    asked = placed.where("asks").select("id", "v", F.posexplode("places").alias("curve", "at"))
    asked = asked.select("id", "v", "curve", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - window), F.least(ends[F.col("curve")], F.col("at") + window))).alias("range"))
    # how many parts each range is dealt to: a table of at most curves x ranges rows
    parts = dealt.groupBy("curve", "range").agg(F.ceil(F.count("*") / vectors_each).cast("int").alias("vs")).join(
        asked.groupBy("curve", "range").agg(F.ceil(F.count("*") / queries_each).cast("int").alias("qs")), ["curve", "range"])
    parts = F.broadcast(stored(parts, "parts"))
    mix = F.xxhash64("id", F.lit(3))
    v = dealt.join(parts, ["curve", "range"]).withColumn("vp", F.pmod(mix, F.col("vs"))).withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    q = asked.join(parts, ["curve", "range"]).withColumn("qp", F.pmod(mix, F.col("qs"))).withColumn("vp", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)))
    cell = ["curve", "range", "vp", "qp"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked_ids = left.column("id").to_numpy(), right.column("q_id").to_numpy()
        vectors, queries = matrix(left.column("v").combine_chunks(), size), matrix(right.column("q_v").combine_chunks(), size)
        out: list[tuple] = []
        if len(ids) and len(asked_ids):
            for j, found, scores in best(queries, asked_ids, vectors, ids, k):
                out += [(int(asked_ids[j]), int(i), float(s)) for i, s in zip(ids[found], scores, strict=True)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    # both sides' keys need one type, or equal keys would be dealt to different tasks
    v = v.select(*(F.col(c).cast("long").alias(c) for c in cell), "id", "v")
    q = q.select(*(F.col(c).cast("long").alias(f"q_{c}") for c in cell), F.col("id").alias("q_id"), F.col("v").alias("q_v"))
    found = v.groupBy(*cell).cogroup(q.groupBy(*(f"q_{c}" for c in cell))).applyInArrow(meet, "query_id long, vec_id long, score double")
    one = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("minus"), "vec_id")))
    top = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.slice(one, 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
