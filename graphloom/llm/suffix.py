"""Exact removal of repeated byte strings by a distributed merge sort of suffixes that never compares a known prefix again.

Sorting every suffix of a corpus would move hundreds of times its size, so suffixes
are thinned twice, without loss, before any is moved:

1. Of the ``length`` - ``GRAM`` + 1 grams inside each window of ``length`` bytes one is chosen by
   its hash, so equal windows choose the same one. Only suffixes at chosen grams, the
   anchors, stand for all windows. An anchor whose gram occurs once has no repeated
   window and goes; this needs only hashes.
2. The stretch of text that the windows of an anchor cover is hashed whole. Where it
   occurs twice, all its windows are repeated; of equal stretches one suffix is sorted.
   Stretches count as equal if both their hash and that of their gram are, 128 bits in all;
   their bytes are not compared again.

What is left is sorted: each map task sorts its suffixes and front-codes them (the
length of the prefix shared with the one before, and the rest), runs are dealt by
range of the gram's hash, and each range merges its runs with a loser tree whose
contenders carry how much of the last winner they share: longer shared prefixes win
without a look at any byte, and equal ones are compared from there on.

The merged order has the common prefix of each suffix with the next. With the common
suffixes of what stands before the anchors, that gives each anchor the windows it
shares with another: clusters are joined from the longest common prefix down, a member
of the smaller cluster looks up its neighbours by preceding text in the larger one,
and so no group of equal grams costs its square.

Defined results: matches never cross texts; null and empty texts have no bytes; strings
are judged on the input; a text takes some 80 bytes of memory for each of its bytes while it is
cut into anchors, so one of 20 MB takes 1.6 GB of a worker; repeated rows count as occurrences; texts shorter than ``length``
lose nothing. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import stored
from graphloom.llm.neardup import mix

LENGTH, GRAM = 400, 128
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
PLACE = np.uint64((1 << 31) - 1)


class Powers:
    """Powers of the base and its inverse, as far as a text needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, INVERSE))
        return self.up[: n + 1], self.down[: n + 1]


def anchors(data: bytes, powers: Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors' places, first and last window starts, hashes of grams and of the stretches that their windows cover."""
    n = len(data)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = powers.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTERS[np.frombuffer(data, np.uint8)] * up[:n], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    order = ((hashes >> np.uint64(31)) << np.uint64(31)) | np.arange(len(hashes), dtype=np.uint64)
    # least of each run of wide: prefixes and suffixes of minima within blocks of that size
    wide = length - gram + 1
    size = -(-len(order) // wide) * wide
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(order)] = order
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    chosen = (np.minimum(behind[:count], ahead[wide - 1 : wide - 1 + count]) & PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [count - 1]])
    at = chosen[first]
    stretch = mix((sums[last + length] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return at, first, last, hashes[at], stretch


def shared(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> list[tuple[int, bytes]]:
    """A sorted run: the prefix shared with the one before, and the rest."""
    out, before = [], b""
    for s in strings:
        k = shared(before, s)
        out.append((k, s[k:]))
        before = s
    return out


def merge_runs(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Front-coded sorted runs to one sorted sequence: string, prefix shared with the one before, payload.

    A loser tree. Each contender knows how long a prefix it shares with the last winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    known, loads = [0] * k, [None] * k

    def advance(i: int) -> None:
        item = next(runs[i], None) if i < len(runs) else None
        if item is None:
            heads[i] = None
        else:
            known[i], rest, loads[i] = item
            heads[i] = (heads[i][: known[i]] if known[i] else b"") + rest

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        at = known[a]
        k = at + shared(x[at:], y[at:])
        if x[k:] <= y[k:]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    for i in range(k):
        advance(i)
        known[i] = 0
    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while heads[winner] is not None:
        yield heads[winner], known[winner], loads[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def common_windows(rights: list[int], befores: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Suffixes in order, with the prefix each shares with the next, and the reversed text before each anchor.

    For each: intervals of how far before the anchor a window can start that another one has too.
    """
    size = len(befores)
    out: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    rank = sorted(range(size), key=befores.__getitem__)
    place = [0] * size
    for k, i in enumerate(rank):
        place[i] = k
    group = list(range(size))
    members: dict[int, list[int]] = {i: [place[i]] for i in range(size)}  # by cluster: places of preceding text, in order
    for i in sorted(range(size - 1), key=lambda i: -rights[i]):
        a, b = group[i], group[i + 1]
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, depth = members[a], length - rights[i]
        found = []
        for p in members[b]:
            at = bisect_left(large, p)
            for q in large[max(0, at - 1) : at + 1]:
                left = shared(befores[rank[p]], befores[rank[q]])
                if left >= depth:
                    found += [(p, left), (q, left)]
        for p, left in found:
            out[rank[p]].append((depth, left))
        for p in members.pop(b):
            large.insert(bisect_left(large, p), p)
            group[rank[p]] = a
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive spans, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            keys, hs, ts = [], [], []
            for key, x in zip(b.column(0), b.column(1), strict=True):
                data = x.as_buffer().to_pybytes()
                if len(data) >= length:
                    *_, h, t = anchors(data, powers, length, gram)
                    keys.append(key.as_py())
                    hs.append(h.view(np.int64))
                    ts.append(t.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hs, pa.list_(pa.int64())), pa.array(ts, pa.list_(pa.int64()))], names=["key", "h", "t"])

    return docs.select("key", "text").mapInArrow(run, "key binary, h array<long>, t array<long>")


def _runs(wanted: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """wanted: text and anchors (place in the order of anchors, hashes). Sorted front-coded runs, cut by range of the gram's hash."""
    width = (1 << 64) // parts + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[tuple[bytes, bytes, int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort()
            rows: dict[int, list] = {}
            for item in held:
                rows.setdefault(int.from_bytes(item[0][:8], "big") // width, []).append(item)
            for part, items in rows.items():
                coded = front_code([s for s, *_ in items])
                columns = [[k for k, _ in coded], [r for _, r in coded], [x[1] for x in items], [x[2] for x in items], [x[3] for x in items]]
                types = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([c], pa.list_(t)) for c, t in zip(columns, types, strict=True))], names=["part", "known", "rest", "before", "h", "t"])

        for b in batches:
            for x, marks in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = x.as_buffer().to_pybytes()
                at, first, last, h, t = anchors(data, powers, length, gram)
                for i in marks:
                    a = int(at[i])
                    suffix = int(h[i]).to_bytes(8, "big") + data[a : int(last[i]) + length]
                    before = data[int(first[i]) : a][::-1]
                    held.append((suffix, before, int(h[i].view(np.int64)), int(t[i].view(np.int64))))
                    size += len(suffix) + len(before) + 200
                if size > 96 << 20:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    schema = "part int, known array<int>, rest array<binary>, before array<binary>, h array<long>, t array<long>"
    return wanted.select("text", "marks").mapInArrow(run, schema)


def _merged(runs: DataFrame, length: int) -> DataFrame:
    """For each sorted suffix (by its two hashes): intervals of repeated windows, as starts before the anchor."""

    def meet(table: pa.Table) -> pa.Table:
        def items(k: int) -> Iterator[tuple[int, bytes, object]]:
            columns = [table.column(c)[k].values for c in ("known", "rest", "before", "h", "t")]
            for j in range(len(columns[0])):
                yield columns[0][j].as_py(), columns[1][j].as_py(), (columns[2][j].as_py(), columns[3][j].as_py(), columns[4][j].as_py())

        hs, ts, spans = [], [], []

        def settle() -> None:
            if len(group) > 1:
                for (_, h, t), found in zip(group, common_windows(rights, [g[0] for g in group], length), strict=True):
                    if found:
                        hs.append(h)
                        ts.append(t)
                        spans.append([{"near": s, "far": e} for s, e in union(found)])

        group: list = []
        rights: list[int] = []
        for _, known, load in merge_runs([items(k) for k in range(table.num_rows)]):
            if group and known >= 8 and load[1] == group[-1][1]:
                rights.append(known - 8)
            else:
                settle()
                group, rights = [], []
            group.append(load)
        settle()
        return pa.table({"h": pa.array(hs, pa.int64()), "t": pa.array(ts, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("near", pa.int32()), ("far", pa.int32())])))})

    return runs.groupBy("part").applyInArrow(meet, "h long, t long, spans array<struct<near:int,far:int>>")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part_rows: int = 20_000) -> DataFrame:
    """docs: key and text. For each key with a repeated window: marks, the anchors' places in their order and the windows that are repeated."""
    found = stored(_anchors(docs, length, gram), "anchors")
    each = found.select("key", F.posexplode(F.arrays_zip("h", "t")).alias("i", "x")).select("key", "i", "x.h", "x.t")
    often = each.groupBy("h").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).where("n > 1").select("h", (F.col("low") != F.col("high")).alias("mixed"))
    left = stored(each.join(often, "h"), "candidates")
    # one row for each different stretch of a gram, and whether it occurs twice
    kinds = left.groupBy("h", "t").agg(F.count("*").alias("n"), F.min(F.struct("key", "i")).alias("first"), F.max("mixed").alias("mixed"))
    kinds = stored(kinds, "stretches")
    sorted_ones = kinds.where("mixed")
    parts = max(1, -(-sorted_ones.count() // part_rows))
    wanted = sorted_ones.groupBy("first.key").agg(F.collect_list("first.i").alias("marks"))
    runs = _runs(docs.join(wanted, "key"), parts, length, gram)
    spans = stored(_merged(runs, length), "merged")
    whole = kinds.where("n > 1").select("h", "t", F.lit(True).alias("whole"))
    partly = spans.join(whole, ["h", "t"], "left_anti").select("h", "t", F.lit(False).alias("whole"), "spans")
    decided = whole.withColumn("spans", F.lit(None).cast("array<struct<near:int,far:int>>")).unionByName(partly)
    marks = left.select("key", "i", "h", "t").join(decided, ["h", "t"])
    return marks.select("key", F.struct("i", "whole", "spans").alias("m")).groupBy("key").agg(F.collect_set("m").alias("marks"))


def remove(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the bytes that are left."""
    own = keyed(docs, text)
    marks = repeated(own.select("key", "text"), length, gram)
    joined = own.join(marks, "key", "left").select("doc_id", "text", "marks")
    id_type = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                rows = []
                for x, marks_here in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    data = x.as_buffer().to_pybytes() if x.is_valid else b""
                    gone: list[tuple[int, int]] = []
                    if marks_here:
                        at, first, last, *_ = anchors(data, powers, length, gram)
                        for m in marks_here:
                            i = m["i"]
                            if m["whole"]:
                                gone.append((int(first[i]), int(last[i]) + length - 1))
                            else:
                                for s in m["spans"]:
                                    low, high = max(int(at[i]) - s["far"], int(first[i])), min(int(at[i]) - s["near"], int(last[i]))
                                    if low <= high:
                                        gone.append((low, high + length - 1))
                        gone = union(gone)
                    kept, done = [], 0
                    for s, e in gone:
                        kept.append(data[done:s])
                        done = e + 1
                    left = b"".join(kept) + data[done:] if gone else data
                    rows.append((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left))
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made[: 4 + with_text]], names=["doc_id", *RESULTS.names[: 4 + with_text]])

    return joined.mapInArrow(run, T.StructType([id_type, *RESULTS.fields[: 4 + with_text]]))


RESULTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])
