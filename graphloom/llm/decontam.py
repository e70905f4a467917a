"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded stretch of documents. Its words, as numbers, are one text; its
suffixes are sorted, and what stands before each suffix is kept in a wavelet tree.
Backward search takes every benchmark window, all windows of a block in step, through
the tree's ranks to the interval of suffixes that begin with it; each occurrence is
then followed back to the nearest suffix whose position was sampled. Occurrences in a
document merge into removal spans.

Only stretches that could hold a window are indexed: words that no benchmark window
has, and pairs of neighbouring words that none has, part the text, and stretches
shorter than the shortest window are left out. That loses no occurrence.

The benchmark is split into blocks of bounded size, each sent to the tasks apart and
searched in a pass of its own; there is no shuffle at all, so hot documents, copies
and sources cost no more than their length.

Words are what ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` finds once A-Z are lower case. A window is
``width`` consecutive words of an item; an item of fewer words, but not none, is one
window. Windows never cross documents.

Defined results: a null or empty text has no words, spans or items; an item that is
null or has no word has no window; items with one id count once; a null item_id names
no item, but its windows count for the spans. Extra columns pass through, but those
named like results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import give_back, spare

WIDTH = 13
SEPARATORS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words, as UTF-8. All separators are single bytes, so bytes can be split."""
    return text.encode("utf-8", "surrogatepass").translate(SEPARATORS).split(b" ") if text else []


class Block:
    """Some benchmark items: their vocabulary, the different windows as numbers, whose they are, and which pairs of words they have."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.vocab: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        windows: dict[tuple[int, ...], set[int]] = {}
        for k, (_, ws) in enumerate(items):
            codes = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]
            for at in range(max(1, len(codes) - width + 1)):
                windows.setdefault(tuple(codes[at : at + width]), set()).add(k)
        rows, sizes = list(windows), list(map(len, windows))
        # owners of window i: from firsts[i] to firsts[i + 1]
        self.firsts = np.cumsum([0, *map(len, windows.values())])
        self.owners = np.array([k for own in windows.values() for k in sorted(own)], np.int64)
        self.width, self.windows = width, np.zeros((len(rows), width), np.int64)
        for row, codes in zip(self.windows, rows, strict=True):
            row[width - len(codes) :] = codes  # right-aligned, as the search goes backward
        self.sizes = np.array(sizes, np.int64)
        self.base = len(self.vocab) + 1
        pairs = {a * self.base + b for codes in rows for a, b in zip(codes, codes[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.least = int(self.sizes.min()) if rows else 1


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector for each bit, most significant first, with running counts."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        now = sequence
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start, end = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            s, e = self.ones[k][start], self.ones[k][end]
            start = np.where(one, self.zeros[k] + s, start - s)
            end = np.where(one, self.zeros[k] + e, end - e)
        return end - start


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array by doubling. Each 0 is a symbol of its own, so suffixes differ within their stretch."""
    ends = np.flatnonzero(text == 0)
    rank = text + len(ends)
    rank[ends] = np.arange(len(ends))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    size, step = len(text), 1
    while True:
        key = rank * (size + 1)
        key[: size - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(size, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if new[order[-1]] == size - 1:
            return order
        rank, step = new, step * 2
        if step >= size:
            return order


class FMIndex:
    """text: numbers from 1, each stretch ended by a 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        suffixes = sort_suffixes(text)
        before = text[suffixes - 1]  # the text ends with 0, which stands before the first
        self.tree = WaveletTree(before, max(1, int(symbols).bit_length()))
        self.before = before
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        # sampled: every eighth position, and where a stretch begins, so that no walk leaves it
        self.sampled = (suffixes % sample == 0) | (before == 0)
        self.places = np.cumsum(self.sampled) - 1
        self.positions = suffixes[self.sampled]
        self.size = len(text)

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern, right-aligned, the interval of suffixes that begin with it."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((sizes >= patterns.shape[1] - k) & (low < high))
            if not live.size:
                break
            c = patterns[live, k]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, by steps back to a sampled one."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while left.size:
            now = rows[left]
            done = self.sampled[now]
            out[left[done]] = self.positions[self.places[now[done]]] + steps
            left, now = left[~done], now[~done]
            c = self.before[now]
            rows[left] = self.first[c] + self.tree.rank(c, now)
            steps += 1
        return out


class Shard:
    """Documents of a bounded number of words, then their spans and items."""

    def __init__(self, block: Block):
        self.block = block
        self.stretches: list[np.ndarray] = []
        self.origins: list[tuple[int, int]] = []  # document and first word of each stretch
        self.held = 0

    def add(self, doc: int, ws: list[bytes]) -> None:
        block = self.block
        codes = np.fromiter(map(block.vocab.get, ws, zeros(len(ws))), np.int64, len(ws))
        known = codes > 0
        if not known.any():
            return
        # word i and i+1 belong together if both are known and some window has the pair
        key = codes[:-1] * block.base + codes[1:]
        if block.pairs.size:
            near = block.pairs[np.searchsorted(block.pairs, key).clip(max=block.pairs.size - 1)] == key
        else:
            near = np.zeros(len(key), bool)
        near &= known[:-1] & known[1:]
        edge = np.flatnonzero(~near)
        starts, ends = np.concatenate([[0], edge + 1]), np.concatenate([edge + 1, [len(codes)]])
        for s, e in zip(*(x[(ends - starts >= block.least) & known[starts]] for x in (starts, ends)), strict=True):
            self.stretches.append(codes[s:e])
            self.origins.append((doc, int(s)))
            self.held += int(e - s) + 1

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, first words and sizes of all occurrences, and the windows that occur."""
        empty = np.zeros(0, np.int64)
        if not self.stretches or not len(self.block.windows):
            return empty, empty, empty, empty
        zero = np.zeros(1, np.int64)
        text = np.concatenate([x for s in self.stretches for x in (s, zero)])
        index = FMIndex(text, self.block.base)
        low, high = index.search(self.block.windows, self.block.sizes)
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        at = index.locate(rows)
        first = np.cumsum([0, *(len(s) + 1 for s in self.stretches)])[:-1]
        which = np.searchsorted(first, at, side="right") - 1
        origin = np.array(self.origins, np.int64)
        return origin[which, 0], origin[which, 1] + at - first[which], self.block.sizes[window], window


def zeros(n: int) -> Iterator[int]:
    from itertools import repeat

    return repeat(0, n)


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(s[1:] > e[:-1])
    return list(zip(s[np.concatenate([[0], cut + 1])].tolist(), e[np.concatenate([cut, [len(e) - 1]])].tolist(), strict=True))


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RESULTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])
ARROW = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]


def blocks(benchmark: DataFrame, text: str, item_id: str, width: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark, item after item from the executors, in blocks of at most block_bytes of text (or one item)."""
    items: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in benchmark.select(benchmark[item_id].cast("string").alias("i"), benchmark[text].alias("t")).toLocalIterator():
        found = [w for w in words(row["t"]) if w]
        if not found:
            continue
        if items and size + len(row["t"]) > block_bytes:
            yield Block(items, width)
            items, size = [], 0
        items.append((row["i"], found))
        size += len(row["t"])
    if items:
        yield Block(items, width)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", width: int = WIDTH, shard_words: int = 1_000_000, block_bytes: int = 8 << 20) -> DataFrame:
    """Add n_words, the merged spans of words that benchmark windows cover, and the sorted ids of the items that occur."""
    context = docs.sparkSession.sparkContext
    out = docs.drop(*RESULTS.names)
    made = list(blocks(benchmark, item_text, item_id, width, block_bytes)) or [Block([], width)]
    for block in made:
        out = _search(out, context.broadcast(block), text, shard_words)
    return out


def _search(docs: DataFrame, shared, text: str, shard_words: int) -> DataFrame:
    """One block's pass: what earlier passes found is in the columns of results and grows."""
    later = "spans" in docs.columns
    keep = [c for c in docs.columns if c not in RESULTS.names]
    order = [*keep, *RESULTS.names] if later else keep
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value

        def results(parts: list[pa.RecordBatch], counts: list[int], shard: Shard) -> Iterator[pa.RecordBatch]:
            doc, start, size, window = shard.spans()
            by = np.argsort(doc, kind="stable")
            doc, start, size, window = doc[by], start[by], size[by], window[by]
            edges = np.searchsorted(doc, np.arange(len(counts) + 1))
            at = 0
            for part in parts:
                spans, items = [], []
                old = (part.column(len(keep) + 1).to_pylist(), part.column(len(keep) + 2).to_pylist()) if later else None
                for k in range(part.num_rows):
                    s, e = edges[at + k], edges[at + k + 1]
                    first, last = start[s:e], start[s:e] + size[s:e]
                    names = {block.ids[i] for w in np.unique(window[s:e]).tolist() for i in block.owners[block.firsts[w] : block.firsts[w + 1]].tolist()} - {None}
                    if old:
                        first = np.concatenate([first, np.array([x["start"] for x in old[0][k]], np.int64)])
                        last = np.concatenate([last, np.array([x["end"] for x in old[0][k]], np.int64)])
                        names |= set(old[1][k])
                    spans.append([{"start": a, "end": b} for a, b in merge(first, last)])
                    items.append(sorted(names))
                made = [counts[at : at + part.num_rows], spans, items]
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(made, ARROW, strict=True))], names=[*keep, *RESULTS.names])

        parts, counts, shard, passed = [], [], Shard(block), 0
        for b in batches:
            for begin in range(0, b.num_rows, 256):
                part = b.slice(begin, 256)
                for x in part.column(place).to_pylist():
                    ws = [w for w in words(x) if w]
                    if ws:
                        shard.add(len(counts), ws)
                    counts.append(len(ws))
                parts.append(part)
                passed += part.nbytes
                if shard.held >= shard_words or passed >= 32 << 20:
                    yield from results(parts, counts, shard)
                    parts, counts, shard, passed = [], [], Shard(block), 0
        if parts:
            yield from results(parts, counts, shard)
        give_back()

    return docs.select(*order).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *RESULTS]))


WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of words, from the first letter of each span to the last."""
    places = [m.span() for m in WORD.finditer(text)]
    pieces, done = [], 0
    for start, end in spans:
        pieces.append(text[done : places[start][0]])
        done = places[end - 1][1]
    return "".join(pieces) + text[done:]


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without the spans of benchmark windows; a document of which no word is left goes, one that had none stays. All columns stay, also those named like find's results."""
    names = list(docs.columns)
    own = {c: spare([*names, *RESULTS.names], f"own_{c}") if c in RESULTS.names else c for c in names}
    keep = [own[c] for c in names]
    found = find(docs.select(*(F.col(f"`{c}`").alias(own[c]) for c in names)), benchmark, own[text], **options)
    place = found.columns.index(own[text])
    at = {c: found.columns.index(c) for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, spans = b.column(b.num_columns - 3).to_pylist(), b.column(b.num_columns - 2).to_pylist()
            texts = b.column(place).to_pylist()
            stay = []
            for k, found_here in enumerate(spans):
                gone = sum(s["end"] - s["start"] for s in found_here)
                stay.append(gone == 0 or gone < count[k])
                if gone and stay[-1]:
                    texts[k] = cut_out(texts[k], [(s["start"], s["end"]) for s in found_here])
            columns = [pa.array(texts, pa.string()) if at[c] == place else b.column(at[c]) for c in keep]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    return found.mapInArrow(run, T.StructType([docs.schema[c] for c in names]))
