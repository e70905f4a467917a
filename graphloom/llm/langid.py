"""Language identification by cross-parsing entropy.

A suffix automaton holds every substring of a language's training words. A text is
cross-parsed against it: from where the last phrase ended, the longest substring
that the automaton knows is the next phrase. Text of the language itself falls into
few long phrases, other text into many short ones. A phrase costs the bits of a
pointer into the training text; costs are divided by the text's length, and the
language with the fewest normalised phrases wins.

Phrases end at word borders, so a word's phrases depend on the word alone and are
counted once for each distinct word that a worker meets; texts are parsed whole.

Training is bounded: per language at most ``train_docs`` labelled documents, chosen
by a hash of their text, of each ``doc_chars`` characters, and at most ``train_chars`` characters of distinct words,
the most frequent first. Everything else covers all rows.

Defined results: a null text, and a text without a letter, is ``und`` with score 0;
languages that tie go to the alphabetically first; with no labelled row every text
is ``und``. Extra columns pass through, but those named like results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import bounded_sample, give_back

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    """All substrings of the words given, which a mark parts."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.longest = [0]
        for word in words:
            last = 0
            for c in word:
                last = self._add(last, c)

    def _state(self, longest: int, follow: dict[str, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: str) -> int:
        """The state for what p followed by c spells, apart from q's longer strings."""
        if self.longest[q] == self.longest[p] + 1:
            return q
        copy = self._state(self.longest[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, c: str) -> int:
        if (q := self.next[last].get(c)) is not None:
            return self._split(last, q, c)
        new, p = self._state(self.longest[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def table(self, alphabet: dict[str, int]) -> np.ndarray:
        """By state and place of a character in the alphabet: the next state, or -1. Place 0 is any other character."""
        out = np.full((len(self.next), len(alphabet) + 1), -1, np.int32)
        for state, follow in enumerate(self.next):
            for c, to in follow.items():
                out[state, alphabet[c]] = to
        return out


def phrases(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """In how many phrases each string is cross-parsed, all strings in step; a character unknown to the automaton is a phrase.

    codes: all characters' places in the alphabet, string after string; sizes: longest first.
    """
    count = np.zeros(len(starts), np.int64)
    state = np.zeros(len(starts), np.int32)
    live = len(starts)
    for at in range(int(sizes[0]) if live else 0):
        while sizes[live - 1] <= at:
            live -= 1
        c = codes[starts[:live] + at]
        to = table[state[:live], c]
        ended = np.flatnonzero(to < 0)
        if ended.size:
            count[ended] += state[ended] > 0  # a phrase of some length ends before this character
            again = table[0, c[ended]]
            count[ended] += again < 0
            to[ended] = np.maximum(again, 0)
        state[:live] = to
    return count + (state > 0)


@dataclass
class Model:
    """Languages in order, and each one's training words."""

    words: dict[str, list[str]]
    keep: int = 120_000
    tables: list[np.ndarray] | None = None
    index: dict[str, int] = field(default_factory=dict)
    counts: np.ndarray | None = None

    def __post_init__(self):
        self.langs = sorted(self.words)

    def _ready(self) -> None:
        if self.tables is None:
            marked = [[f" {w} " for w in self.words[lang]] for lang in self.langs]
            self.alphabet = {c: k + 1 for k, c in enumerate(sorted(set("".join(map("".join, marked)))))}
            self.points = np.array([0, *map(ord, self.alphabet)], np.uint32)
            self.tables = [SuffixAutomaton(ws).table(self.alphabet) for ws in marked]
            # bits of a pointer: more training text makes longer phrases, but dearer pointers
            self.bits = np.array([np.log2(2 + sum(map(len, ws))) for ws in marked])
            self._empty()

    def forget(self) -> None:
        """Give the memory back: a worker keeps what was broadcast to it for longer than a task."""
        self.tables, self.counts = None, None
        self.index = {}

    def _empty(self) -> None:
        self.index.clear()
        self.counts = np.zeros((0, len(self.langs)), np.int64)

    def _meet(self, words: list[str]) -> None:
        """Parse these new words, and remember their numbers of phrases."""
        words.sort(key=len, reverse=True)
        sizes = np.array([len(w) + 2 for w in words])
        points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.searchsorted(self.points, points).clip(max=len(self.points) - 1)
        codes = np.where(self.points[codes] == points, codes, 0)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        made = np.stack([phrases(t, codes, starts, sizes) for t in self.tables], 1)
        first = len(self.index)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        self.counts = np.concatenate([self.counts, made])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        self._ready()
        split = [LETTERS.findall(x.lower()) if x else [] for x in texts]
        sums = [np.zeros(len(self.langs), np.int64) for _ in texts]
        # whole texts, in pieces of bounded size
        piece: list[tuple[int, list[str]]] = []
        room = 200_000
        for k, words in enumerate(split):
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                piece.append((k, part))
                room -= len(part)
                if room <= 0:
                    self._count(piece, sums)
                    piece, room = [], 200_000
        self._count(piece, sums)
        for words, total in zip(split, sums, strict=True):
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            size = sum(map(len, words)) + 2 * len(words)
            cost = total * self.bits / size
            best = int(np.argmin(cost))
            rest = np.delete(cost, best)
            # a chance from the bits by which the winner is shorter, in pointers
            share = 1.0 / (1.0 + np.exp2(-np.clip((rest - cost[best]) * size / self.bits[best], 0, 60)).sum())
            out.append((self.langs[best], float(share)))
        return out

    def _count(self, piece: list[tuple[int, list[str]]], sums: list[np.ndarray]) -> None:
        fresh = set().union(*(part for _, part in piece))
        if len(fresh) + len(self.index) > self.keep:
            self._empty()
        if fresh := [w for w in fresh if w not in self.index]:
            self._meet(fresh)
        for k, part in piece:
            sums[k] += self.counts[list(map(self.index.__getitem__, part))].sum(0)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", train_docs: int = 300, train_chars: int = 40_000, doc_chars: int = 10_000) -> Model:
    """Fit on a bounded sample of labelled rows: train_docs different texts for each language, of each the words of doc_chars characters."""
    rows = labelled.where(F.col(text).rlike(r"\p{L}"))
    counts: dict[str, Counter] = {}
    for name, texts in bounded_sample(rows, lang, text, train_docs, doc_chars).items():
        own = counts[name] = Counter()
        for x in texts:
            own.update(LETTERS.findall(x.lower()))
    words = {}
    for name, found in counts.items():
        room, own = train_chars, []
        for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            room -= len(w) + 2
            if room < 0:
                break
            own.append(w)
        words[name] = own
    return Model(words)


RESULTS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score. One pass without a shuffle; the model is of bounded size."""
    keep = [c for c in df.columns if c not in RESULTS.names]
    place = keep.index(text)
    shared = df.sparkSession.sparkContext.broadcast(Model(model.words, model.keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = own.predict(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.float64())], names=[*keep, *RESULTS.names])
        own.forget()
        give_back()

    return df.select(*keep).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *RESULTS]))
