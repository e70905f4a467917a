"""Toxicity by compression distance.

Two zstandard dictionaries are made, one of toxic and one of ordinary text, as raw content and
not by the library's trainer, whose segments of running text do not tell the two apart (see
README for figures). Both
hold the same ordinary words, so that ordinary text compresses alike; the toxic one
also holds the beginnings of words, and whole words, that mark toxic text. A window
that compresses to fewer bytes with the toxic dictionary leans toxic. A logistic
curve over a document's widest margins is the calibrated threshold.

Only text is an input of a score; labels only choose which sample a text is in.
Training is bounded: ``train_docs`` different texts for each label, of each
``doc_chars`` characters: a bound on the sample, which longer documents reach with their beginnings.
Scoring takes every text whole.

Defined results: null and empty texts have no windows and get the score of a text
without a toxic word; without labels of both kinds every score is 0. Extra columns
pass through, but those named like results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import least_hashes, texts_of

WORD = re.compile(r"[^\W\d_]+")
WIDE = 48
WINDOW = re.compile(r"\s*(\S.{0,%d}(?=\s|\Z)|\S{1,%d})" % (WIDE - 1, WIDE), re.S)
"""At most so many characters, of whole words where they fit."""


def grams(word: str) -> list[str]:
    """The beginnings of a word, and all of it, as they stand after a space."""
    return [*(f" {word[:n]}" for n in range(4, min(len(word), 11))), f" {word} "]


class Pair:
    """Compressors with the two dictionaries. A window's margin is how many bytes the toxic one saves."""

    def __init__(self, ordinary: bytes, toxic: bytes, level: int):
        form = zstandard.ZstdCompressionParameters.from_level(level, source_size=128, dict_size=len(toxic), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        made = []
        for content in (ordinary, toxic):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=form)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=form).compress)
        self.ordinary, self.toxic = made


class Model:
    """Dictionaries' contents and the calibrated curve. Small, and sent to every task as it is."""

    def __init__(self, common: list[str], marks: list[str]):
        self.common, self.marks = common, marks
        self.weights = np.zeros(6)
        self.blank = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pair"}

    def features(self, text: str | None) -> list[float]:
        """1; the two widest margins of windows; how many windows save a byte, and two bytes; how many windows there are to err in."""
        if not hasattr(self, "pair"):
            usual = (" " + " ".join(self.common) + " ").encode()
            self.pair = Pair(usual, "".join(self.marks).encode() + usual, 6)
        ordinary, toxic, found, windows = self.pair.ordinary, self.pair.toxic, [0, 0], 0
        for w in WINDOW.findall(text.lower()) if text else ():
            windows += 1
            w = f" {w} ".encode("utf-8", "replace")
            if (m := len(ordinary(w)) - len(toxic(w))) > 0:
                found.append(m)
        found.sort(reverse=True)
        strong = sum(m >= 2 for m in found)
        return [1.0, min(found[0], 8) / 4, min(found[1], 8) / 4, float(np.log1p(len(found) - 2)), float(np.log1p(strong)), float(np.log1p(windows)) / 4]

    def score(self, text: str | None) -> float:
        if self.blank:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.features(text)), -35, 35))))


def chance(n: int, of: int, share: float) -> float:
    """How likely at least n of so many texts that have a string are toxic, if it is as frequent in both kinds."""
    return sum(math.exp(math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) + k * math.log(share) + (of - k) * math.log1p(-share)) for k in range(n, of + 1))


def choose_marks(toxic: list[str], ordinary: list[str], least: float = 0.02, lift: float = 8.0, wrong: float = 0.05) -> list[str]:
    """What the toxic dictionary holds: strings so many times rarer in ordinary texts than in toxic ones, if that is not by chance.

    Chance is ruled out for strings in at least the share least of toxic texts beyond 200, in eight at least unless there are few;
    rarer ones have to pass a test whose expected share of wrong choices is bounded (Benjamini and Hochberg).
    """
    counts = Counter()
    met: set[int] = set()
    for x in toxic:
        ws = WORD.findall(x.lower())
        # a copy of a text brings no new neighbours, and so counts for nothing
        fresh = {w for p, w, n in zip(["", *ws], ws, [*ws[1:], ""], strict=False) if (h := hash((p, w, n))) not in met and (met.add(h) or True)}
        counts.update({g for w in fresh for g in grams(w)})
    often = {g: n for g, n in counts.items() if n > 1}
    usual = Counter()
    for x in ordinary:
        usual.update({g for w in set(WORD.findall(x.lower())) for g in grams(w) if g in often})
    lifted = {g: n for g, n in often.items() if n * (len(ordinary) + 1) >= lift * (usual[g] + 0.5) * len(toxic)}
    share = len(toxic) / (len(toxic) + len(ordinary))
    odds = {g: chance(n, n + usual[g], share) for g, n in lifted.items()}
    bound = max((p for k, p in enumerate(sorted(odds.values()), 1) if p <= wrong * k / len(counts)), default=-1.0)
    bar = max(2, min(8, 0.05 * len(toxic)), least * (len(toxic) - 200))
    marks = {g: n for g, n in lifted.items() if n >= bar or odds[g] <= bound}
    # a string whose longer form is about as frequent gives way to that form, and what begins with a mark adds nothing to it
    longer: dict[str, int] = {}
    for g, n in marks.items():
        for k in range(4, len(g)):
            longer[g[:k]] = max(longer.get(g[:k], 0), n)
    whole = {g: n for g, n in marks.items() if longer.get(g, 0) < 0.9 * n}
    first = [g for g in whole if not any(g[:k] in whole for k in range(4, len(g)))]
    return sorted(first, key=lambda g: (whole[g], g))  # the most frequent nearest to what both dictionaries hold


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method; the ridge spares the intercept."""
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        w = w + np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + keep, x.T @ (y - p) - keep @ w)
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = 3000, doc_chars: int = 20_000, common_words: int = 1500) -> Model:
    """labels: a document's key and its label, 1 or 0; other labels and nulls teach nothing.

    Only keys and hashes of texts are joined; the sample's texts are then picked by hash.
    """
    keyed = docs.where(F.col(text).isNotNull()).select(key, F.xxhash64(text).alias("h"))
    rows = keyed.join(labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").cast("string").alias("k")), key).select("k", "h")
    share = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    wanted = least_hashes(rows, train_docs)
    texts = texts_of(docs, text, {h for _, h in wanted}, doc_chars)
    toxic, ordinary = ([texts[h] for k, h in sorted(wanted) if k == kind and h in texts] for kind in "10")
    if not toxic or not ordinary:
        return Model([], [])
    common = Counter()
    for x in ordinary[::2]:
        common.update(WORD.findall(x.lower()))
    model = Model([w for w, _ in sorted(common.items(), key=lambda p: (-p[1], p[0]))[:common_words]], choose_marks(toxic, ordinary))
    own = [*((x, 1) for x in toxic), *((x, 0) for x in ordinary)]
    weights = fit(np.array([model.features(x) for x, _ in own]), np.array([y for _, y in own], float))
    # the sample has both labels alike often; the corpus does not
    drawn = sum(y for _, y in own) / max(1, sum(1 - y for _, y in own))
    weights[0] += np.log(share["1"] / share["0"]) - np.log(drawn)
    model.weights, model.blank = weights, False
    return model


RESULTS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(df: DataFrame, model: Model, text: str = "text", at: float = 0.3) -> DataFrame:
    """Add score and predicted, 1 from the threshold on. One pass without a shuffle."""
    keep = [c for c in df.columns if c not in RESULTS.names]
    place = keep.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                found = [own.score(x) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64()), pa.array([int(s >= at) for s in found], pa.int32())], names=[*keep, *RESULTS.names])

    return df.select(*keep).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *RESULTS]))
