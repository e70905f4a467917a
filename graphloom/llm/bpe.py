"""BPE encoding and decoding by dynamic programming over prefixes.

A word's unique encoding ends, at every prefix, in one token: of all tokens that
are suffixes of the prefix, the one that merging would never pull apart from the
last token of what lies before it. The tokens that end at each position come from
an Aho-Corasick automaton of the vocabulary, in place of a suffix automaton's matches: what is
looked for is a fixed set of strings, and its suffix links give the same tokens. A test of
the two tokens' merge histories gives compatibility, and the back-pointers give
the ids. No merge loop runs, so a long word costs time in proportion to its
length times the tokens that end at a position.

Words repeat, so each worker keeps the ids of short words it has met, of a bounded
number: those met since the memory was last full, and those met before it.
That changes no result.

Defined results: a null or empty text has no ids and decodes to the empty text;
strings of the vocabulary's added tokens become their ids, as the tokenizers
library does; symbols that the vocabulary lacks have no ids, as in the library without
an unknown token; extra columns pass through untouched unless they have the names of
results, which replace them.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.common import give_back

END = "\ue000"
"""Stands for the mark of a word's end, which is no symbol of its own."""


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    keep = set(printable)
    return [chr(b if b in keep else next(spare)) for b in range(256)]


class PrefixEncoder:
    """Encodes one word, with its last symbol bearing the end mark. A token is known here by its id."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_mark: str):
        self.end_mark = end_mark
        glue = (lambda s: s.removesuffix(end_mark) + END if end_mark and s.endswith(end_mark) else s)
        ids = {glue(s): i for s, i in vocab.items()}
        self.size = max(ids.values(), default=0) + 1
        self.rank, self.parts, self.joined = [-1] * self.size, {}, {}
        for r, (left, right) in reversed(list(enumerate(merges))):
            a, b = ids[glue(left)], ids[glue(right)]
            made = ids[glue(left) + glue(right)] if not glue(left).endswith(END) else None
            if made is not None:
                self.rank[made], self.parts[made] = r, (a, b)
                self.joined[a * self.size + b] = r
        # a symbol is one character, or one with the end mark; other tokens that no merge makes never come
        symbols = {s for s in ids if len(s.rstrip(END)) == 1}
        self.known = frozenset(s.rstrip(END) for s in symbols)
        self.matches = ahocorasick.Automaton()
        for s, i in ids.items():
            if i in self.parts or s in symbols:
                self.matches.add_word(s, (i, len(s)))
        self.matches.make_automaton()
        self.fits: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging, of the two tokens side by side, leaves the border between them alone.

        The tokens' last merges are undone from the youngest; whenever the two pieces
        at the border could themselves merge, that merge must come no earlier than
        what was undone on its side, else it would have gone first.
        """
        if len(self.fits) > 100_000:
            self.fits.clear()
        a, b, bar, fine = left, right, float("inf"), True
        rank, parts, joined, size = self.rank, self.parts, self.joined, self.size
        while True:
            at = joined.get(a * size + b)
            if at is not None and at < bar:
                fine = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # the left one's merge is younger; a tie of place goes to the left
                bar, a = ra, parts[a][1]
            else:  # the same rank merges from left to right, so the left border goes first
                bar, b = rb + 0.5, parts[b][0]
        self.fits[left * size + right] = fine
        return fine

    def encode(self, word: str) -> list[int]:
        """The ids of a word of byte symbols."""
        text = word + END if self.end_mark else word
        size = len(text)
        last, start = [-1] * (size + 1), [0] * (size + 1)
        border = size - 1 if self.end_mark else size + 1  # the last symbol and its mark are one
        fits, many = self.fits, self.size
        end = 0
        for at, (token, length) in self.matches.iter(text):  # at each place the longest first
            end = at + 1
            if last[end] >= 0 or end == border:
                continue
            begin = end - length
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                fine = fits.get(before * many + token)
                if not (self.compatible(before, token) if fine is None else fine):
                    continue
            last[end], start[end] = token, begin
        if last[size] < 0:
            known = "".join(c for c in word if c in self.known)
            if known == word:
                raise ValueError("a vocabulary without the symbols that its merges need")
            return self.encode(known) if known else []
        out, i = [], size
        while i:
            out.append(last[i])
            i = start[i]
        out.reverse()
        return out


class Tokenizer:
    """A tokenizer file of this kind: its normaliser, its split into words, its BPE and its decoding."""

    def __init__(self, config: str, keep: int = 90_000, longest: int = 48):
        spec = json.loads(config)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
            raise ValueError("a tokenizer file of another kind")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.encoder = PrefixEncoder(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.added.items()}
        self.cutter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.keep, self.longest = keep, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC, white space made single spaces, and each character's own lower case."""
        import unicodedata

        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the lower case of a final sigma would depend on its neighbours
                text = text.replace("Σ", "σ")
        return text.lower()  # white space only parts words, so its kind does not matter after this

    def word(self, word: str) -> bytes:
        """A word's ids as little-endian 32-bit integers."""
        got = self.known.get(word) or self.older.get(word)
        if got is None:
            ids = self.encoder.encode("".join(map(self.symbols.__getitem__, word.encode("utf-8", "replace"))))
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= self.longest:
            if len(self.known) >= self.keep:
                self.older, self.known = self.known, {}
            self.known[word] = got
        return got

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The text's ids, packed, and its decoded text."""
        if not text:
            return b"", ""
        pieces = self.cutter.split(text) if self.cutter and any(a in text for a in self.added) else [text]
        packed: list[bytes] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                packed.append(self.added[piece].to_bytes(4, "little"))
                continue
            words = self.words.findall(self.normal(piece))
            for at in range(0, len(words), 200_000):
                get, word = self.known.get, self.word
                packed += [get(w) or word(w) for w in words[at : at + 200_000]]
        ids = b"".join(packed)
        return ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, array("I", ids) if sys.byteorder == "little" else struct.unpack(f"<{len(ids) // 4}I", ids)))


@lru_cache(maxsize=2)
def load(config: str) -> Tokenizer:
    return Tokenizer(config)


RESULTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_decode(df: DataFrame, config: str, text: str = "text", with_values: bool = True) -> DataFrame:
    """Add each row's number of ids, their digest, and with_values the packed ids and the decoded text.

    ``config`` is the tokenizer file's contents, of fixed size, and travels with the tasks.
    One pass without a shuffle; a batch holds few rows at a time and nothing else grows.
    """
    keep = [c for c in df.columns if c not in RESULTS.names]
    fields = [f for f in RESULTS if with_values or f.name not in ("ids", "decoded")]
    if text not in keep:
        raise ValueError(f"no column {text}")
    shared = df.sparkSession.sparkContext.broadcast(config)
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [tokenizer.encode(x) for x in part.column(place).to_pylist()]
                made = {
                    "n_tokens": pa.array([len(i) // 4 for i, _ in rows], pa.int64()),
                    "ids": pa.array([i for i, _ in rows], pa.binary()),
                    "decoded": pa.array([d for _, d in rows], pa.string()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, d in rows], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*part.columns, *(made[f.name] for f in fields)], names=[*keep, *(f.name for f in fields)])
        give_back()

    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    return df.select(*keep).mapInArrow(run, schema)
