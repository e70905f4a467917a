"""Near-duplicate detection by Order MinHash.

A text's k-mers are its runs of five words, each labelled with how many equal ones
came before it. Each of several tables takes the few k-mers that are least under its
own hash; two texts that share a table's k-mers are candidates. Order MinHash would ask
for the same order too; but moved text is a link, so order is left to the alignment, and
whatever shares a table's k-mers in order shares them without. Short sets, of which a
table could miss what differs, meet exactly: by all that is left of them when as many
k-mers are taken out as may differ. A text with repeats has keys of its plain k-mers
also, and sizes are near if those of the labelled or of the plain ones are.

Candidates are verified by banded alignment: the equal labelled k-mers, off the
diagonal by no more than the size of the parts that may differ, are chained in the
order of both texts; the longest chain against all k-mers is the similarity. Where
the chain falls short, the exact Jaccard similarity of the k-mers, labelled or plain,
decides. Links join texts into classes.

Exact copies are one node from the start. In each bucket one member meets all others,
then another one, and links are contracted to classes; buckets that are
one class are done. In those that are left every pair could be similar, so they are refined
without loss: two sets can only be as similar as asked if they share one of their rarest
k-mers, in a beginning whose length follows from the sizes of both. Texts that meet because
they share a frequent passage, or that are each some way off the middle of a large group,
share none. In refined buckets single members meet the others twice more, and at last
every pair of different classes in one is verified. Pairs inside a class are never formed,
so a large group of copies costs its length. No bucket is capped.

Defined results: a text of fewer than five words has one k-mer, all its words; texts
without a word, null among them, are alike only if equal, null and empty being equal;
repeated rows and ids are members like others; a class's id is its least doc_id.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import give_back, scratch, spare, stored
from graphloom.llm.components import components
from graphloom.llm.decontam import words as ascii_words

K, TABLES, TAKE, SIMILAR = 5, 32, 5, 0.8
SHORT = 11
"""Sets of at most so many k-mers meet each other exactly."""
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=8)
def multipliers(tables: int) -> np.ndarray:
    return mix(np.arange(1, tables + 1, dtype=np.uint64) * ODD) | np.uint64(1)


class Words:
    """A 32-bit code for each word; words repeat, so a worker keeps those it met."""

    def __init__(self, keep: int = 120_000):
        self.keep, self.known = keep, {}

    def codes(self, text: str | None) -> np.ndarray:
        found = [w for w in ascii_words(text.lower()) if w] if text else []
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh32_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), np.uint32, len(found))


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each run of k words; of all words, if they are fewer."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    k = min(k, len(codes))
    wide = codes.astype(np.uint64)
    out = np.zeros(len(codes) - k + 1, np.uint64)
    for j in range(k):
        out = out * ODD + wide[j : len(codes) - k + 1 + j] + np.uint64(1)
    return mix(out)


def labelled(plain: np.ndarray) -> np.ndarray:
    """Each hash changed by how many equal ones stand before it; the first ones stay."""
    order = np.argsort(plain, kind="stable")
    s = plain[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if not same.any():
        return plain
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(same, 0, at))
    out = plain.copy()
    again = nth > 0
    out[order[again]] = mix(s[again] + nth[again].astype(np.uint64) * ODD)
    return out


def sketch(marks: np.ndarray, tables: int = TABLES, take: int = TAKE) -> np.ndarray:
    """For each table, a hash of its least marks, whatever their order in the text."""
    out = np.empty(tables, np.uint64)
    many = multipliers(tables)
    group = max(1, min(tables, 400_000 // max(1, len(marks))))
    for at in range(0, tables, group):
        own = many[at : at + group]
        ranks = marks[None, :] * own[:, None]
        if len(marks) > take:
            chosen = np.sort(marks[np.argpartition(ranks, take - 1, axis=1)[:, :take]], axis=1)
        else:
            chosen = np.broadcast_to(np.sort(marks), (len(own), len(marks)))
        key = own.copy()
        for j in range(chosen.shape[1]):
            key = mix(key * ODD + chosen[:, j])
        out[at : at + group] = key
    return out


def remainders(marks: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """Hashes of all sets that are left of marks without as many as a similar text may lack: the common ones of two similar sets are left of both."""
    have = np.sort(marks)
    out = []
    for gone in range(int((1 - least) * len(have) + 1e-9) + 1):
        left = np.array(list(combinations(range(len(have)), len(have) - gone)))
        key = np.full(len(left), ODD)
        for j in range(left.shape[1]):
            key = mix(key * ODD + have[left[:, j]])
        out.append(key)
    return np.concatenate(out)


def buckets_of(marks: np.ndarray, tables: int, take: int, least: float) -> np.ndarray:
    """A set's keys; a key's place modulo tables is its table. Sets too small to be like one of more than SHORT need no sketch."""
    if not len(marks):
        return np.zeros(0, np.int64)
    parts = [sketch(marks, tables, take)] if len(marks) >= least * (SHORT + 1) else []
    if len(marks) <= SHORT:
        parts.append(remainders(marks, least))
    return np.concatenate(parts).view(np.int64)


def all_buckets(plain: np.ndarray, marks: np.ndarray, tables: int, take: int, least: float) -> tuple[int, list]:
    """How many different k-mers a text has, and its keys: of the labelled k-mers and, where they differ, of the plain ones. A key it has already is null."""
    keys, once = buckets_of(marks, tables, take, least), np.unique(plain)
    if len(once) == len(plain):
        return len(once), keys
    have = set(keys.tolist())
    more = [None if x in have else x for x in buckets_of(once, tables, take, least).tolist()]
    return len(once), [*keys.tolist(), *[None] * (-len(keys) % tables), *more]


def longest_chain(b: np.ndarray) -> int:
    """How many of these places can be kept so that they rise."""
    if len(b) < 2 or (b[1:] > b[:-1]).all():
        return len(b)
    tails: list[int] = []
    for x in b.tolist():
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x)
        else:
            tails[at] = x
    return len(tails)


def prepared(codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    plain = kmers(np.frombuffer(codes, np.uint32))
    return plain, labelled(plain)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILAR) -> float:
    """Of two prepared texts: by banded alignment of labelled k-mers, or the Jaccard similarity if that is what reaches least."""
    (pa_, ma), (pb, mb) = a, b
    _, ia, ib = np.intersect1d(ma, mb, assume_unique=True, return_indices=True)
    total = len(ma) + len(mb)
    if not total:
        return 0.0
    band = total - int(np.ceil(2 * least / (1 + least) * total / 2)) + 1  # k-mers that may lack a partner on the way
    near = np.abs(ia - ib) <= band
    order = np.argsort(ia[near], kind="stable")
    chain = longest_chain(ib[near][order])
    if (s := chain / (total - chain)) >= least:
        return s
    exact = len(ia) / (total - len(ia))
    if exact < least and (len(np.unique(pa_)) < len(pa_) or len(np.unique(pb)) < len(pb)):
        common = len(np.intersect1d(pa_, pb))
        exact = max(exact, common / (len(np.unique(pa_)) + len(np.unique(pb)) - common))
    return max(s, exact)


def sketches(docs: DataFrame, text: str, tables: int, take: int, least: float = SIMILAR) -> DataFrame:
    """For each row: doc_id, key of the exact text, number of k-mers and of different ones, words' codes, and the tables' buckets (none without a word)."""
    keyed = docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                sizes, once, codes, buckets = [], [], [], []
                for x in part.column(2).to_pylist():
                    c = known.codes(x)
                    plain = kmers(c)
                    different, keys = all_buckets(plain, labelled(plain), tables, take, least)
                    sizes.append(len(plain))
                    once.append(different)
                    codes.append(c.tobytes())
                    buckets.append(keys)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(once, pa.int64()), pa.array(codes, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "once", "codes", "buckets"])
        known.known.clear()
        give_back()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {id_type}, key binary, n long, once long, codes binary, buckets array<long>")


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs: a and b. Those whose texts are similar."""
    a = texts.select(F.col("key").alias("a"), F.col("codes").alias("codes_a"))
    b = texts.select(F.col("key").alias("b"), F.col("codes").alias("codes_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                fine = [similarity(prepared(x), prepared(y), least) >= least for x, y in rows]
                yield part.select([0, 1]).filter(pa.array(fine, pa.bool_()))
        give_back()

    return pairs.join(b, "b").join(a, "a").select("a", "b", "codes_a", "codes_b").mapInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row for each row of docs: doc_id and class_id, the least doc_id of its class."""
    ids = grouped(docs, text, **options)
    return ids.join(ids.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("doc_id", "class_id")


def keep_one(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with one row of each class: the one of the least doc_id (a null id only if there is no other), of repeated rows one."""
    ids = grouped(docs, text, **options)
    key, own_id, nth = (spare(docs.columns, c) for c in ("nd_key", "nd_id", "nd_nth"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = ids.groupBy("root").agg(first.alias("f")).select(F.col("f.key").alias(key), F.coalesce(F.col("f.doc_id").cast("string"), F.lit("null")).alias(own_id))
    own = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))).withColumn(own_id, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    left = own.join(kept, [key, own_id], "left_semi")
    return left.withColumn(nth, F.row_number().over(Window.partitionBy(key, own_id).orderBy(key))).where(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def grouped(docs: DataFrame, text: str = "text", least: float = SIMILAR, tables: int = TABLES, take: int = TAKE) -> DataFrame:
    """One row for each row of docs: doc_id, key of the exact text, and root, the least key of its class."""
    with scratch(docs.sparkSession):
        return stored(_grouped(docs, text, least, tables, take), "ids", lasting=True)


class Classes:
    """The classes so far: of each linked text its root."""

    def __init__(self, texts: DataFrame, least: float):
        self.texts, self.least = texts, least
        self.roots: DataFrame | None = None

    def mixed(self, members: DataFrame) -> DataFrame:
        """members (bucket, key and more) with their roots, of buckets that are not one class yet."""
        if self.roots is None:
            return members.withColumn("root", F.col("key"))
        labels = self.roots.select(F.col("node").alias("key"), F.col("root").alias("label"))
        now = members.join(labels, "key", "left").withColumn("root", F.coalesce("label", "key")).drop("label")
        left = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
        return stored(now.join(left, "bucket", "left_semi"), "mixed")

    def link(self, pairs: DataFrame) -> None:
        """Verify the pairs a and b, and join the classes of those that are similar."""
        links = stored(verify(pairs.distinct(), self.texts, self.least), "links")
        if links.isEmpty():
            return
        if self.roots is None:
            self.roots = components(links)
            return
        # links of earlier turns are in the classes; only classes are linked further
        roots = self.roots
        a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        over = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
        then = components(over)
        moved = roots.join(then.select(F.col("node").alias("root"), F.col("root").alias("then")), "root", "left").select("node", F.coalesce("then", "root").alias("root"))
        self.roots = stored(moved.unionByName(then.join(roots.select("node"), "node", "left_anti")), "roots")


def met(now: DataFrame, fits: Column, few: DataFrame | None = None, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """Pairs of members of one bucket and different roots: of all with few, by default one member of each bucket for each seed. Which one is chosen anew in each bucket."""
    own = ["key", "root", *(c for c in now.columns if c not in ("bucket", "key", "root"))]
    if few is None:
        one = lambda seed: F.min_by(F.struct(*own), F.xxhash64("bucket", "key", F.lit(seed)))
        chosen = now.groupBy("bucket").agg(F.array(*map(one, seeds)).alias("o"))
        few = chosen.select("bucket", F.explode(F.array_distinct("o")).alias("o")).select("bucket", "o.*")
    few = few.select("bucket", *(F.col(c).alias(f"{c}_2") for c in own))
    both = now.join(few, "bucket").where((F.col("root") != F.col("root_2")) & fits)
    return both.select(F.least("key", "key_2").alias("a"), F.greatest("key", "key_2").alias("b"))


def postings(texts: DataFrame, least: float) -> DataFrame:
    """texts: key and codes. bucket, key, n and at, for each place of a text's rare k-mers: two texts can only be similar if they share a bucket.

    K-mers are ordered by how many of these texts have them, the rarest first. Of two similar
    sets the first common one stands, in both, before so many are left as must be common; so it
    is enough to look at the beginnings. How long they are depends on both sizes, which are dealt
    by bands. A k-mer of one text alone meets nothing and is only counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                keys, sets = [], []
                for key, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    plain, marks = prepared(x)
                    keys.append(key)
                    sets.append(marks.view(np.int64))
                    if len(once := np.unique(plain)) < len(plain):
                        keys.append(key)
                        sets.append(once.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(list(map(len, sets)), pa.int64())], names=["key", "marks", "n"])

    sets = stored(texts.select("key", "codes").mapInArrow(run, "key binary, marks array<long>, n long"), "sets")
    marks = sets.select("key", "n", F.explode("marks").alias("mark"))
    often = marks.groupBy("mark").agg(F.count("*").alias("times")).where("times > 1")
    rare_first = marks.join(often, "mark").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("times", "mark"))).alias("shared"))
    step, size, share = math.log(1.05), F.col("n").cast("double"), least / (1 + least)
    band = lambda x: F.floor(F.log(x) / step + 1e-9)
    small = F.greatest(F.lit(1.0), F.ceil(size * least - 1e-9))
    bands = rare_first.withColumn("band", band(size)).withColumn("other", F.explode(F.sequence(band(small), band(F.floor(size / least + 1e-9)))))
    # of the sizes of the other band, the least that can be similar asks for the fewest common k-mers
    fewest = F.greatest(F.ceil(F.pow(F.lit(1.05), F.col("other")) * (1 - 1e-9) - 1e-6), small)
    first = F.col("n") - F.ceil(share * (size + fewest) - 1e-9).cast("long") + 1  # how many places count
    alone = F.col("n") - F.size("shared")
    begun = bands.withColumn("head", F.slice("shared", F.lit(1), F.greatest(F.lit(0), first - alone).cast("int"))).withColumn("alone", alone)
    each = begun.select("key", "n", "alone", "band", "other", F.posexplode("head").alias("k", "m"))
    bucket = F.xxhash64("m.mark", F.least("band", "other"), F.greatest("band", "other"))
    return each.select(bucket.alias("bucket"), "key", "n", (F.col("alone") + F.col("k")).alias("at"))


def _grouped(docs: DataFrame, text: str, least: float, tables: int, take: int) -> DataFrame:
    found = stored(sketches(docs, text, tables, take, least), "sketches")
    nodes = found.select("key", "n", "once", "buckets").where("n > 0").dropDuplicates(["key"])
    members = nodes.select("key", "n", "once", F.explode("buckets").alias("bucket")).where("bucket IS NOT NULL")
    full = members.groupBy("bucket").count().where("count > 1").select("bucket")
    members = stored(members.join(full, "bucket"), "members")
    texts = stored(found.join(members.select("key").distinct(), "key", "left_semi").select("key", "codes").dropDuplicates(["key"]), "texts")
    classes = Classes(texts, least)
    sizes = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1
    near = sizes("n", "n_2") | sizes("once", "once_2")
    left = classes.mixed(members)
    for seeds in ((0,), (1, 2)):
        classes.link(met(left, near, seeds=seeds))
        left = classes.mixed(left.drop("root"))
    if not left.isEmpty():
        # what is left can be similar only where rare k-mers are shared too
        rare = postings(texts.join(left.select("key").distinct(), "key", "left_semi"), least)
        shared = rare.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low != high").select("bucket")
        rare = stored(rare.join(shared, "bucket", "left_semi"), "postings")
        enough = F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2")) >= F.lit(least / (1 + least)) * (F.col("n") + F.col("n_2")) - 1e-6
        now = classes.mixed(rare)
        for seeds in ((3, 4, 5), (6, 7, 8)):
            classes.link(met(now, enough, seeds=seeds))
            now = classes.mixed(now.drop("root"))
        # every pair left: all members outside a bucket's largest class, against the whole bucket
        main = now.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        classes.link(met(now, enough, now.join(main, "bucket").where("root != main").drop("main")))
    roots = classes.roots
    if roots is None:
        roots = nodes.select(F.col("key").alias("node"), F.col("key").alias("root")).where("false")
    return found.select("doc_id", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))
