"""Personal data by bootstrapped contextual extraction.

Base patterns for e-mail, IP, card and phone find the seeds. The text before a seed is
a lexical pattern; other strings with digits or signs of an address that follow the
same patterns are instances of unknown kind. Spark scores the graph of patterns and
instances for some rounds: a pattern is trusted as far as the instances that follow it
are, for each kind, and an instance as far as the patterns it follows. A pattern also
has to be rare elsewhere: of all its occurrences in the corpus most must be followed
by a trusted instance, so that no common words become a pattern. Instances of high-confidence
patterns, of a form that fits the kind, are spans too. Base spans always stay.

A pattern is what the 48 characters before a place end with: two words or signs. Only that much context is a
feature; the strings themselves may be of any length.

Patterns to be counted are split into blocks of bounded size, each searched in a pass
of its own; nothing that grows with the corpus is collected or broadcast whole.

Defined results: a null or empty text has no spans; positions are code points, ends
exclusive; texts that are equal have equal spans; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import give_back, spare, stored

# The kinds, in the order that breaks ties of place.
KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive: a run that fails as a whole also fails from any later digit of it.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
BEFORE = re.compile(r"(?:\w+|[^\w\s])\s{0,2}(?:\w+|[^\w\s])\s{0,2}\Z")
NUMBER = re.compile(r"[0-9][0-9 ().-]{3,}[0-9]")
AT = re.compile(r"@|[(\[]at[)\]]")
BREAK = frozenset(" \t\n\r\f\v,;<>\"'")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base(text: str) -> list[tuple[int, int, int]]:
    """Start, kind's place and end of each base match, in order."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        at = text.find("+")
        while at >= 0:
            if m := PHONE.match(text, at):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((at, 3, m.end()))
                at = text.find("+", m.end())
            else:
                at = text.find("+", at + 1)
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Where strings stand that hold a longer number or an at sign: to the nearest white space or mark on both sides."""
    done = 0
    found = [(m.start(), m.end()) for m in NUMBER.finditer(text)] if DIGIT.search(text) else []
    if "@" in text or "at)" in text or "at]" in text:
        found = sorted([*found, *((m.start(), m.end()) for m in AT.finditer(text))])
    for start, end in found:
        if start < done:
            continue
        while start > done and text[start - 1] not in BREAK:
            start -= 1
        while end < len(text) and text[end] not in BREAK:
            end += 1
        done = end
        while end > start and text[end - 1] in ".:!?)":
            end -= 1
        yield start, end


def pattern_before(text: str, start: int) -> str | None:
    """The two words or signs before a place, with their white space as single spaces; at least one holds a letter."""
    m = BEFORE.search(text[max(0, start - 48) : start])
    if not m:
        return None
    found = " ".join(m[0].lower().split()) + (" " if m[0][-1:].isspace() else "")
    return found if any(c.isalpha() for c in found) and len(found) >= 4 else None


def instance(text: str) -> str:
    """What stands for a string in the graph: itself in lower case, a long one its digest."""
    low = text.lower()
    return low if len(low) <= 64 else hashlib.md5(low.encode("utf-8", "surrogatepass")).hexdigest()


def fits(kind: int, text: str) -> bool:
    """Whether an instance could be of the kind, by its form alone."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == 0:
        return "@" in text or "(at)" in text or "[at]" in text
    if kind == 1:
        return text.count(".") == 3 and digits >= 4
    return 12 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


OCCURRENCE = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("instance", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("fits", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, text: str) -> DataFrame:
    """For each row: doc_id, key of the text, base spans, and occurrences of seeds (with a kind) and of other instances (without)."""
    keyed = docs.select("doc_id", F.md5(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    found_as = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.int32()), ("fits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def occurrences(x: str, known: list[tuple[int, int, int]]) -> list[dict]:
        out = []
        for start, kind, end in known:
            if p := pattern_before(x, start):
                out.append({"pattern": p, "instance": instance(x[start:end]), "kind": kind, "fits": 0, "start": start, "end": end})
        for start, end in candidates(x):
            found = x[start:end]
            if any(s < end and start < e for s, _, e in known):
                continue
            forms = sum(1 << k for k in range(4) if fits(k, found))
            if forms and (p := pattern_before(x, start)):
                out.append({"pattern": p, "instance": instance(found), "kind": None, "fits": forms, "start": start, "end": end})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(2).to_pylist()
                known = [base(x) if x else [] for x in texts]
                others = [occurrences(x, k) if x else [] for x, k in zip(texts, known, strict=True)]
                rows = [[{"start": s, "kind": k, "end": e} for s, k, e in ks] for ks in known]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, spans), pa.array(others, found_as)], names=["doc_id", "key", "base", "found"])
        give_back()

    schema = T.StructType([docs.schema["doc_id"], T.StructField("key", T.StringType()), T.StructField("base", T.ArrayType(SPAN)), T.StructField("found", T.ArrayType(OCCURRENCE))])
    return keyed.mapInArrow(run, schema)


def count_patterns(docs: DataFrame, text: str, patterns: DataFrame, block: int = 20_000) -> DataFrame:
    """How often each pattern occurs in all texts; patterns go out in blocks of at most so many."""
    spark, out = docs.sparkSession, None
    blocks = max(1, -(-patterns.count() // block))
    for k in range(blocks):
        own = [r["pattern"] for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = ahocorasick.Automaton()
            for p in shared.value:
                finder.add_word(p, p)
            finder.make_automaton()
            counts: dict[str, int] = {}
            for b in batches:
                for x in b.column(0).to_pylist():
                    if x:
                        x = x.lower()
                        for end, p in finder.iter(x):
                            before = x[end - len(p)] if end >= len(p) else " "
                            if not (before.isalnum() and p[0].isalnum()):
                                counts[p] = counts.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "total"])

        got = docs.select(text).mapInArrow(run, "pattern string, total long")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("pattern").agg(F.sum("total").alias("total"))


def discover(docs: DataFrame, found: DataFrame, text: str, support: int, trust: float, rounds: int) -> DataFrame:
    """Further spans: key, start, kind and end. found: key and occurrences."""
    seen = stored(found.select("key", F.explode("found").alias("o")).select("key", "o.*"), "occurrences")
    nothing = seen.select("key", "start", F.lit(0).alias("kind"), "end").where("false")
    seeds = seen.where("kind IS NOT NULL")
    able = seeds.groupBy("pattern").agg(F.count_distinct("instance").alias("n")).where(F.col("n") >= support).select("pattern")
    able = stored(able, "able")
    if able.isEmpty():
        return nothing
    totals = stored(count_patterns(docs, text, able), "totals")
    edges = seen.join(able, "pattern").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("fits").alias("fits"), F.count("*").alias("times"))
    kinds = F.explode(F.array(*[F.lit(k) for k in range(len(KINDS))]))
    graph = stored(edges.join(totals, "pattern").withColumn("of", kinds).where((F.col("kind") == F.col("of")) | (F.col("kind").isNull() & (F.col("fits").bitwiseAND(F.expr("shiftleft(1, of)")) > 0)) | F.col("kind").isNotNull()), "graph")
    scores = graph.groupBy("instance", "of").agg(F.max(F.when(F.col("kind") == F.col("of"), 1.0).otherwise(0.0)).alias("r"))
    trusted = None
    for _ in range(rounds):
        # a pattern: the trusted share of what follows it, each instance once, and of all its occurrences
        weighed = graph.join(scores, ["instance", "of"]).groupBy("pattern", "of").agg(F.sum("r").alias("good"), F.count("*").alias("all"), F.sum(F.col("r") * F.col("times")).alias("hits"), F.max("total").alias("total"))
        trusted = stored(weighed.select("pattern", "of", F.least(F.col("good") / (F.col("all") + 1), F.col("hits") / F.greatest("total", "hits")).alias("p")), "trusted")
        # an instance: seeds keep 1, others the trust of their patterns together
        scores = stored(graph.join(trusted, ["pattern", "of"]).groupBy("instance", "of").agg(F.max(F.when(F.col("kind") == F.col("of"), 1.0).otherwise(0.0)).alias("seed"), F.avg("p").alias("p")).select("instance", "of", F.greatest("seed", "p").alias("r")), "scores")
    sure = trusted.where(F.col("p") >= trust).select("pattern", "of", "p")
    new = seen.where("kind IS NULL").join(sure, "pattern").where(F.col("fits").bitwiseAND(F.expr("shiftleft(1, of)")) > 0)
    best = new.groupBy("key", "start", "end").agg(F.max_by("of", F.struct("p", -F.col("of"))).alias("kind"))
    return best.select("key", "start", "kind", "end")


def find(docs: DataFrame, text: str = "text", support: int = 5, trust: float = 0.8, rounds: int = 3) -> DataFrame:
    """For each row: doc_id, base (spans by start, then kind) and spans (those and the discovered ones)."""
    found = stored(scan(docs, text), "scanned")
    more = discover(docs, found, text, support, trust, rounds)
    more = more.groupBy("key").agg(F.collect_set(F.struct("start", F.col("kind").cast("int").alias("kind"), "end")).alias("more"))
    joined = found.join(more, "key", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    return joined.select("doc_id", "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans merge under the first one's kind.

    Spans are found by the same scan and joined by the text's key, so equal texts are
    redacted alike; a null text stays null.
    """
    found = stored(scan(docs, text), "scanned")
    more = discover(docs, found, text, options.get("support", 5), options.get("trust", 0.8), options.get("rounds", 3))
    more = more.groupBy("key").agg(F.collect_set(F.struct("start", F.col("kind").cast("int").alias("kind"), "end")).alias("pii_more"))
    keep = list(docs.columns)
    place = keep.index(text)
    key, extra = spare(keep, "pii_key"), spare(keep, "pii_more")
    more = more.select(F.col("key").alias(key), F.col("pii_more").alias(extra))
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(text), F.lit("")))).join(more, key, "left").select(*(F.col(f"`{c}`") for c in keep), extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = []
                for x, m in zip(part.column(place).to_pylist(), part.column(len(keep)).to_pylist(), strict=True):
                    if x:
                        pieces, done = [], 0
                        for s, k, e in sorted([*base(x), *((y["start"], y["kind"], y["end"]) for y in m or ())]):
                            if s >= done:
                                pieces += [x[done:s], f"[{KINDS[k]}]"]
                            done = max(done, e)
                        x = "".join(pieces) + x[done:]
                    out.append(x)
                columns = list(part.columns[: len(keep)])
                columns[place] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=keep)

    return keyed.mapInArrow(run, T.StructType([docs.schema[c] for c in keep]))
