"""The registered queries, each contract column by brute force, over given rows and awkward ones: nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import neardup, pii, queries
from tests.llm.test_operators import brute_pii

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"wörd{i % 9973} é{i % 31}" for i in range(150_000))
LINE = "a line of seven words that recurs "


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    """The smallest tables, with awkward rows added."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [None, "", " \n", "...", "a", LINE * 40, LINE * 120, LONG, LONG, "call +1 (201) 555-0123 or 10.0.0.1, x@y.zz", "ünïcode 日本語 🎉 \x00 x <|endoftext|>", "𝔘 " * 3000]
    rows = spark.createDataFrame([(900_000 + k, x) for k, x in enumerate(texts)] + [(900_000, None), (900_005, LINE * 40)], "doc_id long, text string")
    more = rows.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit("x").alias("source"), F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    docs.select(*more.columns).unionByName(more).write.parquet(f"{d}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kind = bench.schema["item_id"].dataType
    extra = spark.createDataFrame([(8001, "the of"), (8002, None), (8003, "..."), (8004, LINE * 3), (8005, LINE * 3)], "item_id long, text string").select(F.col("item_id").cast(kind).alias("item_id"), "text")
    bench.select("item_id", "text").unionByName(extra).write.parquet(f"{d}/benchmark.parquet")
    vectors = np.random.default_rng(3).normal(size=(130, 8)).round(2)
    vectors[40:60] = vectors[40]
    v = [(k, [float(x) for x in r]) for k, r in enumerate(vectors)] + [(20, vectors[20].tolist()), (200, None), (220, [0.0] * 8), (240, [float("inf")] * 8), (260, [None] * 8)]
    spark.createDataFrame(v, "vec_id long, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    for name in ("labels", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="module")
def nowhere(spark, where, tmp_path_factory):
    """The same tables without a row."""
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "embeddings", "labels", "pages", "conversations"):
        spark.read.parquet(f"{where}/{name}.parquet").where("false").write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="module")
def texts(spark, where):
    """doc_id and text of each row."""
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{where}/documents.parquet").collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass")).hexdigest()


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_op2(spark, where, texts):
    data = [x.encode() for _, x in texts]
    seen, places = set(), defaultdict(list)
    # by hashes of windows, taken over from one to the next, then by their bytes
    for k, d in enumerate(data):
        for p in range(len(d) - 399) if len(d) < 200_000 else ():
            places[hash(d[p : p + 400])].append((k, p))
    for own in places.values():
        if len(own) > 1:
            same = Counter(data[k][p : p + 400] for k, p in own)
            seen |= {(k, p) for k, p in own if same[data[k][p : p + 400]] > 1}
    want = []
    for k, (i, _) in enumerate(texts):
        d = data[k]
        gone = np.zeros(len(d) + 1, bool)
        if len(d) >= 200_000:
            gone[: len(d)] = True  # the long text is there twice
        for p in range(max(0, len(d) - 399)) if len(d) < 200_000 else ():
            if (k, p) in seen:
                gone[p : p + 400] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[: len(d)]])
        want.append((i, len(d), len(d) - len(kept), spans, sha(kept)))
    got = queries.op2_suffix(spark, where).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert bag(got) == bag(want)


def test_op3(spark, where, texts):
    want = []
    for i, x in texts:
        found = brute_pii(x)
        counts = Counter(k for _, k, _ in found)
        want.append((i, *(counts[k] for k in range(4)), sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found))))
    got = queries.op3_pii(spark, where).collect()
    assert bag((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == bag(want)
    by = {(r.doc_id, r.base_sha256): r.spans for r in got}
    for i, x in texts:
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_pii(x)]
        assert set(base) <= set(filter(None, by[i, sha(",".join(base))].split(",")))


def test_op4(spark, where, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for i, x in texts:
        ids = library.encode(x, add_special_tokens=False).ids
        want.append((i, len(ids), sha(b"".join(struct.pack("<I", k) for k in ids)), sha(library.decode(ids, skip_special_tokens=False))))
    assert bag(queries.op4_bpe(spark, where).collect()) == bag(want)


def test_op6(spark, where, texts):
    prepared = [neardup.prepared(neardup.Words().codes(x).tobytes()) for _, x in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if texts[a][1] == texts[b][1] or len(prepared[a][0]) and neardup.similarity(prepared[a], prepared[b]) >= neardup.SIMILAR:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        least[find(k)] = min(least.get(find(k), i), i)
    assert bag(queries.op6_neardup(spark, where).select("doc_id", "class_id").collect()) == bag((i, least[find(k)]) for k, (i, _) in enumerate(texts))


def test_op7(spark, where):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()]
    fine = {i: np.array(v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    got = defaultdict(list)
    for r in queries.op7_ann(spark, where).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in fine if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        exact = {i: float((v * fine[q]).sum()) for i, v in fine.items() if i != q}
        best = sorted(exact, key=lambda i: (-exact[i], i))[:20]
        found.sort()
        assert [k for k, *_ in found] == list(range(1, 21)) and all(abs(s - exact[i]) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len(set(best) & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(got)


def test_op9_and_op1(spark, where, texts):
    for rows, of in ((queries.op9_langid(spark, where).collect(), "lang_pred"), (queries.op1_toxicity(spark, where).collect(), "predicted")):
        assert bag((r.doc_id, r.held_out) for r in rows) == bag((i, zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in texts)
        assert all(0 <= r.score <= 1 for r in rows)
        if of == "predicted":
            assert all(r.predicted == int(r.score >= 0.3) for r in rows)
        else:
            no_letter = {i for i, x in texts if not re.search(r"[^\W\d_]", x)}
            assert {r.doc_id for r in rows if r.lang_pred == "und"} == no_letter


def test_op10(spark, where, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", x.translate(low))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{where}/benchmark.parquet").collect():
        if w := words(r.text or ""):
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])].add(str(r.item_id))
    want = []
    for i, x in texts:
        w, hit, items = words(x), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit |= set(range(k, k + n))
        want.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert bag(queries.op10_decontamination(spark, where).collect()) == bag(want)


def test_empty_tables(spark, nowhere):
    import corpus_pipeline

    for name, query in queries.queries().items():
        rows = query(spark, nowhere).collect()
        assert [r.conv_id for r in rows] == [-7] if name == "op5_chat" else rows == [], name
    assert corpus_pipeline.run(spark, nowhere).count() == 0


def test_pipeline_stages(spark, where):
    """Each stage on what the one before it kept: ids and texts by brute force."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    now = stages["language"](spark, docs, where)
    assert bag((r.doc_id, r.text) for r in now.select("doc_id", "text").collect()) == bag((r.doc_id, r.text) for r in docs.collect() if re.search(r"[^\W\d_]", r.text or ""))
    kept = stages["near_duplicates"](spark, now, where)
    classes = {r.doc_id: r.class_id for r in neardup.classes(now).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values())) and kept.columns == corpus_pipeline.COLUMNS
    cut = stages["decontamination"](spark, kept, where)
    assert {r.doc_id for r in kept.collect()} - {r.doc_id for r in cut.collect()} <= {900_005, 900_006}
    clean = {r.doc_id: r.text for r in stages["personal_data"](spark, cut, where).collect()}
    for r in cut.collect():
        want, done = [], 0
        for s, k, e in brute_pii(r.text):
            if s >= done:
                want += [r.text[done:s], f"[{pii.KINDS[k]}]"]
            done = max(done, e)
        assert clean[r.doc_id] == "".join(want) + r.text[done:]


def test_columns_named_like_helpers_stay(spark):
    from graphloom.llm import decontam

    row = "text string, doc_id long, spans string, items long, n_words string, nd_key string, ND_ID string, pii_key string, pii_more long"
    docs = spark.createDataFrame([("mail a@b.cc " + LINE * 3, 1, "s", 2, "n", "k", "i", "p", 3)], row)
    bench = spark.createDataFrame([(1, LINE * 2)], "item_id long, text string")
    for out in (decontam.remove(docs, bench), neardup.keep_one(docs), pii.redact(docs)):
        r = out.first()
        assert out.columns == docs.columns and (r.spans, r["items"], r.n_words, r.nd_key, r.ND_ID, r.pii_key, r.pii_more) == ("s", 2, "n", "k", "i", "p", 3)


def test_long_identifiers_are_found(spark):
    rows = [(k, f"my address is, as ever {'u' * 30}{k}@mail.example.com today") for k in range(12)] + [(50, f"my address is, as ever {'v' * 240}(at)mail.example.com today")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.kind) for s in got[50]] == [(23, 0)]
