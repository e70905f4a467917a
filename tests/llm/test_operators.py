"""The text operators on small, awkward rows, each against a brute-force version, a round trip or held-out accuracy."""

import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, chat, decontam, html, langid, neardup, pii, suffix, toxicity
from graphloom.llm.components import components
from graphloom.llm.queries import tokenizer_config

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} filler{i % 13}" for i in range(30_000))
TEXTS = [None, "", " ", "...", "a", "The same text of some words, twice.", "The same text of some words, twice.", LONG, "ünïcode ÉÈ 日本語 🎉 \x00 x"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns with the names of results."""
    rows = [(i, x, "en" if i % 2 else None, 0.5, "old") for i, x in enumerate(TEXTS)] + [(None, "no id", None, None, None), (3, "...", "en", 1.0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, spans string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_bpe_equals_the_library(spark, awkward, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = bpe.encode_decode(awkward, tokenizer_config()).collect()
    assert len(got) == awkward.count()
    random.seed(3)
    own = bpe.Tokenizer(tokenizer_config())
    texts = [r.text or "" for r in got] + ["".join(random.choice("aeiostr'nlß É09.!|<>") for _ in range(60)) for _ in range(500)] + ["a<|endoftext|>b", "ΟΔΟΣ İx it's"]
    for x in texts:
        e = library.encode(x, add_special_tokens=False)
        ids, decoded = own.encode(x)
        assert ids == b"".join(struct.pack("<I", i) for i in e.ids)
        assert decoded == library.decode(e.ids, skip_special_tokens=False) == own.decode(ids)
    assert bpe.encode_decode(nothing, tokenizer_config()).count() == 0


def brute_pii(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base_equals_brute_force():
    random.seed(4)
    for _ in range(20_000):
        x = "".join(random.choice("0123456789..@@+- ()ab4%") for _ in range(random.randint(1, 80)))
        assert pii.base(x) == brute_pii(x)
    assert pii.base("1" * 200_000 + "@") == [] and pii.base("a" * 200_000) == []


def test_pii_discovers_by_context(spark, awkward, nothing):
    phones = [f"hello friend, telephone number +1 (20{i}) 555-10{i}{i} now" for i in range(8)]
    hidden = ["hello friend, telephone number 0201 555 9999 now", "the item 0201 555 9999 is a part"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(phones + hidden)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(rows).collect()}
    found = hidden[0].index("0201")
    assert [(s.start, s.kind) for s in got[8]] == [(found, 3)] and got[9] == []
    assert all(len(got[i]) == 1 for i in range(8))
    assert pii.find(awkward).count() == awkward.count() and pii.find(nothing).count() == 0
    out = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert out[8] == "hello friend, telephone number [phone] now" and out[9] == hidden[1]


def test_decontamination_equals_brute_force(spark, awkward, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "the of"), (901, None), (902, "...")], "item_id long, text string").select(F.col("item_id").cast(spark.read.parquet(f"{SF}/benchmark.parquet").schema["item_id"].dataType).alias("item_id"), "text"))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(low))
    windows = {}
    for r in bench.collect():
        if w := words(r.text):
            for i in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(str(r.item_id))
    # small blocks and shards, so that several of each are met
    got = {r.doc_id: r for r in decontam.find(docs, bench, shard_words=500, block_bytes=3000).collect()}
    for r in docs.collect():
        w, hit, items = words(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    items |= found
                    hit |= set(range(i, i + n))
        g = got[r.doc_id]
        assert (g.n_words, g["items"]) == (len(w), sorted(items))
        assert {i for s in g.spans for i in range(s.start, s.end)} == hit
    assert decontam.find(awkward, bench).count() == awkward.count()
    assert decontam.find(nothing, bench).count() == 0 and decontam.find(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_suffix_removal_equals_brute_force(spark, awkward, nothing):
    random.seed(5)
    made = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    one, two = made(700), made(450)
    texts = [one, made(300) + one[100:650] + made(300), two + made(50) + two, "ab" * 600, made(2000), one, two[:399], made(100) + one[250:], None, ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    data = [(x or "").encode() for x in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - 399):
            seen[d[p : p + 400]] = seen.get(d[p : p + 400], 0) + 1
    got = {r.doc_id: r for r in suffix.remove(rows).collect()}
    for i, d in enumerate(data):
        gone = {q for p in range(len(d) - 399) if seen[d[p : p + 400]] > 1 for q in range(p, p + 400)}
        kept = bytes(b for q, b in enumerate(d) if q not in gone)
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(d), len(gone), kept)
        assert got[i].n_spans == sum(q - 1 not in gone for q in gone) and got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert suffix.remove(awkward).count() == awkward.count() and suffix.remove(nothing).count() == 0


def test_loser_tree_merges_runs():
    random.seed(6)
    runs = [sorted("".join(random.choice("ab") for _ in range(random.randint(0, 9))).encode() for _ in range(random.randint(0, 30))) for _ in range(7)]
    coded = [iter([(k, r, None) for k, r in suffix.front_code(run)]) for run in runs]
    out = list(suffix.merge_runs(coded))
    assert [s for s, *_ in out] == sorted(s for run in runs for s in run)
    assert all(k == suffix.shared(a[0], b[0]) for a, (b, k) in zip(out, [(o, o[1]) for o in out[1:]], strict=False))


def test_common_windows_by_all_pairs():
    random.seed(7)
    for _ in range(200):
        items = sorted(("".join(random.choice("ab") for _ in range(12)).encode(), "".join(random.choice("ab") for _ in range(8)).encode()) for _ in range(random.randint(2, 12)))
        rights = [suffix.shared(a[0], b[0]) for a, b in zip(items, items[1:], strict=False)]
        got = suffix.common_windows(rights, [b for _, b in items], 10)
        for i, (r, b) in enumerate(items):
            want = {d for j, (r2, b2) in enumerate(items) if j != i for d in range(10 - suffix.shared(r, r2), suffix.shared(b, b2) + 1)}
            assert {d for s, e in got[i] for d in range(s, e + 1)} == want


def test_near_duplicates(spark, awkward, nothing):
    random.seed(8)
    base = [f"w{random.randint(0, 5000)}" for _ in range(300)]
    near = [w if k not in (50, 200) else "changed" for k, w in enumerate(base)]
    far = [w if k % 7 else "other" for k, w in enumerate(base)]
    rows = spark.createDataFrame([(5, " ".join(base)), (9, " ".join(near)), (7, " ".join(far)), (8, None), (6, ""), (2, "a b"), (3, "a b"), (4, "b a")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(rows).collect()}
    assert got == {5: 5, 9: 5, 7: 7, 8: 6, 6: 6, 2: 2, 3: 2, 4: 4}
    assert {r.doc_id for r in neardup.keep_one(rows).collect()} == {5, 7, 6, 2, 4}
    assert neardup.classes(awkward).count() == awkward.count()
    assert neardup.keep_one(awkward).where("text = '...'").count() == 1
    assert neardup.classes(nothing).count() == 0


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 10), (10, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, 30: 10}


def test_nearest_neighbours_recall(spark):
    import numpy as np

    random.seed(9)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 16)).round(3)
    v[100:160] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (1080, [None] * 16)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 400, 20))
    hits = 0
    for q, found in by.items():
        s = (v * v[q]).sum(1)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        hits += len(set(want) & {i for _, i, _ in found})
        assert len(found) == 20
    assert hits >= 0.9 * 20 * len(by)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), "id % 20 = 0").count() == 0


def test_hilbert_curve_steps_by_one():
    import numpy as np

    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    path = grid[np.argsort(ann.hilbert(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_html():
    page = (
        "<!DOCTYPE html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site name</header><nav><ul><li><a href=x>Home</a></li></ul></nav>"
        "<main><h1>A &amp; B</h1><p>One <b>bo</b>ld\n text<br>next</p><form>Mail <input></form><div class='cookie-notice'>We use cookies</div><p>Second &#233;</p><section id=comments><p>First! comment here</p></section></main>"
        "<aside>See also</aside><footer>&copy; me</footer>"
    )
    assert html.extract(page) == "A & B One bold text next Second é"
    assert html.extract(None) == html.extract("") == html.extract("<nav><a>x</a></nav>") == ""
    assert html.extract("<article><p>cut off &am") == "cut off &am"


def test_html_rows(spark, awkward):
    assert html.extract_text(awkward.withColumnRenamed("text", "html")).count() == awkward.count()


def test_language(spark, awkward, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where("doc_id % 4 <> 0"))
    got = langid.identify(docs.where("doc_id % 4 = 0"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    rows = langid.identify(awkward, model).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if not re.search(r"[^\W\d_]", r.text or "")) and all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(docs, langid.train(nothing)).where("lang_pred <> 'und'").count() == 0


def test_suffix_automaton_phrases():
    import numpy as np

    words = ["abab", "bca"]
    auto = langid.SuffixAutomaton(words)
    alphabet = {c: k + 1 for k, c in enumerate("abc")}
    known = {w[i:j] for w in words for i in range(4) for j in range(i + 1, 5)}
    random.seed(1)
    for _ in range(300):
        x = "".join(random.choice("abcd") for _ in range(random.randint(1, 12)))
        want, at = 0, 0
        while at < len(x):
            n = max((n for n in range(1, len(x) - at + 1) if x[at : at + n] in known), default=1)
            want, at = want + 1, at + n
        codes = np.array([alphabet.get(c, 0) for c in x])
        assert langid.phrases(auto.table(alphabet), codes, np.array([0]), np.array([len(x)]))[0] == want


def test_toxicity(spark, awkward, nothing):
    random.seed(2)
    plain = lambda: " ".join(random.choice(["alpha", "beta", "gamma", "delta", "river", "stone", "cloud"]) + random.choice("abcdef") for _ in range(60))
    rows = [(i, plain() if i % 4 else plain() + " zorgblat " + plain(), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    model = toxicity.train(docs.where("doc_id < 300"), labels.where("doc_id < 300"))
    got = toxicity.score(df.where("doc_id >= 300"), model).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in toxicity.score(awkward, model).collect())
    assert toxicity.score(docs, toxicity.train(nothing, labels)).where("score <> 0").count() == 0


def test_chat_paths_and_round_trip(spark):
    m = [("t", 1, None, "user", "q \\ ### </turn> \\h"), ("t", 2, 1, "assistant", "a\n</turn>\n### user: x"), ("t", 3, 1, "assistant", None), ("t", 4, 2, "us:er", "\\\\e"), ("x", 1, 99, "user", "orphan"), ("c", 1, 2, "user", "on"), ("c", 2, 1, "user", "a cycle")]
    rows = spark.createDataFrame([(*r, float(r[1])) for r in m], "tree string, id long, parent long, role string, text string, score double")
    out = chat.format_trees(rows).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("mask"))).collect()
    got = {(r.tree, r.leaf): (r["rank"], [(t.role, t.text) for t in r.turns], r.loss) for r in out}
    assert got == {
        ("t", 4): (1, [("user", m[0][4]), ("assistant", m[1][4]), ("us:er", m[3][4])], m[1][4]),
        ("t", 3): (2, [("user", m[0][4]), ("assistant", "")], ""),
        ("x", 1): (1, [("user", "orphan")], ""),
    }
    assert chat.format_trees(rows.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    classes = neardup.classes(docs.select("doc_id", "text"))
    kept = {r.doc_id for r in got.collect()}
    assert kept <= {r.doc_id for r in classes.where("doc_id = class_id").collect()}
    assert len(kept) >= 0.95 * classes.where("doc_id = class_id").count()
    assert len(corpus_pipeline.STAGES) == 5
