"""The text operators do the whole job: cases that a shortcut would lose."""

import random

from graphloom.llm import ann, html, neardup, toxicity


def test_near_duplicates_of_short_and_of_moved_texts(spark):
    r = random.Random(1)
    rows, partner = [], {}

    def pair(a, b):
        partner[len(rows)] = len(rows) + 1
        rows.extend([(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))])

    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    for n in (8, 9, 10, 11, 12, 13, 14):
        for _ in range(4):
            a = words(n)
            pair(a, a + words(1))
    for _ in range(20):
        a = words(120)
        pair(a, a[60:] + a[:60])
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] == a for a, b in partner.items())


def test_near_duplicates_of_repeated_lines(spark):
    line, other = "the same line of some seven words", " ".join(f"t{i}" for i in range(40))
    more = " ".join(f"v{i}" for i in range(20))
    rows = [
        (1, " ".join([line] * 100)), (2, " ".join([line] * 60)),  # the same set of shingles
        (3, " ".join([line] * 30 + [other])), (4, " ".join([line] + [other])),  # with and without repeats
        (5, " ".join([more] + [line.replace("same", "own")] * 80)), (6, " ".join([line.replace("same", "own")] * 80)),  # alike only if repeats count
        (7, "a b c d e a b c d e a b c d e"), (8, "a b c d e a b c d e a b c d e a b c d e a b c d e a b c d e"),  # short sets
    ]
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7}


def test_nearest_neighbours_of_repeated_rows(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(100, 8)).round(3)
    # the nearest ids of query 0 have 30 rows each, and id 7 has other, worse rows too
    s = (v * v[0]).sum(1)
    many = sorted(range(1, 100), key=lambda i: (-s[i], i))[:3]
    rows = [(i, v[i].tolist()) for i in range(100) for _ in range(30 if i in many else 2)] + [(7, (-v[0]).tolist())] * 25
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0", target=1.0).collect()
    for q in range(0, 100, 20):
        of = (v * v[q]).sum(1)
        of[7] = max(of[7], -(v[0] * v[q]).sum())
        want = sorted((i for i in range(100) if i != q), key=lambda i: (-of[i], i))[:20]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_html_of_unclosed_and_self_closed_elements():
    for icon in ("<svg viewBox='0 0 1 1'/>", "<svg>", "<math/>", "<object data=x>", "<iframe src=x>", "<video src=/x/>", "<select>", "<canvas>", "<noscript>", "<script src=x /></script>", "<svg><title>i</title></svg>", "<audio/>"):
        page = f"<body><article><p>One {icon} two</p><p>three</p><svg><text>hidden</text></svg><script>hidden()</script></article>"
        assert html.extract(page) == "One two three", icon
    for head in ("<head><title>t</title>", "<head><meta charset=x><style>p{}</style>", "<head>"):
        assert html.extract(f"<html>{head}<article><p>the text</p></article></html>") == "the text"
    assert html.extract("<article><p>a</p><script>var x = 1;") == "a"


def test_toxic_words_of_few_texts_are_learnt():
    r = random.Random(5)
    usual = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000)]
    rare = [f"{a}{b}rglvex" for a in "qwzxy" for b in "uvwxyz"]
    text = lambda more="": " ".join(r.choice(usual) for _ in range(30)) + more
    # each of 30 words in 1.5 % of 2,000 toxic texts, and about half of them have none
    toxic = [text(f" {rare[i % 30]}" if i < 900 else "") for i in range(2000)]
    marks = toxicity.choose_marks(toxic, [text() for _ in range(2000)])
    assert all(any(f" {w} ".startswith(m) for m in marks) for w in rare)
    assert sum(not any(f" {w} ".startswith(m) for w in rare) for m in marks) <= 5


def test_html_of_what_an_element_has():
    assert html.extract("<main class='has-sidebar'><p>one two</p></main>") == "one two"
    assert html.extract("<article class='post no-comments'><p>one two</p></article>") == "one two"
    assert html.extract("<article><p>one</p><div class='cookie-notice'>x</div><article class=comment><p>y</p></article><p>two</p></article>") == "one two"
    # no markup of an article: words and links decide
    text = " ".join(["word"] * 60)
    assert html.extract(f"<div><a href=a>Home</a></div><div><a href=b>News</a></div><div>{text}</div><div>{text}</div><div><a href=c>Next</a></div>") == f"{text} {text}"
