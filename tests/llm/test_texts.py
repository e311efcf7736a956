"""Decontamination, license scan, HTML and toxicity."""

import random
import re
from html import unescape

import numpy as np
import pytest

from tests.llm.conftest import frame, rows_of
from voxledger.llm import decontamination, htmltext, licenses, toxicity


def _edited(rnd, t, k):
    t = list(t)
    for _ in range(k):
        at, kind = rnd.randrange(len(t)), rnd.choice("sid")
        t[at : at + (kind != "i")] = [] if kind == "d" else [f"zz{rnd.randrange(99)}"]
    return t


def test_edits():
    assert decontamination.edits([1, 2, 3], [9, 1, 2, 3, 9], 1) == (0, 1, 4)
    assert decontamination.edits([1, 2, 3], [9, 1, 3, 9], 1)[0] == 1
    assert decontamination.edits([1, 2, 3], [7, 8], 1)[0] == 2


def test_leaks(spark, small, documents):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    bench = {r.item_id: decontamination.tokens(r.text) for r in items.collect()}
    want = set()
    for r in documents.collect():
        joined = " " + " ".join(decontamination.tokens(r.text)) + " "
        want |= {(r.doc_id, i) for i, t in bench.items() if f" {' '.join(t)} " in joined}
    got = decontamination.contaminated(documents, items)
    exact = {(r.doc_id, r.item_id) for r in got.where("distance = 0").collect()}
    assert exact == want and got.where("distance > item_words * 0.2").count() == 0
    left = {r.doc_id for r in decontamination.without_leaks(documents, items).collect()}
    assert left == {r.doc_id for r in documents.collect()} - {r.doc_id for r in got.collect()}
    assert rows_of(decontamination.leaks(documents, items, block_items=7)) == rows_of(decontamination.leaks(documents, items))


def test_leaks_with_edits(spark, small, documents):
    rnd = random.Random(1)
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    clean = [decontamination.tokens(r.text) for r in documents.limit(40).collect()]
    rows = []
    for n, r in enumerate(items.collect()):
        t = decontamination.tokens(r.text)
        for rep in range(4):
            host = clean[(n + rep) % len(clean)]
            at = rnd.randrange(len(host) + 1)
            rows.append((r.item_id * 10 + rep, " ".join(host[:at] + _edited(rnd, t, int(0.05 * (rep + 1) * len(t))) + host[at:]).upper()))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), items).collect()}
    found = sum((i, i // 10) in got for i, _ in rows)
    assert found >= 0.95 * len(rows)


@pytest.mark.parametrize("n", [15, 30, 59, 80, 150, 400])
def test_leaks_of_every_length(n):
    """With any number of edits up to the limit, every copy is found at its smallest distance."""
    rnd = random.Random(n)
    for k in sorted({int(share * n) for share in (0, 0.02, 0.05, 0.1, 0.2)}):
        for _ in range(10):
            words = [f"w{rnd.randrange(5000)}" for _ in range(n)]
            item = decontamination.Items([(7, " ".join(words))])
            text = [item.vocabulary.get(w, 0) for w in ["x"] * rnd.randrange(50) + _edited(rnd, words, k) + ["y"] * rnd.randrange(50)]
            want = decontamination.edits(item.words[0], text, int(0.2 * n))
            assert list(item.matches([np.array(text, dtype=np.uint64)])) == [(0, 0, *want)] and want[0] <= k


@pytest.mark.parametrize("n", [15, 30, 59, 80, 150, 400])
@pytest.mark.parametrize("share", [0, 0.02, 0.05, 0.1, 0.2])
def test_recall_of_walks(n, share):
    """Walks over segments lead to the places that the exact search finds; nothing else is reported."""
    rnd = random.Random(n)
    found = 0
    for _ in range(20):
        words = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        item = decontamination.Items([(7, " ".join(words))])
        edited = _edited(rnd, words, int(share * n))
        text = np.array([item.vocabulary.get(w, 0) for w in ["x"] * rnd.randrange(50) + edited + ["y"] * rnd.randrange(50)], dtype=np.uint64)
        got = list(decontamination.Segments(item).matches([text]))
        assert not got or got == list(item.matches([text]))
        found += len(got)
    assert found >= 18 and (share or found == 20)


def test_exact_search_agrees(spark, small, documents):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    assert rows_of(decontamination.leaks(documents, items)) == rows_of(decontamination.leaks(documents, items, exact=True))


def test_leaks_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (4, "x"), (None, "solo item here now")], "item_id long, text string")
    d = frame(spark, [(1, None), (2, ""), (None, "a one two three, FOUR five six seven!"), (5, "x"), (6, "solo item here now")], "item_id")
    got = rows_of(decontamination.contaminated(d, items).select("doc_id", "item_id", "distance"))
    assert got == sorted([(None, 1, 0), (5, 4, 0), (6, None, 0)], key=repr)
    left = decontamination.without_leaks(d, items)
    assert left.columns == d.columns and rows_of(left.select("doc_id")) == [(1,), (2,)]
    assert decontamination.contaminated(d, items.limit(0)).count() == 0
    assert decontamination.contaminated(frame(spark, []), items).count() == 0


def _shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def _licenses(text):
    """License by containment in any window of a template's length around a shared shingle; the fullest wins a place."""
    sh, best = _shingles(text), {}
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            own = set(_shingles(t))
            if own and len(own & set(sh)) / len(own) >= 0.8:
                for i, s in enumerate(sh):
                    if s in own:
                        best.setdefault(i, []).append((len(own & set(sh)) / len(own), name))
    return {n for v in best.values() for c, n in v if c == max(v)[0]}


def test_licenses(spark, documents):
    rows = [(1_000_000 + i, f"Some text before it.\n{t}\nand after") for i, t in enumerate(t for v in licenses.TEMPLATES.values() for t in v)]
    rows += [(900, None), (901, ""), (902, "MIT License"), (903, "no licence at all " * 2000)]
    long = licenses.TEMPLATES["MIT"][3].split()
    rows += [(904, "x y z " * 50 + " ".join(long[:20] + ["changed"] + long[21:]) + " q" * 40)]
    docs = frame(spark, rows, "license_id").unionByName(documents, allowMissingColumns=True)
    want = sorted(((r.doc_id, n) for r in docs.select("doc_id", "text").collect() for n in _licenses(r.text)), key=repr)
    assert rows_of(licenses.license_notices(docs).select("doc_id", "license_id")) == want
    assert {n for i, n in want if i == 904} == {"MIT"}
    assert licenses.license_notices(frame(spark, [])).count() == 0


PAGE = """<html><head><title>x</title></head><body class="has-comments"><header><h2>Site</h2></header>
<nav><a href=1>Home</a></nav><div id="cookie-notice">We use cookies here and that is the way it is for all of you.</div>
<div class="sidebar"><p>The sidebar of the site is here and it was there with the links.</p></div>
<article><header><h1>Title &amp; more</h1></header><p>The first of the things that are <b>in</b> the article.</p>
<!-- no --><form><p>Sign up</p></form><aside>See also</aside><ul><li>one<li>two</ul><p>x &lt; y&nbsp;z<script>"</p>"</script></p>
<div class="related"><a href=2>more</a></div></article><section id="comments"><article class="comment"><p>A reader said that it was
so and that it is good for all of us.</p></article></section><footer>c</footer><script>var a="</p>";"""


def test_common_licenses(spark):
    names = ["LGPL-2.1", "BSD-2-Clause", "EPL-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "Apache-2.0"]
    texts = [(k, n, t) for k, (n, t) in enumerate((n, t) for n in names for t in licenses.TEMPLATES[n])]
    docs = frame(spark, [(k, f"some words before it {t} and some words after it") for k, _, t in texts])
    got = licenses.license_notices(docs).select("doc_id", "license_id")
    assert rows_of(got) == sorted(((k, n) for k, n, _ in texts), key=repr)


def test_main_text():
    assert htmltext.main_text(PAGE) == "Title & more The first of the things that are in the article. one two x < y z"
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<div><a href=1>a</a>") == ""
    prose = "It was the best of the times and it was the worst of them, as he said to all who were with him on that day."
    loose = f"<div>Short one</div><p>{prose}</p><p>Yes.</p><p>{prose}</p><div><a href=x>Link one</a> <a href=y>two</a></div>"
    assert htmltext.main_text(loose) == f"Short one {prose} Yes. {prose}"
    assert htmltext.main_text("<article>" + "<div>" * 5000 + "deep") == "deep"


def test_main_text_in_wrappers():
    """Names of wrappers do not empty a page; what they name beside an article still goes."""
    prose = "This is the story of a house that was built by the sea and of all the people who have lived in it. "
    page = f"<article><p>{prose * 3}</p></article><div class='ad'>{prose}</div>"
    want = " ".join((prose * 3).split())
    for start in ("<div class='site has-sidebar'>", "<div id='page' class='no-comments'>", "<div class='social search'>"):
        assert htmltext.main_text(f"<body>{start}{page}</div></body>") == want
    assert htmltext.main_text(f"<article class='post legal'><p>{prose}</p></article>") == prose.strip()
    beside = f"<div class='sidebar'><article>{prose}</article></div><div class='comments'><article>{prose * 9}</article></div>"
    assert htmltext.main_text(page + beside) == want
    other = "Taloon muutti viime kesänä uusi perhe, joka oli asunut siihen asti kaupungissa meren rannalla kauan. "
    assert htmltext.main_text(f"<div><p>{other}</p></div><div class='ad'>x</div>") == other.strip()


PROSE = "The first of the things that are in the article is that it was long and that there is more to be said of it."


@pytest.mark.parametrize(
    "page",
    [
        "<div class='wrap overflow-hidden'><article><p>{}</p></article></div>",
        "<div class='wrap overflow-hidden'><p>{}</p></div>",
        "<article data-title='The hidden cost'><p>{}</p></article>",
        "<article class='post comments-open'><p>{}</p></article>",
        "<p title='the hidden truth'>{}</p>",
        "<p data-style='display:none'>{}</p>",
        "<p class='skip-lazy'>{}</p>",
        "<main class='page-with-comments no-footer'><p>{}</p></main>",
        "<div class='modal-content'><p>{}</p></div>",
        "<div class=nav-wrapper><div class='menu-body'><article><p>{}</p></article></div></div>",
        "<div class='menu'><a href=1>x</a></div><div id='footer'><article><p>{}</p></article></div>",
        "<div CLASS='footer'>{0}</div><div Hidden>{0}</div><p style='color:red; DISPLAY : none'>{0}</p><div role='main'>{0}</div>",
        "<article>{0}</article><div class='site-footer'>{0}</div><div class='comment-list'><article>{0} {0} {0}</article></div>",
        "<article>{0}</article><div class='cookie-banner'><p>{0}</p></div><span class='visually-hidden'>{0}</span>",
        "<article><p>{0}</p><div class='hidden'><p>{0}</p></div><div id='disqus_thread'>{0}{0}{0}</div></article>",
    ],
)
def test_names_of_elements(page):
    assert htmltext.main_text(page.format(PROSE)) == PROSE


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extracted(pages).collect()}
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r.html)[1]
        parts = re.split(r"</?(?:h1|p|br)>", re.sub("</?b>", "", body))
        assert got[r.page_id] == " ".join(" ".join(unescape(p) for p in parts).split())
    odd = spark.createDataFrame([(1, None, "u", None), (1, None, "u", None), (None, "", None, "t")], "page_id long, html string, url string, text string")
    assert rows_of(htmltext.extracted(odd)) == sorted([(1, "u", ""), (1, "u", ""), (None, None, "")], key=repr)
    assert htmltext.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["an 1d10t here", "an idi0t!", "аn іdіоt", "i.d.i.o.t", "IDIOT%%%", "i​diot", "ｉｄｉｏｔ", "i-d-i-o-t."])
def test_folding(text):
    assert " idiot " in toxicity.folded(text)


def test_folding_leaves_plain_text():
    assert toxicity.folded("Das für 2021, l'été 3% $$$ and*** C3PO") == " das für l été and cepo "
    assert toxicity.folded(None).strip() == toxicity.folded("").strip() == ""


def test_toxicity(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    got = toxicity.scored(docs, lexicon).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert len(got) > 50 and right >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)
    word = max((e for e in lexicon.weights), key=lambda e: lexicon.weights[e]).strip()
    odd = frame(spark, [(1, None), (2, ""), (3, f"you {word}" ), (None, "fine text here"), (3, "w " * 100_000 + word)], "score")
    res = sorted(((r.doc_id or 0), r.predicted) for r in toxicity.scored(odd, lexicon).collect())
    assert res[:4] == [(0, 0), (1, 0), (2, 0), (3, 0)] or res == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0
    empty = toxicity.learn(docs, labels.limit(0))
    assert empty.weights == {} and toxicity.scored(docs, empty).where("predicted = 1").count() == 0


def test_exceptions():
    lexicon = toxicity.Lexicon({" trash": 9.0}, -5.0, 3.0)
    a = lexicon.automaton()
    assert toxicity.load(a, toxicity.folded("put it in the trash can now")) == 0
    assert toxicity.load(a, toxicity.folded("you are trash, put it in the trash can")) > 3
