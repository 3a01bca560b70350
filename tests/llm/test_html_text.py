import time

import numpy as np
import pytest

from plotmark.llm import html_text as ht

PAGE = """<html><head><title>t</title><script>var a = "</p>";</script><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><main><h1>Title  here</h1>
<p>First <b>para</b>graph of the &eacute;tude with <!-- not this --> several&nbsp;words.<p>Second &amp; last paragraph,<br>with more words in it.</main>
<aside class="sidebar"><p>Related things</p></aside><div class="comments"><div class="comment"><p>I disagree with this wholly, said the reader.</p></div></div>
<form><label>Name</label></form><footer>&copy; me</footer>"""
ARTICLE = "Title here First paragraph of the étude with several words. Second & last paragraph, with more words in it."


@pytest.fixture(scope="module")
def labeller(spark):
    return ht.fit_labeller(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_a_page_of_another_dress(spark, labeller, no_docs):
    pages = spark.createDataFrame([(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (1, PAGE, "x"), (None, "<p>", None)], "page_id long, html string, text string")
    got = [(r.page_id, r.text) for r in ht.main_text(pages, labeller).collect()]
    assert sorted(got, key=str) == sorted([(1, ARTICLE), (2, ""), (3, ""), (1, ARTICLE), (None, "")], key=str)
    assert ht.main_text(pages.limit(0), labeller).count() == 0


def test_held_out_pages_agree_with_their_markup(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(300).collect()
    right = total = 0
    for p in pages:
        blocks = ht.blocks_of(p.html)
        got = labeller.label([ht.features(blocks)])[0]
        right += int((got == np.array([ht.teacher(b.path) for b in blocks])).sum())
        total += len(blocks)
    assert right >= 0.99 * total


def test_padding_and_batches_change_nothing(labeller, monkeypatch):
    pages = [ht.features(ht.blocks_of(PAGE)), ht.features(ht.blocks_of("<p>a<p>b")), ht.features([]), ht.features(ht.blocks_of(PAGE * 3))]
    alone = [labeller.label([p])[0].tolist() for p in pages]
    monkeypatch.setattr(ht, "CELLS", 5)
    assert [x.tolist() for x in labeller.label(pages)] == alone


def test_gradients():
    m = ht.BlockLabeller()
    x = np.random.default_rng(0).normal(size=(2, 4, ht.PATH_DIM + ht.WORD_DIM + ht.MORE)).astype(np.float64)
    m.weights = {k: w.astype(np.float64) for k, w in m.weights.items()}
    mask = np.array([[True] * 4, [True, True, False, False]])
    trace: list = []
    grad = np.random.default_rng(1).normal(size=(2, 4, ht.HIDDEN))
    m._run(x, mask, "on", trace)
    own = m._back("on", trace, grad)
    for i, j in ((3, 5), (len(own) - 1, 2), (40, 3 * ht.HIDDEN + 1)):
        sides = []
        for e in (1e-3, -1e-3):
            m.weights["on"][i, j] += e
            sides.append(float((m._run(x, mask, "on") * grad).sum()))
            m.weights["on"][i, j] -= e
        assert abs((sides[0] - sides[1]) / 2e-3 - own[i, j]) < 1e-2 * max(1, abs(own[i, j]))


def test_malformed_pages():
    for page in ("<", "<p", "</p></div>", "<div><p>a</div>b", "<!--", "<script>x", "a<b>c<i>d</b>e", "<p class='x>y", "&#xD800;&bogus;"):
        ht.blocks_of(page)
    assert [b.text for b in ht.blocks_of("a<br>b<p>c</p>d")] == ["a b", "c", "d"]


def test_elements_that_close_themselves_hide_nothing():
    texts = lambda page: [b.text for b in ht.blocks_of(page)]
    assert texts("<main><p>first</p><svg width=1 /><p>second</p><math/><p>third</p></main>") == ["first", "second", "third"]
    assert texts("<p>a</p><svg><text>no</text></svg><p>b</p><svg><p>c</p><canvas><p>d") == ["a", "b", "c", "d"]
    assert texts("<p>a<script>x") == ["a"]
    assert texts('<p title="a>b">c</p><p title="d>e</p><p>f') == ["c", "e", "f"]


@pytest.mark.parametrize("part", ["<a ", '<p class="x', "<svg>", "<div>", "</b>", "<!-", "<li><b>", "&amp;", "<p title='>", "<a href=\"'\"> "])
def test_long_malformed_pages_take_linear_time(part):
    began = time.process_time()
    blocks = ht.blocks_of(part * (1_000_000 // len(part)) + "<p>end of it")
    ht.features(blocks[:1000])
    assert time.process_time() - began < 20


STORY = [("Storm over the old harbour", "The boats had been tied up since noon and nobody went out to sea again before the week was over.", "In the morning the pier was gone, and with it the small red house of the harbour master."), ("A new bridge for the valley", "After nine years of planning the council has agreed to build it where the ferry used to cross.", "Work begins in spring and should take no longer than two summers, the engineer said on Monday.")]


def unmarked(i, title, *text):
    return f"<html><body><div class=menu><ul><li><a href=/>Home</a></li><li><a href=/n>News {i}</a></li></ul></div><div class=story><h1>{title}</h1>{''.join(f'<p>{t}</p>' for t in text)}</div><div class=footer>Contact us about page {i}</div></body></html>"


def test_pages_that_mark_nothing(spark):
    """Labelled by hand: the teacher finds no article in them."""
    rows = [(i, unmarked(i, *STORY[i % 2])) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert not any(ht.teacher(b.path) for b in ht.blocks_of(rows[0][1]))
    got = {r.page_id: r.text for r in ht.main_text(pages, ht.fit_labeller(pages)).collect()}
    assert got == {i: " ".join(STORY[i % 2]) for i in range(6)}
    none = ht.fit_labeller(pages.limit(0))
    assert {r.page_id: r.text for r in ht.main_text(pages, none).collect()} == got


def test_the_few_marked_pages_are_found(spark):
    rows = [(i, unmarked(i, *STORY[i % 2])) for i in range(3000)] + [(5000, PAGE)]
    seen = []
    known = ht.BlockLabeller.fit
    try:
        ht.BlockLabeller.fit = lambda self, pages, seed=3: seen.append(len(pages))
        ht.fit_labeller(spark.createDataFrame(rows, "page_id long, html string"))
    finally:
        ht.BlockLabeller.fit = known
    assert seen == [3]


TALK = [("Anna K. says 12", "I lived there as a child and never saw the water come that high."), ("Boris wrote 3", "Nonsense, the old map shows something else entirely!"), ("guest 4471", "Could somebody tell me where the next meeting will be?")]


def _page(kind, i):
    """(html, [(text, part of the article)]) by hand, with names that no list of the labeller has."""
    title, *text = STORY[i % 2]
    text = [*text, "Nothing more is known about it so far, and those who were asked would rather not speak of the matter."]
    menu, end = ["Start", "Town", f"Page {i}"], "Write to the desk by post or telephone."
    told = [(title, True), *((t, True) for t in text)]
    if kind == "reactions":
        body = "".join(f"<div class=rx><div class=who>{a}</div><p>{b}</p></div>" for a, b in TALK)
        page = f"<div class=strip><ul>{''.join(f'<li><a href=/>{m}</a></li>' for m in menu)}</ul></div><div class=zork><h1>{title}</h1>{''.join(f'<p>{t}</p>' for t in text)}</div><div class=reactions><h3>Reactions</h3>{body}</div>"
        return page, [*((m, False) for m in menu), *told, ("Reactions", False), *((x, False) for pair in TALK for x in pair)]
    if kind == "table":
        page = f"<table><tr><td>{''.join(f'<div><a href=/>{m}</a></div>' for m in menu)}</td><td><h1>{title}</h1>{''.join(f'<p>{t}</p>' for t in text)}</td><td class=edge><p>{end}</p></td></tr></table>"
        return page, [*((m, False) for m in menu), *told, (end, False)]
    if kind == "cells":
        page = f"<table><tr><td><a href=/>{menu[0]}</a></td><td><a href=/>{menu[1]}</a></td></tr></table><table class=mid>{''.join(f'<tr><td>{t}</td></tr>' for t, _ in told)}</table>"
        return page, [(menu[0], False), (menu[1], False), *told]
    page = f"<div class=qux><ul>{''.join(f'<li><a href=/>{m}</a></li>' for m in menu)}</ul></div><section class=blurb><h1>{title}</h1>{''.join(f'<p>{t}</p>' for t in text)}</section><div class=tail><p>{end}</p></div>"
    return page, [*((m, False) for m in menu), *told, (end, False)]


@pytest.mark.parametrize("kind, least", [("reactions", 0.95), ("table", 0.85), pytest.param("cells", 0.95, marks=pytest.mark.xfail(reason="a third of the blocks is right; see README")), ("plain", 0.95)])
def test_names_and_layouts_of_no_list(labeller, kind, least):
    """In the table layout one sentence in a cell beside the article may pass for a part of it, one block of eight."""
    right = total = 0
    for i in range(6):
        page, want = _page(kind, i)
        blocks = ht.blocks_of(f"<html><body>{page}</body></html>")
        assert [b.text for b in blocks] == [t for t, _ in want]
        right += sum(bool(g) == w for g, (_, w) in zip(labeller.label([ht.features(blocks)])[0], want, strict=True))
        total += len(want)
    assert right >= least * total


def test_slices_are_bounded_in_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ht, "BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(6)), "html": ["abcd", "abcd", "abcd", None, "x" * 30, "y"]})
    assert [s.column(0).to_pylist() for s in ht._slices(batch)] == [[0, 1], [2, 3], [4], [5]]
    assert [s.num_rows for s in ht._slices(batch.slice(0, 0))] == []
