"""Block parsing, the labeller's training, and main text of whole pages."""

import html
from html.parser import HTMLParser

import numpy as np
import pytest

from cairn.llm import html_layouts, html_text
from cairn.llm.html_blocks import leaf_blocks
from cairn.llm.queries import op11_html_text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return html_text.fit(html_text.sampled(spark.read.parquet(f"{SF}/pages.parquet")))


@pytest.mark.parametrize("page, want", [
    (None, []), ("", []), ("  \n ", []), ("<", ["<"]), ("a < b &amp; c", ["a < b & c"]),
    ("<p>1<p>2<ul><li>a<li>b</ul>t", ["1", "2", "a", "b", "t"]),
    ("<p>one\n <b>two</b>\tthree<br>four&nbsp;five</p>", ["one two three four five"]),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><div>yes", ["yes"]),
    ("<script>never ended <p>x", []), ("<!-- never ended <p>x", []), ("<p>a<b", ["a"]),
    ("<head><title>t</title><p>q", ["q"]), ("<title>a</title>b", ["b"]), ("<noscript><p>x</p></noscript>y", ["y"]),
    ('<p title="a > b">x</p>', ["x"]), ("<p>a&ampb &copy &#233;&#x41; &unknown;</p>", ["a&b © éA &unknown;"]),
    ("<div>a<div>b</div>c</div>", ["a", "b", "c"]), ("</p></div>x", ["x"]), ("<P>A</P><P>B", ["A", "B"]), ("<p>a<![CDATA[x]]>b<?php x ?>c", ["abc"]),
])
def test_blocks(page, want):
    assert [b.text for b in leaf_blocks(page)] == want


def test_paths_and_links():
    a, b = leaf_blocks('<nav class="Top mainMenu" id=x-1><ul><li><a href="#">Home</a> now</ul></nav><p>t')
    assert a.path == (("nav", "top", "main", "menu", "x", "1"), ("ul",), ("li",)) and a.linked == 4
    assert b.path == (("p",),) and b.linked == 0


@pytest.mark.parametrize("page", ['<a href="x' * 100_000, "<div>" * 100_000 + "x", "<!--" * 100_000, "<p>" * 100_000, "<" * 200_000, "<div>x" * 20_000, "<script>" * 50_000, "<a b=" * 100_000, "&" * 200_000])
def test_hard_pages_take_linear_time(page):
    blocks = leaf_blocks(page)
    assert max((len(b.path) for b in blocks), default=0) <= 512


def test_gradients():
    rng = np.random.default_rng(1)
    model = html_text.Labeller.fresh(5, 3, rng)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    pages = [rng.standard_normal((n, 5)) for n in (1, 4, 6)]
    labels = [rng.integers(0, 2, len(p)).astype(float) for p in pages]
    _, grad = model.gradients(pages, labels)
    for name, w in model.w.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 12)]:
            old, step = w[at], 1e-2
            w[at] = old + step
            up = model.gradients(pages, labels)[0]
            w[at] = old - step
            down = model.gradients(pages, labels)[0]
            w[at] = old
            assert abs((up - down) / (2 * step) - grad[name][at]) < 3e-4, (name, at)


def test_batches_do_not_change_scores():
    rng = np.random.default_rng(3)
    model = html_text.Labeller.fresh(6, 4, rng)
    pages = [rng.standard_normal((n, 6)).astype(np.float32) for n in (3, 0, 17, 1, 40)]
    for page, scores in zip(pages, model.scores(pages)):
        assert np.allclose(scores, model.scores([page])[0], atol=1e-5)


def test_drawn_pages_held_out(model):
    rng, wrong, total = np.random.default_rng(77), 0, 0
    for _ in range(300):
        blocks, labels = html_layouts.draw_page(rng, ["held out words of another kind that no page has", "some. more, words"])
        scores = model.scores([html_text.vectors(blocks)])[0]
        wrong, total = wrong + int(((scores >= 0.5) != np.array(labels)).sum()), total + len(labels)
    assert wrong < 0.04 * total


PAGES = {
    "landmarks": ('<body><header><h1>My site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">Blog</a></ul></nav><main><article><h1>On tea</h1><p>Tea is an old &amp; fine drink.</p>'
                  "<p>It came from far away, and stayed.</p></article></main><aside><h3>Related articles</h3><ul><li><a href='/x'>On coffee</a></ul></aside><footer>© 2024 All rights reserved.</footer>",
                  "On tea\n\nTea is an old & fine drink.\n\nIt came from far away, and stayed."),
    "classes": ('<div class="cookie-banner"><p>We use cookies to improve your experience.</p><button>Accept all</button></div><div class="menu"><a href="/">Home</a></div><div class="post-content"><h1>On salt</h1>'
                '<p>Salt was once worth more than gold, they say.</p><ul><li>Rock salt, from mines.</li><li>Sea salt, from water.</li></ul></div><div class="comments"><h3>Comments</h3><div class="comment"><p>Ann says:</p>'
                '<p>I do not agree at all with this.</p></div></div><div class="ad">Buy now and save 50%!</div><form><label>Name</label><input><button>Send</button></form><div class="footer"><p>Privacy policy</p></div>',
                "On salt\n\nSalt was once worth more than gold, they say.\n\nRock salt, from mines.\n\nSea salt, from water."),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_written_pages(model, name):
    page, want = PAGES[name]
    blocks = leaf_blocks(page)
    assert html_text.main_text(blocks, model.scores([html_text.vectors(blocks)])[0]) == want


class Article(HTMLParser):
    """The blocks of the article element by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.parts.append([])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.parts.append([])

    def handle_data(self, data):
        if self.inside:
            self.parts[-1].append(data)

    def text(self):
        return "\n\n".join(t for p in self.parts if (t := " ".join("".join(p).split())))


def plain(page):
    a = Article()
    a.feed(page)
    a.close()
    return a.text()


def test_given_pages(spark):
    got = op11_html_text(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {r["page_id"]: r for r in got.collect()}
    given = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(given)
    for p in given:
        r = rows[p["page_id"]]
        assert r["text"] == plain(p["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


def test_odd_rows(spark, model):
    long = "<nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>Paragraph {i} of a very long page, with words.</p>" for i in range(6000)) + "</article><footer>© all</footer>"
    rows = [(None, None, None), (1, None, ""), (2, "u", "  <br> "), (3, "u", PAGES["landmarks"][0]), (3, "u", PAGES["landmarks"][0]), (4, "u", long), (5, "u", "<script>x"), (6, "u", html.escape("<p>x</p>") + "\x00퟿")]
    frame = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "page_id long, url string, html string, text string, page__ int, N_CHARS string")
    got = html_text.extract(frame, model=model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = [(r["page_id"], r["text"]) for r in got.collect()]
    texts = dict(found)
    assert len(found) == len(rows) and texts[None] == texts[1] == texts[2] == texts[5] == ""
    assert texts[3] == PAGES["landmarks"][1] and found.count((3, texts[3])) == 2
    assert texts[4].count("\n\n") == 5999
    assert html_text.extract(frame.limit(0), model=model).count() == 0
    assert html_text.extract(frame.limit(0)).count() == 0  # drawn pages alone train a model
