"""Main text of pages, against pages with a known article and a plain reading of the given pages."""

import random
from html.parser import HTMLParser

import numpy as np
import pytest

from rainweave.llm import html_text

ARTICLE = "<article><h1>Rain &amp; <b>radar</b></h1><p>A first   paragraph, long enough\nto stand. It ends.<p>Second one: caf&eacute; &#8364;5 &lt;b&gt;.<br>After a break<ul><li>An item, not a link</li><li><a href=x>Linked</a> item</ul><p>Short.</article>"
TEXT = "Rain & radar A first paragraph, long enough to stand. It ends. Second one: café €5 <b>. After a break An item, not a link Linked item Short."
MENU = "<nav><ul><li><a href='/a'>Home</a><li><a href=/b>News</a></ul></nav>"
AROUND = [
    "", MENU, "<header><h1>The Daily Site</h1><p>Motto, of some length.</p></header>", "<div class='ad box'>Buy this. Now, or never!</div>",
    "<aside>Elsewhere, some text. And more of it.</aside>", "<div id=cookie-notice>We use cookies, as you know. Accept?</div>", "<!-- <p>not this</p> -->",
    "<form action='/s'><label>Search</label><input value='text'><button>Go</button></form>", "<script>var t='</p><p>no, not this.</p>';</script>",
    "<style>p{margin:0}</style>", "<noscript>Please enable scripts.</noscript>", "<div class=\"sidebar\"><h3>Most read</h3><p>One headline, two.</p></div>",
    "<section class='comments'><h2>3 comments</h2><article class=comment><p>I disagree, strongly. Really!</p></article></section>",
    "<footer>&copy; 2020 Somebody, all rights reserved. <a href=/x>Contact</a></footer>", "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>",
    "<template><p>Never, ever shown.</p></template>", "<div hidden><p>Hidden text, long.</p></div>", "<div role='navigation'><a href=/>All</a> <a href=/b>Best</a></div>",
]


@pytest.mark.parametrize("seed", range(25))
def test_article_in_any_surroundings(seed):
    rng = random.Random(seed)
    before, after = ("".join(rng.sample(AROUND, rng.randrange(len(AROUND)))) for _ in range(2))
    pages = [
        f"<html><head><title>T. x, y</title></head><body>{before}{ARTICLE}{after}</body></html>",
        f"<body class='has-sidebar'><div class='wrapper menu-open'><form id=aspnetForm>{before}<main>{ARTICLE}</main>{after}", before + ARTICLE,
    ]
    for page in pages:
        assert " ".join(html_text.main_blocks(page)) == TEXT


@pytest.mark.parametrize("k", range(len(AROUND)))
def test_parts_within_the_article(k):
    inner = AROUND[k]
    if "<h1>" in inner or "hidden" in inner and "<p" not in inner:
        inner = ""
    page = f"<body>{MENU}{ARTICLE.replace('<p>Short.', inner + '<p>Short.')}<footer>x, y.</footer>"
    assert " ".join(html_text.main_blocks(page)) == TEXT


def test_pages_without_an_article_element():
    body = "".join(f"<p>Paragraph {i} with a good deal of text, commas and stops. It goes on, and on; to the end.</p>" for i in range(6))
    want = " ".join(f"Paragraph {i} with a good deal of text, commas and stops. It goes on, and on; to the end." for i in range(6))
    links = "<div>" + "".join(f"<a href=/{i}>Link {i}</a> " for i in range(12)) + "</div>"
    assert " ".join(html_text.main_blocks(f"<body>{links}<div><div class=content><h1>Title</h1>{body}</div></div><div>Imprint</div>")) == "Title " + want
    assert " ".join(html_text.main_blocks(f"<body>{MENU}{links}<h2>Title</h2>{body}<div>Imprint</div>")) == "Title " + want
    assert " ".join(html_text.main_blocks(f"<table><tr><td><a href=1>A</a><td>{body}<tr><td>x</table>")) == want


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "plain text, no tags", 3), (3, "u", "plain text, no tags", 3), (4, "u", MENU, 4), (5, "u", "<article></article>", 5),
            (6, "u", "<p>a < b & c &amp d &bogus; e</p", 6), (7, "u", "<article><p>Ein <i>Wort</i>s<span>al</span>at.", 7), (None, "u", "<article><p>" + "long text, " * 100_000, 8), (8, "u", "<article>" + "<div>" * 3000 + "deep", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(pages.repartition(3)).collect()), key=str)
    want = [(1, "u", ""), (2, None, ""), (3, "u", "plain text, no tags"), (3, "u", "plain text, no tags"), (4, "u", ""), (5, "u", ""),
            (6, "u", "a < b & c & d &bogus; e"), (7, "u", "Ein Wortsalat."), (None, "u", ("long text, " * 100_000).strip()), (8, "u", "deep")]
    assert got == sorted(((i, u, t, len(t)) for i, u, t in want), key=str)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_scores_equal_plain_ratios():
    rng = random.Random(2)
    paths, lengths, marks = [rng.choice(["/a", "/a/b", "/c"]) for _ in range(50)], [rng.randrange(500) for _ in range(50)], [rng.randrange(9) for _ in range(50)]
    fused = []
    for p in paths:
        own = [k for k in range(50) if paths[k] == p]
        fused.append(sum(lengths[k] for k in own) / len(own) * (1 + sum(marks[k] for k in own) / len(own)))
    smooth = [0.25 * fused[max(k - 1, 0)] + 0.5 * fused[k] + 0.25 * fused[min(k + 1, 49)] for k in range(50)]
    assert np.allclose(html_text.path_scores(paths, lengths, marks), smooth)


class Plain(HTMLParser):
    """Text of the article element of a given page; every tag but ``b`` ends a block."""

    def __init__(self):
        super().__init__()
        self.blocks, self.on = [""], False

    def handle_starttag(self, tag, attrs):
        if tag != "b":
            self.blocks.append("")
        self.on |= tag == "article"

    def handle_endtag(self, tag):
        if tag != "b":
            self.blocks.append("")
        self.on &= tag != "article"

    def handle_data(self, data):
        self.blocks[-1] += data if self.on else ""


def test_given_pages(spark):
    folder = "/root/testdata/sf0.01"
    rows = html_text.extract_text(spark.read.parquet(f"{folder}/pages.parquet")).join(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250
    for r in rows:
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        assert r.text == " ".join(" ".join(plain.blocks).split()) and r.n_chars == len(r.text)
