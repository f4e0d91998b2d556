"""Main text of pages against written expectations, and the cut against all labellings."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from screenlake.llm import html_text as h
from screenlake.llm.common import table

SCHEMA = "page_id long, url string, html string, text string, n_chars int"
ODDS = h.fit_shapes([])
LONG = "The committee met again on Tuesday, and after several hours of debate it agreed on the first part of the plan."


def cost(score, edges, label):
    """What a labelling breaks: terminal links of the other side and edges between sides."""
    return sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(score, label, strict=True)) + sum(c for i, j, c in edges if label[i] != label[j])


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_the_cheapest_and_the_largest(seed):
    r = random.Random(seed)
    n = r.randint(1, 10)
    score = [r.randint(-6, 6) for _ in range(n)]
    edges = [(i, j, r.randint(0, 5)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
    every = list(itertools.product([False, True], repeat=n))
    least = min(cost(score, edges, x) for x in every)
    best = max((x for x in every if cost(score, edges, x) == least), key=sum)
    assert tuple(h.minimum_cut(score, edges)) == best


def test_long_undecided_chain():
    n = 20_000
    r = random.Random(4)
    score = [r.choice([-500, 500, -300, 400]) for _ in range(n)]
    edges = [(i - 1, i, 800) for i in range(1, n)]
    got = h.minimum_cut(score, edges)
    # a chain has a plain solution: the best total for each label of the last block
    best = {True: (max(-score[0], 0)), False: max(score[0], 0)}
    for s in score[1:]:
        best = {x: min(best[y] + (800 if x != y else 0) for y in best) + (max(-s, 0) if x else max(s, 0)) for x in best}
    assert cost(score, edges, got) == min(best.values())


PAGES = {
    "semantic": (
        f"""<!doctype html><html><head><title>Gone</title><style>p > b {{}}</style><script>if (a < b) document.write("<p>no</p>")</script></head>
        <body class="has-sidebar"><header><a href="/">Site</a><p>{LONG}</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
        <div class="cookie-notice"><p>{LONG}</p><button>OK</button></div>
        <main><article><header><h1>A  title &amp; more</h1></header><p>First<br>part, <b>bold</b>ly&nbsp;said.<p>Of.<div class="ad">{LONG}</div>
        <form><label>Your mail</label><input name=q></form><ul><li>one</li><li>two</li></ul><table><tr><td>a<td>b</table><aside><p>{LONG}</p></aside>
        <blockquote>{LONG}</blockquote><!-- no <p>{LONG}</p> --><p>Last &lt;tag&gt; 3 < 4 &eacute;&#33;</p><footer>By X</footer></article>
        <section id="comments"><article class="comment"><p>{LONG}</p></article></section></main>
        <aside class="sidebar"><p>{LONG}</p></aside><footer><p>&copy; 2024 {LONG}</p></footer></body></html>""",
        ["A title & more", "First part, boldly said.", "Of.", "one", "two", "a", "b", LONG, "Last <tag> 3 < 4 é!"],
    ),
    "no meaning in the tags": (
        f"""<div><div><a href=1>Home</a> | <a href=2>World</a> | <a href=3>Sport</a></div><div><a href=4>Sign in</a></div></div>
        <div><h2>On the plan</h2><div>{LONG} {LONG}</div><div>{LONG}</div><div>So it was.</div><div>{LONG} {LONG} {LONG}</div></div>
        <div><div><a href=5>Imprint</a></div><div>© 2024. All rights reserved</div></div>""",
        ["On the plan", f"{LONG} {LONG}", LONG, "So it was.", f"{LONG} {LONG} {LONG}"],
    ),
    "names": (
        f"""<div id="top-nav"><p>{LONG}</p></div><div class="post-content"><h1>T</h1><p>Short.</p><p>{LONG}</p><div class="shareButtons">{LONG}</div></div>
        <div class="commentList"><p>{LONG}</p></div><div style="display: none"><p>{LONG}</p></div><div role=contentinfo>{LONG}</div>""",
        ["T", "Short.", LONG],
    ),
    "one form around the page": (f"<form action=x><div class=menu>{LONG}</div><article><p>{LONG}</p></article></form>", [LONG]),
    "never closed": (f"<nav><a>x</a></nav><article><p><b>One, two.<br><p>{LONG}<script>var a='{LONG}'", ["One, two.", LONG]),
    "quotes and broken tags": (f'<article title="a > b"><p class="x>{LONG}</p><p>{LONG} <3 & <b</p></article>', None),
    "plain text": (f"{LONG} {LONG} {LONG}", [f"{LONG} {LONG} {LONG}"]),
    "nothing": ("", []),
    "only boilerplate": (f"<nav>{LONG}</nav><footer>{LONG}</footer>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    got = h.main_text(page, ODDS)
    assert want is None or got.split("\n") == (want or [""])


def expected(page):
    """The generated pages: blocks of the one article."""
    article = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"<p>|</p>|</?h1>", article[1]) if article else []
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts) if t)


def test_tables(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {r.page_id: expected(r.html) for r in pages.collect()}
    got = h.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_nulls_repeats_and_long_pages(spark):
    long_page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "t", 1), (1, "u", PAGES["names"][0], "t", 1), (1, "u", PAGES["names"][0], "t", 1), (None, None, PAGES["names"][0], None, None), (2, "u", long_page, "", 0), (3, "u", "", "", 0)]
    got = sorted(((r.page_id, r.url, r.n_chars) for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    n = len("\n".join(PAGES["names"][1]))
    assert got == sorted([(1, "u", 0), (1, "u", n), (1, "u", n), (None, None, n), (2, "u", 20_000 * (len(LONG) + 1) - 1), (3, "u", 0)], key=str)
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shape_model_learns_from_labelled_blocks(spark):
    """Where navigation is long sentences and articles are short links, the weights turn."""
    page = "<article>" + "<div><a href=x>go on</a></div>" * 5 + "</article><nav>" + f"<p>{LONG}</p>" * 5 + "</nav>"
    rows = [(i, "", page + f"<i>{i}</i>", "", 0) for i in range(40)] + [(i, "", page, "", 0) for i in range(40, 80)]
    counts = h.shape_counts(spark.createDataFrame(rows, SCHEMA), most=10).collect()
    assert sum(r.n for r in counts) == 100  # ten distinct pages of ten labelled blocks
    odds = h.fit_shapes([tuple(r) for r in counts])
    shapes = {label: next(r["shape"] for r in counts if r.label == label) for label in (0, 1)}
    assert odds[shapes[1]] > 0 > odds[shapes[0]] and ODDS[shapes[1]] < 0 < ODDS[shapes[0]]
    assert np.isfinite(odds).all()
