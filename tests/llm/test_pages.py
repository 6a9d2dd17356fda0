from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest

from pregao.llm import pages, queries

from .test_hilbert import save

LONG = "Ten words of plain prose stand here, and a few more of them follow after that."


def text(page):
    return pages.main_text(page, pages.trained())


def test_blocks_and_their_words():
    found = pages.blocks("<p>a <b>b</b>&amp;c<br>d<a href='x>y'>e f</a><p>  <div class=ad>g<!-- <p>no --></div>h<script>'<p>no'</script>")
    assert [(b.text, b.words, round(b.density, 2), b.boiler) for b in found] == [
        ("a b&c de f", 4, 0.5, 0),
        ("g", 1, 0.0, 1),
        ("h", 1, 0.0, 0),
    ]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", ""),
        (f"<article><h1>Title</h1><p>{LONG}&nbsp;&copy;\n\n x</article>", f"Title\n{LONG} © x"),
        (f"<article><p>{LONG}</p><div class='ad-box'>{LONG}</div><form>{LONG}</form><p>End.</p></article>", f"{LONG}\nEnd."),
        (f"<main><p>{LONG}</p></main><section class='comments'><article><p>{LONG}</p></article></section>", LONG),
        (f"<article><p>{LONG}<style>p{{}}</style><noscript><p>{LONG}</p></noscript></p></article><footer>{LONG}", LONG),
        (f"<article><p>{LONG}</p><p hidden>{LONG}</p><div style='display: none'><div>{LONG}</div>{LONG}</div></article>", LONG),
        (f"<article><p>{LONG}<!-- open {LONG}", LONG),
        (f"<article><p>{LONG}</p><script>var a = '</p>';", LONG),
        ("<article><p>1 < 2 &lt;b&gt; &#x41;&#66; &amp;amp;</article>", "1 < 2 <b> AB &amp;"),
    ],
)
def test_main_text(page, expected):
    assert text(page) == expected


def test_tree_fits_its_table_and_uses_links():
    tree = pages.trained()
    wrong = total = 0
    for page, marks in pages.LABELLED:
        for row, mark in zip(pages.features(pages.blocks(page)).tolist(), marks, strict=True):
            wrong, total = wrong + (pages.decide(tree, row) != int(mark)), total + 1
    assert wrong <= 0.03 * total
    assert pages.decide(pages.grow(np.array([[0.0], [1], [2], [3]]), np.array([0, 0, 1, 1]), least=1), [2.5]) == 1


def test_query_against_article_markup(spark):
    """On these pages the main text is what the article element holds."""
    source = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    out = {r["page_id"]: r for r in queries.op10_page_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(out) == len(source)
    for r in source:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|br)[^>]*>", article)]
        expected = "\n".join(p for p in parts if p)
        assert (out[r["page_id"]]["text"], out[r["page_id"]]["n_chars"]) == (expected, len(expected))


def test_odd_rows(spark, tmp_path):
    long = "<article>" + f"<p>{LONG}</p>" * 20_000
    rows = [(1, None, None), (None, "u", ""), (2, "u", "no markup at all"), (2, "u", "no markup at all"), (3, "u", long), (4, "u", "<" * 5000), (5, "u", "<a href='" * 300)]
    out = queries.op10_page_text(spark, save(spark, tmp_path / "a", rows, "page_id long, url string, html string", "pages")).collect()
    assert len(out) == len(rows)
    by_id = {r["page_id"]: r for r in out}
    assert by_id[1]["text"] == by_id[None]["text"] == "" and by_id[1]["n_chars"] == 0
    assert by_id[3]["text"].count("\n") == 19_999
    assert queries.op10_page_text(spark, save(spark, tmp_path / "b", [], "page_id long, url string, html string", "pages")).collect() == []


@pytest.mark.parametrize(
    "page",
    [
        f"<article><p hidden>x<p>{LONG}</p></article>",
        f"<article><ul><li style='display:none'>x<li>y</ul><p>{LONG}</p></article>",
        f"<table><tr hidden><td>x<tr><td>{LONG}</table>",
        f"<article><p>{LONG} <a title='The hidden valley' href=1>walk</a></p></article>",
        f"<article><div class='is hidden md'>{LONG}</div></article>",
    ],
)
def test_hidden_elements_end_and_names_only_hide(page):
    found = " ".join(b.text for b in pages.blocks(page))
    assert LONG in found and "x" not in found.split() and ("walk" in found) == ("walk" in page)


ARTICLE = f"<article><h1>Market hall</h1><p>{pages._LONG}</p><p>{pages._MORE}</p></article>"
ARTICLE_TEXT = f"Market hall\n{pages._LONG}\n{pages._MORE}"


def used(tree):
    return {pages.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()


def test_tree_uses_link_density_and_neighbours():
    assert {"density", "words_after"} <= used(pages.trained())
    linked = f"<div><a href=1>{pages._LONG}</a></div><div><a href=2>{pages._MORE}</a></div>"
    page = f"{linked}<div>{pages._MORE}</div><div>A vote is due.</div><div>{pages._LONG}</div>{linked}<div>A vote is due.</div>"
    assert pages.main_text(page, pages.trained()) == f"{pages._MORE}\nA vote is due.\n{pages._LONG}"


def test_class_words_do_not_condemn_the_article():
    for page in [
        f"<div class='layout has-sidebar'>{ARTICLE}</div>",
        ARTICLE.replace("<article>", "<article class='post share-enabled'>"),
        ARTICLE.replace("<article>", "<article class='post tag-news tags'>"),
        ARTICLE.replace("<article>", "<article class='post comments-open'>"),
        f"<div class='main no-sidebar'>{ARTICLE}</div>",
        f"<form action=/><nav><a href=1>News</a></nav>{ARTICLE}<aside>{pages._LONG}</aside></form>",
        f"<div class='layout has-sidebar'><div class=sidebar>{pages._LONG}</div>{ARTICLE}<div class=comments><article class=comment>{pages._LONG}</article></div></div>",
    ]:
        assert pages.main_text(page, pages.trained()) == ARTICLE_TEXT
    comments = f"<div class=comments><article class='comment content'><p>{pages._MORE} {pages._MORE}</p></article></div>"
    assert pages.main_text(f"<div><p>{pages._LONG}</p></div>{comments}", pages.trained()) == pages._LONG


def test_links_around_blocks_and_reader_opinions_go():
    tree = pages.trained()
    assert pages.main_text(f"{ARTICLE}<a href=1><div>{pages._LONG}</div></a>", tree) == ARTICLE_TEXT
    assert pages.main_text(f"{ARTICLE}<div class='user-opinions'><p>{pages._MORE}</p></div>", tree) == ARTICLE_TEXT
    # A link without end ends with its element.
    assert [b.density for b in pages.blocks("<p><a href=1>one two<p>three</p><div><a>x</div>y")] == [1, 0, 1, 0]


def test_hidden_elements_without_end_leave_the_page():
    for start in ("<button>", "<video>", "<object>x", "<div hidden>zz"):
        assert pages.main_text(start + ARTICLE, pages.trained()) == ARTICLE_TEXT
    assert pages.main_text("<script>" + ARTICLE, pages.trained()) == ""


def test_tags_without_end_are_read_in_linear_time():
    start = time.perf_counter()
    assert len(pages.blocks('<a "xxx ' * 100_000)) == 1
    assert time.perf_counter() - start < 5
