"""Layouts whose names or tags look like boilerplate and yet hold the article."""

import time

import pytest

from driftloom.llm.html_text import main_text, named

PARTS = [f"Sentence {i}, with words, commas, and more of the text that a page has." for i in range(8)]
BODY = "".join(f"<p>{t}</p>" for t in PARTS)
TEXT = "\n".join(PARTS)
SIDE = "<nav><a href=a>Home</a></nav><footer>Foot</footer>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar"><article>{BODY}</article></div>',
        f'<div id="content-no-comments">{BODY}</div>',
        f'<form id="aspnetForm"><input name=q>{BODY}</form>',
        f'<div class="sidebar-layout"><div class="sidebar"><p>About us, and more.</p></div><main>{BODY}</main></div>',
        f'<article><div class="share-story">{BODY}</div><div class="ad">Buy</div></article>',
        f"<article>{''.join(f'<div class=elementor-widget><p>{t}</p></div>' for t in PARTS)}</article>",
        f"<nav><a href=x>never closed</a><article>{BODY}</article>",
        f'<div style="display:none"><article>{BODY}</article></div>',
        f'<div class="wrap">{BODY}</div><div id="comments">{"".join(f"<article class=comment><p>Comment {i}, I think, well.</p></article>" for i in range(9))}</div>',
        f"<article>{BODY}<form><label>Mail</label><input></form><section class=comments><p>Nice, nice, nice.</p></section></article>",
        f"<div>{BODY}<p class=x>" + "</div><div class=related-posts><p>Other, and other.</p></div>",
    ],
)
def test_article_stays(page):
    assert main_text(f"<body>{SIDE}{page}</body>") == TEXT


def test_article_headers_and_related_work():
    page = f'<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{BODY}<div class="related-work"><h2>Related work</h2><p>Others did it.</p></div><footer>tags</footer></article>'
    assert main_text(page) == f"Title\n{TEXT}\nRelated work\nOthers did it."


def test_names():
    assert all(map(named, ["ad", "top-ads", "cookieBanner", "x related", "related-posts", "site_header", "post comments"]))
    assert not any(map(named, ["", "has-sidebar", "no-comments", "related-work", "adapt", "shadow", "headline", "contentWithoutAds"]))


def test_long_and_deep_pages_end_soon():
    began = time.time()
    assert main_text("<div>" * 5000 + BODY * 200 + "</div>" * 5000) == "\n".join([TEXT] * 200)
    assert main_text("<p>" + "word, " * 500_000) == ("word, " * 500_000).strip()
    assert main_text("<div class=ad>" * 3000 + "deep") == ""
    assert time.time() - began < 30
