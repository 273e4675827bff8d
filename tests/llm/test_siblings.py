"""Siblings of the best container on pages without article or main."""

from driftloom.llm import html_text

BODY = "".join(f"<p>Sentence {i}, with words, commas, and more of the text that a page has.</p>" for i in range(12))
TEXT = [f"Sentence {i}, with words, commas, and more of the text that a page has." for i in range(12)]


def lines(page):
    return html_text.main_text(page).split("\n")


def test_title_lead_and_close_beside_the_container():
    page = f"<div id=content><h1>Title</h1><p>lead</p><div class=body>{BODY}</div><div><h2>End</h2><p>Short close.</p></div></div>"
    assert lines(page) == ["Title", "lead", *TEXT, "End", "Short close."]
    assert lines(f"<div><blockquote><p>quoted</p></blockquote><div>{BODY}</div></div>") == ["quoted", *TEXT]


def test_linked_and_unwritten_siblings_go():
    page = f"<div><p><a href=a>More of this</a></p><ul><li><a href=b>one</a></li></ul><div>{BODY}</div><div>12 views</div><div class=related><p>Other</p></div></div>"
    assert lines(page) == TEXT
