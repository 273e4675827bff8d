"""Boilerplate told by structure: sections whose names hold a boilerplate word, comments, link columns, short pages; and a scorer of its own."""

import random

import pytest

from driftloom.llm.html_text import main_text

BODY = [f"Sentence {i}, with words, commas, and more of the text that a page has." for i in range(6)]
HTML = "".join(f"<p>{t}</p>" for t in BODY)


@pytest.mark.parametrize("name", "social-effects market-share search-results comment-on-the-law promotion-rules menu-recipes cookies-recipe banner-history modal-logic header-files notice-of-rights".split())
@pytest.mark.parametrize("attribute", ["id", "class"])
def test_sections_about_something_stay(name, attribute):
    page = f"<body><article><h1>T</h1>{HTML}<section {attribute}='{name}'><h2>S</h2><p>One more part, of the article.</p></section></article></body>"
    assert main_text(page).split("\n") == ["T", *BODY, "S", "One more part, of the article."]


COMMENTS = "".join(f"<li class=item><span class=author>Ann {i}</span> <time>2 May</time><p>I think, well, that this is so, and that is that, too.</p></li>" for i in range(5))


@pytest.mark.parametrize("name", ["commentlist", "commentbox", "discussion", "responses", "reader-feedback", "unnamed", "x7"])
@pytest.mark.parametrize("inside", [True, False])
def test_reader_comments_go(name, inside):
    part = f"<div class='{name}'><h3>5 replies</h3><ul class='{name}'>{COMMENTS}</ul></div>"
    page = f"<article><h1>T</h1>{HTML}{part}</article>" if inside else f"<article><h1>T</h1>{HTML}</article>{part}"
    assert main_text(f"<body>{page}</body>").replace("5 replies", "").rstrip() .split("\n") == ["T", *BODY]


def test_discussion_as_a_section_stays():
    page = f"<article><h1>T</h1>{HTML}<section id=discussion><h2>Discussion</h2><p>First, a point.</p><p>Second, a point.</p></section></article>"
    assert main_text(page).split("\n") == ["T", *BODY, "Discussion", "First, a point.", "Second, a point."]


def test_unnamed_column_of_links_goes():
    links = "".join(f"<p><a href=x{i}>One, two, three, and more words about {i}</a></p>" for i in range(40))
    assert main_text(f"<body><div><div>{links}</div><div>{''.join(f'<p>{t}</p>' for t in BODY[:3])}</div></div></body>").split("\n") == BODY[:3]


@pytest.mark.parametrize("around", ["<form id=aspnetForm>{}</form>", "<div class='post-banner'>{}</div>", "<aside>{}</aside>", "<div hidden>{}</div>"])
def test_short_pages_are_not_empty(around):
    text = "A short but whole article, of one sentence, in a form."
    assert main_text(f"<body><nav><a href=a>Home</a></nav>{around.format(f'<p>{text}</p>')}</body>") == text
    assert main_text("<body>" + around.format("<a href=b>x</a>") + "</body>") == ""


@pytest.mark.parametrize("part", ["<div class=ad>Buy, buy, buy.</div>", "<div id=top-ads><p>Buy, buy.</p></div>", "<div class='cookie-notice'>We use cookies.</div>", "<aside>See also</aside>", "<div class=sharebar>Share</div>", "<footer>Foot</footer>", "<form>Mail <input></form>"])
def test_boilerplate_in_an_article_goes(part):
    assert main_text(f"<article>{HTML}{part}</article>").split("\n") == BODY


def random_tree(rng, depth=0):
    """(tag, children or text, linked): divs, with paragraphs as leaves."""
    if depth == 4 or depth > 1 and rng.random() < 0.5:
        return ("p", " ".join(rng.choice(["word", "a,", "longer words", "x"]) for _ in range(rng.randint(1, 60))), rng.random() < 0.3)
    return ("div", [random_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))], False)


def source(tree):
    tag, inner, linked = tree
    if tag == "p":
        return f"<p><a href=q>{inner}</a></p>" if linked else f"<p>{inner}</p>"
    return f"<div>{''.join(map(source, inner))}</div>"


def plain_text(tree):
    """What the stated rules choose, worked out node by node from the leaves below each."""
    leaves, parents, order = [], {}, []

    def walk(node, path):
        order.append(path)
        parents[path] = node
        if node[0] == "p":
            leaves.append((path, node[1], node[2]))
        else:
            for i, x in enumerate(node[1]):
                walk(x, (*path, i))

    walk(tree, (0,))
    score, size, link = {}, {}, {}
    for path, text, linked in leaves:
        points = 0.0 if linked else 1 + text.count(",") + min(len(text) / 100, 3)
        for up in range(1, 6):
            at = path[:-up] if up < len(path) else ("body", "html")[up - len(path)] if up - len(path) < 2 else None
            if at is not None:
                score[at] = score.get(at, 0) + points / up
        for k in range(1, len(path) + 1):
            size[path[:k]] = size.get(path[:k], 0) + len(text)
            link[path[:k]] = link.get(path[:k], 0) + len(text) * linked
    worth = lambda p: score[p] * (1 - link.get(p, link[(0,)]) / size.get(p, size[(0,)]))
    best = max(score, key=lambda p: (worth(p)))
    if isinstance(best, str) or len(best) == 1:
        return None if worth(best) else ""
    kept = {best}
    for p in order:
        if len(p) == len(best) and p[:-1] == best[:-1] and p != best:
            if p in score and worth(p) >= max(10.0, 0.2 * worth(best)) or link[p] < 0.25 * size[p]:
                kept.add(p)
    return "\n".join(text for path, text, _ in leaves if any(path[:k] in kept for k in range(1, len(path) + 1)))


def test_scores_of_random_trees():
    rng, compared = random.Random(11), 0
    for _ in range(1500):
        tree = ("div", [random_tree(rng, 1) for _ in range(rng.randint(1, 4))], False)
        want = plain_text(tree)
        if want:
            compared += 1
            assert main_text(f"<html><body>{source(tree)}</body></html>") == want
    assert compared > 300
