"""Operator 2, the main text of web pages by tree scoring.

A page becomes a tree. Every text block has points, one and one per comma and up to three for its length, less the share of
it that stands in links, and passes them to the elements above it, less with each generation, but in full to the nearest
article or main. The sum is discounted by the share of the element's text that lies in links. The best element and those
siblings that score near it give their blocks in page order, and so do siblings whose text stands in paragraphs or headings
and is hardly linked, however short they are: a title, a lead, a closing section.

Scripts, controls and other elements without readable text are cut off while the tree is built. Elements that look like
boilerplate are only suspects: their text counts SUSPECT_WEIGHT, and they go unless the best element lies in them and is an
article or main or consists of hardly linked paragraphs, or unless nearly all of its text lies in them (HELD). So nothing
empties a page: not a form round the whole page, a banner round a short article, or an unclosed menu. Suspects are

* by tag or role: menus, footers, asides, dialogs, forms, and headers, but not an article's own (its title); menus,
  footers and dialogs by tag go whatever stands in them, unless it is an article or main,
* by class or id, if a name consists of words for boilerplate and for layout alone: ``top-ads``, ``commentlist``,
  ``related-posts``. One word that is neither makes it a subject, not a function: ``market-share``, ``search-results``,
* by structure: reader comments, siblings alike in tag and class that each have a name and a date. Where a class or id may
  mean comments or a section (``discussion``, ``responses``), siblings alike are enough.

White space is what ``str.split`` takes for it, Unicode spaces and U+001C to U+001F among it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, columns

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = RAW | frozenset("button select option noscript template svg canvas object audio video head".split())
SUSPECTS = frozenset("nav header footer aside form dialog menu menuitem".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPHS = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
#: Open elements that a start tag ends, and the elements beyond which it does not look.
ENDS = {t: ("p",) for t in BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}} | {"li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "tbody": ("p", "td", "th", "tr", "thead", "tbody"), "option": ("option",)}
FENCE = {"p": BLOCKS - {"p"}, "li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}
#: Words of class and id that name boilerplate, and words of layout that may stand beside them.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsbygoogle sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar widget widgets related recommended recommendations share sharing social comment comments disqus replies respond footer masthead header toolbar tags login search".split()
)
LAYOUT = frozenset(
    "x the my js box boxes block blocks wrap wrapper container area zone list lists item items section sections inner outer top bottom left right main site page pages post posts entry article articles content group row col column bar bars button buttons link links icon icons unit slot panel pane global primary secondary mobile desktop sticky fixed user form thread title heading body text info message google gpt div dfp small large more reading news stories videos topics products".split()
)
#: Words that name reader comments or a section of an article.
COMMENTARY = frozenset("discussion discussions response responses feedback reader readers reviews opinions".split())
#: Words of class and id, and elements, that mark who wrote something and when.
WHO, WHEN = frozenset("author user username commenter nick nickname name avatar by byline".split()), frozenset("date time datetime timestamp posted ago when".split())
WHO_TAGS, WHEN_TAGS = frozenset(["cite", "address"]), frozenset(["time"])
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
GENERATIONS, SIBLING_SHARE, SIBLING_LEAST, SIBLING_LINKED = 5, 0.2, 10.0, 0.25
SUSPECT_WEIGHT, HELD = 0.2, 0.8
#: Suspects that stay only round an article or main. Siblings that make comments, and the share of a parent's text in them.
HARD = frozenset("nav footer menu menuitem dialog".split())
ALIKE, ALIKE_SHARE = 2, 0.6


class Node:
    """``story``: the nearest article or main, itself included; ``kind``: its tag and class; ``marks``: who and when (1, 2), ``COMMENTARY`` (4)."""

    __slots__ = ("gone", "inner", "kind", "linked", "marks", "parent", "score", "story", "suspect", "tag", "text", "weak")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.inner, self.score, self.text, self.linked = tag, parent, [], 0.0, 0, 0
        self.kind, self.marks, self.suspect, self.weak, self.gone = tag, (tag in WHO_TAGS) + 2 * (tag in WHEN_TAGS), False, False, False
        self.story: Node | None = self if tag in ("article", "main") else parent.story if parent else None


@lru_cache(65536)
def words(token: str) -> tuple[str, ...]:
    """The words of a class or id in lower case; two that are written as one (``commentlist``) come apart if both are known."""
    out: list[str] = []
    for w in map(str.lower, WORD.findall(token)):
        known = NAMES | LAYOUT
        cuts = [] if w in known else [k for k in range(3, len(w) - 1) if w[:k] in known and w[k:] in known and (w[:k] in NAMES or w[k:] in NAMES)]
        out += [w[: cuts[0]], w[cuts[0] :]] if cuts else [w]
    return tuple(out)


@lru_cache(65536)
def named(value: str) -> bool:
    """Whether a class or id names boilerplate: one of its names consists of boilerplate and layout words, one of the former at least."""
    return any(any(w in NAMES for w in x) and all(w in NAMES or w in LAYOUT for w in x) for x in map(words, value.split()))


def judge(node: Node, attributes: str) -> None:
    """Set what tag, role, visibility, class and id say of an element."""
    tag, parent = node.tag, node.parent
    if tag in ("html", "body", "main"):
        return
    if tag in SUSPECTS and not (tag == "header" and parent.story is not None and parent.story.tag == "article"):
        node.suspect = True
    if not attributes.strip():
        return
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    names = [found[k] for k in ("class", "id") if k in found]
    node.kind = f"{tag}.{found.get('class', '')}"
    for w in (w for x in names for t in x.split() for w in words(t)):
        node.marks |= (w in WHO) + 2 * (w in WHEN) + 4 * (w in COMMENTARY)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ROLES or "style" in found and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found["style"]):
        node.suspect = True
    elif tag != "header" and any(map(named, names)):
        node.suspect = True


def comments(nodes: list[Node]) -> None:
    """Make suspects of the elements whose children are reader comments; texts of all elements are summed."""
    seen: dict[int, int] = {}
    for node in reversed(nodes):  # children before parents
        seen[id(node)] = seen.get(id(node), 0) | node.marks & 3
        if node.parent is not None:
            seen[id(node.parent)] = seen.get(id(node.parent), 0) | seen[id(node)]
    for node in nodes:
        if node.tag in ("html", "body", "main", "article", "tr", "tbody", "table") or not node.text:
            continue
        alike: dict[str, list[Node]] = {}
        for x in node.inner:
            if isinstance(x, Node) and x.text and x.tag in BLOCKS and not x.tag[1:].isdigit():
                alike.setdefault(x.kind, []).append(x)
        for group in alike.values():
            if len(group) >= ALIKE and sum(x.text for x in group) >= ALIKE_SHARE * node.text and (node.marks & 4 and group[0].tag != "p" or all(seen[id(x)] == 3 for x in group)):
                node.suspect = True


def parse(page: str) -> list[Node]:
    """The elements that may hold text, parents before children, the root first; texts are strings among their children."""
    root = Node("html", None)
    nodes, stack, dropped, at = [root], [root], None, 0
    while True:
        m = TAG.search(page, at)
        if at < (end := m.start() if m else len(page)) and dropped is None:
            stack[-1].inner.append(page[at:end])
        if not m:
            return nodes
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if dropped is not None and k <= dropped:
                        dropped = None
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "body", "main", "table") and tag not in ("html", "body", "article", "main", "div", "section", "table"):
                    break
            continue
        for ended in ENDS.get(tag, ()):
            fence = FENCE[ended]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == ended:
                    if dropped is not None and k <= dropped:
                        dropped = None
                    del stack[k:]
                    break
                if stack[k].tag in fence:
                    break
        node = Node(tag, stack[-1])
        if dropped is None and tag not in DROPPED:
            judge(node, m[3])
            stack[-1].inner.append(node)
            nodes.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = close.start() if close else len(page)
        if dropped is None and tag in DROPPED:
            dropped = len(stack)
        stack.append(node)


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, characters in links) of each text block, in page order."""
    out: list[tuple[Node, str, int]] = []
    words: list[str] = []
    linked: list[str] = []
    owner = root

    def cut() -> None:
        text = " ".join("".join(words).split())
        if text:
            out.append((owner, text, len(" ".join("".join(linked).split()))))
        words.clear()
        linked.clear()

    todo: list[tuple[Node | str | None, Node, bool]] = [(root, root, False)]
    while todo:
        item, block, link = todo.pop()
        if isinstance(item, str):
            if block is not owner:
                cut()
                owner = block
            text = html.unescape(item)
            words.append(text)
            if link:
                linked.append(text)
        elif item is None:
            cut()
        elif item.tag == "br":
            words.append(" ")
        else:
            is_block = item.tag in BLOCKS
            if is_block:
                cut()
                owner = item
                todo.append((None, block, link))
            todo += [(x, item if is_block else block, link or item.tag == "a") for x in reversed(item.inner)]
    cut()
    return out


def written_siblings(best: Node, found: list[tuple[Node, str, int]]) -> set[int]:
    """Ids of the siblings of ``best`` whose text all stands in paragraphs or headings, less than SIBLING_LINKED of it in links."""
    if best.parent is None:
        return set()
    chars: dict[int, list[int]] = {}
    of: dict[int, int | None] = {}
    for owner, text, linked in found:
        chain, node = [], owner
        while node is not None and id(node) not in of and node.parent is not best.parent:
            chain.append(node)
            node = node.parent
        at = None if node is None else of.setdefault(id(node), id(node))
        of.update((id(x), at) for x in chain)
        if at is not None:
            sums = chars.setdefault(at, [0, 0, 0])
            sums[0] += len(text)
            sums[1] += linked
            sums[2] += len(text) if owner.tag in PARAGRAPHS else 0
    return {x for x, (whole, linked, written) in chars.items() if written == whole and linked < SIBLING_LINKED * whole}


def acquitted(best: Node, nodes: list[Node], written: int) -> set[int]:
    """Ids of the suspects that stay: those round ``best``, of whose text ``written`` characters stand in paragraphs, and those in it.

    Round it, if it is in an article or main, or is written, hardly linked and in no HARD element; in it, if they hold
    nearly all of its text, are hardly linked and not far shorter than the others.
    """
    out: set[int] = set()
    above, node = [], best
    while node is not None:
        above.append(node)
        node = node.parent
    if best.story is not None or written > HELD * best.text and best.linked < SIBLING_LINKED * best.text and not any(x.tag in HARD for x in above):
        out |= {id(x) for x in above}
    inside, outermost = {id(best)}, []
    for x in nodes:
        if x.parent is not None and id(x.parent) in inside:
            if x.suspect:
                outermost.append(x)
            else:
                inside.add(id(x))
    held = sum(x.text for x in outermost)
    if held > HELD * best.text:
        out |= {id(x) for x in outermost if x.linked < SIBLING_LINKED * x.text and x.text >= SIBLING_SHARE * held / len(outermost)}
    return out


def main_text(page: str | None) -> str:
    """Blocks of the main text, one a line; an empty string if there are none."""
    if not page:
        return ""
    nodes = parse(page)
    found = blocks(nodes[0])
    for owner, text, linked in found:
        owner.text += len(text)
        owner.linked += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
    comments(nodes)
    for node in nodes:
        node.weak = node.suspect or node.parent is not None and node.parent.weak
    scored: dict[int, Node] = {}
    for owner, text, linked in found:
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text)) * (SUSPECT_WEIGHT if owner.weak else 1)
        node = owner.parent if owner.tag in PARAGRAPHS and owner.parent else owner
        story, generation = node.story, 1
        while node is not None and generation <= GENERATIONS and node is not story:
            node.score += points / generation
            scored[id(node)] = node
            node, generation = node.parent, generation + 1
        if story is not None:
            story.score += points
            scored[id(story)] = story
    if not scored:
        return ""

    def worth(node: Node) -> float:
        return node.score * (1 - node.linked / max(1, node.text))

    best = max(scored.values(), key=worth)
    under = {id(best)}
    for node in nodes:
        if node.parent is not None and id(node.parent) in under:
            under.add(id(node))
    stay = acquitted(best, nodes, sum(len(text) for owner, text, _ in found if owner.tag in PARAGRAPHS and id(owner) in under))
    for node in nodes:
        node.gone = node.parent is not None and node.parent.gone or node.suspect and id(node) not in stay
    found = [x for x in found if not x[0].gone]
    least = max(SIBLING_LEAST, SIBLING_SHARE * worth(best))
    kept = {id(best)}
    for x in best.parent.inner if best.parent else ():
        if isinstance(x, Node) and id(x) in scored and worth(x) >= least:
            kept.add(id(x))
    kept |= written_siblings(best, found)
    chosen = set()
    for node in nodes:
        if id(node) in kept or node.parent is not None and id(node.parent) in chosen:
            chosen.add(id(node))
    return "\n".join(text for owner, text, _ in found if id(owner) in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of all rows of ``pages`` (page_id, url, html).

    A null or empty page, or one without text, has an empty text; repeated rows come out each; an empty table gives no
    rows; other columns are not looked at; nothing is cut however long a page is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield columns(page_id=batch.column("page_id"), url=batch.column("url"), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")
