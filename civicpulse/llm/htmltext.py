"""Main text of web pages by tree scoring.

A page becomes a light tree. Paragraphs earn points for their length and commas and pass
them to their ancestors (all to the parent, half to its parent, less further up); a node's
points are discounted by the share of its text that is link text. The best container,
widened to the article around it, is kept, with siblings that score like it. Subtrees that
are never article text (menus, forms, scripts, notices, comments, ...) are cut before; those known
by class or id only, unless they hold the article or most of the page's paragraph text.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names and name parts by which page furniture is known.
DROPPED = frozenset([
    "nav", "footer", "aside", "script", "style", "noscript", "template", "iframe", "object", "embed", "svg",
    "canvas", "button", "select", "option", "textarea", "input", "dialog", "menu", "head", "title", "meta", "link",
    "audio", "video",
])
# Parts of forms that may as well hold the whole page: what is inside decides.
FORMS = frozenset(["form", "fieldset", "label"])
VOID = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
    "wbr",
])
BLOCKS = frozenset([
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
])
PARAGRAPHS = frozenset([
    "p", "pre", "td", "blockquote", "li", "dd", "div", "section", "article", "main", "h1", "h2", "h3", "h4",
    "h5", "h6",
])
HEADINGS = frozenset([
    "h1", "h2", "h3", "h4", "h5", "h6",
])
# Which open items an item ends, and what holds items.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}
HOLDERS = ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr")
FURNITURE = frozenset([
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored",
    "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "nav", "navbar",
    "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "rail", "widget", "widgets",
    "footer", "header", "masthead", "comment", "comments", "disqus", "respond", "replies", "reply", "share",
    "sharing", "social", "related", "recommended", "toolbar", "pagination", "pager", "skip", "form", "search",
    "adbox", "adslot", "adunit", "adsense", "topnav", "sidenav", "subnav", "mainnav", "topbar", "cookiebar",
    "infobar", "commentlist", "sidebox", "teaser", "teasers", "paywall",
])
SIDE_ARTICLES = frozenset([
    "ad", "ads", "advert", "advertisement", "sponsored", "promo", "comment", "related", "teaser",
])
ARTICLE_PARTS = frozenset(["article", "post", "entry", "story", "main", "content"])
# What follows one of these in a class or id tells of a layout, not what the element is.
LAYOUT = frozenset(["has", "no", "not", "with", "without", "hide"])
# Words that stand beside a furniture word in the id of furniture.
BOXES = frozenset([
    "list", "box", "area", "section", "wrapper", "wrap", "container", "block", "bar", "links", "buttons", "icons",
    "left", "right", "top", "bottom", "inner", "slot", "unit", "main", "content", "site", "page",
])
READ = frozenset(["class", "id", "role", "hidden", "aria-hidden", "style"])
ROLES = frozenset([
    "navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog",
    "menu",
])

RAW = frozenset(["script", "style", "textarea", "title", "noscript", "template", "iframe"])
_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)|[!?/])")
_ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/=>]*+)(\s*+=\s*+)?+")
_PLAIN = re.compile(r"([^\s/=>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|(\S*)))?")
_BARE = re.compile(r"[^\s>]*+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "kept", "suspect", "points", "depth", "block")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.kept, self.suspect, self.points = True, False, 0.0
        self.depth = 0 if parent is None else parent.depth + 1
        # The nearest block, the node itself included.
        self.block = self if tag in BLOCKS or parent is None else parent.block


def _is_dropped(tag: str, rest: dict[str, str], within_article: bool) -> bool:
    """Whether an element is page furniture by its name, or hidden, or by its role."""
    if tag in DROPPED or (tag == "header" and not within_article):
        return True
    if not rest or tag in ("html", "body"):
        return False
    return (
        "hidden" in rest
        or rest.get("aria-hidden", "").lower() == "true"
        or rest.get("role", "").lower() in ROLES
        or bool(_HIDDEN.search(rest.get("style", "")))
    )


def _named_words(value: str) -> set[str]:
    """Words of a class or id; what a name like ``has-sidebar`` or ``with-ads`` says of others is left out."""
    words = set()
    for name in value.split():
        parts = [part.lower() for part in _PART.findall(name)]
        at = next((i for i, part in enumerate(parts) if part in LAYOUT), len(parts))
        words.update(parts[:at])
    return words


def _is_suspect(tag: str, rest: dict[str, str], within_article: bool) -> bool:
    """Whether name, class or id speak of page furniture; ``_cut`` judges by what the element holds."""
    if tag in ("html", "body"):
        return False
    if tag in FORMS or rest.get("role", "").lower() == "form":
        return True
    for name in ("class", "id"):
        value = rest.get(name)
        if not value or (name == "id" and tag in HEADINGS):
            continue
        words = _named_words(value)
        if tag in ("article", "main"):
            if words & SIDE_ARTICLES and not words & ARTICLE_PARTS:
                return True
            continue
        # A header of or inside the article is the article's own.
        found = words & FURNITURE - ({"header"} if within_article or words & ARTICLE_PARTS else set())
        # An id inside the article may be made from a heading's words.
        if found and (name == "class" or not within_article or words <= FURNITURE | BOXES):
            return True
    return False


def _tokens(page: str):
    """``(start, stop, tag, closes, attributes, closed)`` of all markup; of comments etc. the tag is None.

    Quoted values end at their quote, however long. Every character is seen a bounded number of
    times: what has once been sought in vain up to the end is not sought again.
    """
    at, size, gone, ran_off = 0, len(page), set(), False

    def find(what: str, start: int) -> int:
        if what in gone:
            return -1
        found = page.find(what, start)
        if found < 0:
            gone.add(what)
        return found

    while opened := _OPEN.search(page, at):
        start, at = opened.span()
        if opened["comment"]:
            stop = find("-->", at)
            at = size if stop < 0 else stop + 3
            yield start, at, None, False, {}, False
            continue
        tag = opened["tag"]
        if tag is None or opened["close"]:
            stop = find(">", at)
            if stop >= 0:
                at = stop + 1
                yield start, at, tag and tag.lower(), True, {}, False
            continue
        tag, rest, i, closed = tag.lower(), {}, at, False
        while not ran_off:
            part = _ATTRIBUTE.match(page, i)
            i = part.end()
            name, value = part[1].lower(), ""
            if part[2] and i < size:
                if page[i] in "\"'":
                    stop = find(page[i], i + 1)
                    if stop < 0:
                        ran_off = True
                        break
                    value, i = page[i + 1 : stop], stop + 1
                else:
                    bare = _BARE.match(page, i)
                    value, i = bare[0], bare.end()
            if name:
                rest.setdefault(name, value)
            if i >= size:
                ran_off = True
            elif page[i] == ">":
                closed = page[i - 1] == "/" and not value
                break
        if ran_off:  # no end outside quotes: from here on the first one counts
            i = find(">", at)
            if i < 0:
                continue
            closed = page[i - 1] == "/"
            rest = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _PLAIN.finditer(page[at:i])}
        at = i + 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            at = end.end() if end else size
            tag = None
        yield start, at, tag, False, {k: entities.unescape(v) for k, v in rest.items() if k in READ}, closed


class _Open:
    """The open elements, and the innermost of each name, so that no end tag has to climb for its start."""

    def __init__(self, root: Node):
        self.here, self.articles = root, 0
        self.named: dict[str, list[Node]] = {}

    def innermost(self, *tags: str) -> Node | None:
        found = [self.named[tag][-1] for tag in tags if self.named.get(tag)]
        return max(found, key=lambda node: node.depth, default=None)

    def enter(self, node: Node) -> None:
        self.here = node
        self.named.setdefault(node.tag, []).append(node)
        self.articles += node.tag in ("article", "main")

    def leave_for(self, node: Node) -> None:
        """Close what is open below ``node``."""
        while self.here is not node:
            self.named[self.here.tag].pop()
            self.articles -= self.here.tag in ("article", "main")
            self.here = self.here.parent

    def close(self, tag: str) -> None:
        node = self.innermost(tag)
        # An inline end tag does not reach across the block it stands in.
        if node is not None and (tag in BLOCKS or node.block is self.here.block):
            self.leave_for(node.parent)

    def before_block(self, tag: str) -> None:
        """Where a block starts an open paragraph ends, like an open item before an item."""
        ends = ENDS.get(tag, ())
        block = self.here.block
        if block.tag in ends or block.tag in ("p", *HEADINGS):
            self.leave_for(block.parent)
        elif ends:
            item, outer = self.innermost(*ends), self.innermost(*HOLDERS)
            if item is not None and (outer is None or item.depth > outer.depth):
                self.leave_for(item.parent)


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are tolerated, of any depth."""
    root = Node("html", None)
    opened, at = _Open(root), 0
    for start, stop, tag, closes, rest, closed in _tokens(page):
        if start > at:
            opened.here.children.append(entities.unescape(page[at:start]))
        at = stop
        if tag is None:
            continue
        if closes:
            opened.close(tag)
            continue
        if tag in BLOCKS:
            opened.before_block(tag)
        node = Node(tag, opened.here)
        node.kept = not _is_dropped(tag, rest, opened.articles > 0)
        node.suspect = _is_suspect(tag, rest, opened.articles > 0)
        opened.here.children.append(node)
        if tag not in VOID and not closed:
            opened.enter(node)
    if at < len(page):
        opened.here.children.append(entities.unescape(page[at:]))
    _cut(root)
    return root


def _cut(root: Node) -> None:
    """Drop suspect elements, but for those with the article or most of the paragraph text inside."""
    order = [*_walk(root)]
    if not any(node.suspect for node in order):
        return
    size, holds = dict.fromkeys(order, 0), dict.fromkeys(order, False)
    for tags in (("p", "pre", "blockquote"), BLOCKS):  # a page may write its text without paragraphs
        for node in order:
            if node.tag in tags:
                text, links = _own_text(node)
                size[node] = max(len(text) - 2 * links, 0)
        if any(size.values()):
            break
    for node in reversed(order):
        if node.parent is not None:
            size[node.parent] += size[node]
            holds[node.parent] |= holds[node] or (node.tag in ("article", "main") and not node.suspect)
    for node in order:
        if node.suspect and not holds[node] and 2 * size[node] <= size[root]:
            node.kept = False


def _walk(root: Node):
    """Kept nodes below and including ``root``, in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or not node.kept:
            continue
        yield node
        stack.extend(reversed(node.children))


def _own_text(node: Node) -> tuple[str, int]:
    """Text of a node outside nested blocks, and how much of it is link text."""
    parts, links, stack = [], 0, [(c, node.tag == "a") for c in reversed(node.children)]
    while stack:
        child, linked = stack.pop()
        if isinstance(child, str):
            parts.append(child)
            links += len(child) if linked else 0
        elif child.tag == "br":
            parts.append(" ")
        elif child.kept and child.tag not in BLOCKS:
            stack.extend((c, linked or child.tag == "a") for c in reversed(child.children))
    return " ".join("".join(parts).split()), links


def _score(root: Node) -> Node | None:
    """Set points; the node with most, or None if no paragraph has text."""
    sizes: dict[Node, list[int]] = {}
    for node in _walk(root):
        if node.tag not in PARAGRAPHS and node.tag not in BLOCKS:
            continue
        text, links = _own_text(node)
        if not text:
            continue
        above = node
        while above is not None and above not in sizes:
            sizes[above] = [0, 0]
            above = above.parent
        sizes[node][0] += len(text)
        sizes[node][1] += min(links, len(text))
        if node.tag not in PARAGRAPHS or node.tag in HEADINGS or len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        target, level = node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") else node, 0
        while target is not None and level < 5:
            target.points += points / (1, 2, 6, 9, 12)[level]
            target, level = target.parent, level + 1
    for node in sorted(sizes, key=lambda n: -n.depth):
        if node.parent is not None:
            sizes[node.parent][0] += sizes[node][0]
            sizes[node.parent][1] += sizes[node][1]
    best = None
    for node, (length, links) in sizes.items():
        node.points *= 1 - links / max(length, 1)
        if node.points > 0 and (best is None or node.points > best.points):
            best = node
    return best


def _container(root: Node) -> list[Node]:
    """The best container, widened to its article, and siblings that score like it."""
    best = _score(root)
    articles = [n for n in _walk(root) if n.tag in ("article", "main")]
    filled = [n for n in articles if any(_own_text(x)[0] for x in _walk(n))]
    if named := [n for n in filled if n.tag == "article"]:
        best = max(named, key=lambda n: n.points)  # the page says where its article is
    elif best is None:
        return filled[:1] or [root]  # too little text to score
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * best.points)
    kept = []
    for node in best.parent.children:
        if isinstance(node, str) or not node.kept:
            continue
        if node is best or (node.tag == best.tag and node.points >= least):
            kept.append(node)
        elif best.tag not in ("article", "main", "body", "html") and node.tag in BLOCKS:
            text, links = _own_text(node)
            if node.points >= least or node.tag in HEADINGS and text:
                kept.append(node)
            elif node.tag == "p" and text and links / len(text) < 0.25 and (len(text) > 80 or text[-1] in ".!?"):
                kept.append(node)
    return kept


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Append the texts of a subtree to ``out``, one list of parts per block."""
    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            out.append([])
        elif isinstance(item, str):
            out[-1].append(item)
        elif item.tag == "br":
            out[-1].append(" ")
        elif item.kept:
            if item.tag in BLOCKS:
                out.append([])
                stack.append(None)
            stack.extend(reversed(item.children))


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by two line breaks; empty for a page without any."""
    if not page:
        return ""
    out: list[list[str]] = [[]]
    for node in _container(parse(page)):
        _blocks(node, out)
    blocks = (" ".join("".join(parts).split()) for parts in out)
    return "\n\n".join(b for b in blocks if b)


def main_text_column(html: Column | str) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return extract(html)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with their main text in ``text_col`` in place of ``html_col``.

    Null and empty pages, and pages without article text, have the empty text. Other
    columns stay, but for one that already has the name ``text_col``.
    """
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    return pages.select(*rest, F.coalesce(main_text_column(F.col(html_col)), F.lit("")).alias(text_col))
