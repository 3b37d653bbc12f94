"""HTML extraction by tree scoring.

A page is read into a tree of blocks. Elements that hold no article text by their tag, or that are
hidden, are left out. Elements whose class, id or role names page furniture (menus, headers,
footers, sidebars, notices, adverts, reader comments) are left out unless they hold most of the
page's paragraph points, in which case the name was misleading. Words that state how a page is
laid out (no-sidebar, comments-open) name nothing. Every paragraph gives points for its length
and commas to its parent, half of them to the next ancestor and a third to the one above; an
ancestor's points are discounted by its link density. The best container and those of its
siblings that score like it, read like prose, lead in, or stand between kept ones are kept, and
all their blocks are the text.

Text inside a block has its white space turned into one space; blocks are joined by an empty
line, in page order. Defined results: a null or empty page, or one without any text outside the
dropped elements, gives the empty string; a cut-off page is read as far as it goes; pages of any
length are read whole; repeated rows are read each; other columns pass through.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+)|[^=>]++)*+(?:>|\Z)|<|[^<]+", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
SPACE = re.compile(r"[\s ]+")

#: Elements whose content is characters, not markup, up to their own end tag.
RAW = {"script", "style", "textarea", "title", "iframe"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements without article text.
DROPPED = RAW | {"noscript", "template", "svg", "math", "nav", "footer", "aside", "form", "button", "select", "option", "object", "applet",
                 "menu", "dialog", "canvas", "audio", "video", "label", "fieldset", "input"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font",
          "i", "img", "ins", "kbd", "mark", "q", "ruby", "rt", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Dropped elements that stand inside a paragraph without ending it.
WITHIN = {"script", "style", "template", "noscript", "button", "label", "select", "option", "input", "textarea", "iframe", "object",
          "applet", "svg", "math", "canvas", "audio", "video"}
#: Words that name reader comments, and other page furniture, where a class, id or role begins or ends with them.
COMMENTS = set("comment comments comment-list discussion discussions disqus replies reply respond".split())
FURNITURE = COMMENTS | set("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs
    contentinfo cookie cookies complementary consent dialog disclaimer footer header menu modal nav navbar navigation
    newsletter notice notices alert pagination pager popup promo promotion related share sharing shares sidebar
    site-header site-footer skip social sponsor sponsored subscribe tags toolbar widget widgets masthead search login
    signup""".split())
ARTICLE = set("article body content entry main post story text".split())
#: Words of what leads into an article.
LEAD = set("abstract dek intro introduction lead lede standfirst subtitle summary teaser".split())
#: A name with one of the first, or that ends in one of the second, states how a page is laid out.
STATES = set("has no not with without".split())
SETTINGS = set("active allowed closed collapsed disabled enabled expanded inactive loaded off on open opened required visible".split())
#: Share of the page's paragraph points from which an element of a misleading name is kept.
MOST, MOST_COMMENTS = 0.5, 0.9
#: A start tag of the key's group ends an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
CLOSES |= dict.fromkeys(("tbody", "thead", "tfoot"), {"tr", "td", "th", "tbody", "thead", "tfoot"})
#: Start tags that end an open, dropped paragraph, and the elements they do not reach beyond.
ENDS_P = set("""address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul""".split())
P_SCOPES = {"applet", "button", "caption", "object", "svg", "math", "table", "td", "template", "th"}
#: End tags inside do not end an element outside.
SEALED = {"applet", "object", "template"}
#: Siblings of the article's container that go on with it, however short.
LISTS = {"ul", "ol", "dl", "table", "pre", "blockquote", "figure"}
SCOPES = {"ul", "ol", "dl", "table", "body", "article", "section", "main", "div"}


class Element:
    __slots__ = ("tag", "parent", "children", "points", "names", "block", "inside", "dropped", "suspect")

    def __init__(self, tag: str, parent: Element | None, names: set[str]):
        self.tag, self.parent, self.names = tag, parent, names
        self.children: list[Element | str] = []
        self.points = 0.0
        self.block = tag not in INLINE
        self.dropped = parent is not None and parent.dropped
        #: Least share of the page's points with which the element is no furniture; 0 if it is none.
        self.suspect = 0.0
        self.inside = tag in ("article", "main") or bool(words_of(names) & ARTICLE) or parent is not None and parent.inside


def words_of(names: set[str]) -> set[str]:
    return {w for n in names for w in re.split(r"[_-]+", re.sub(r"[0-9]+", "", n)) if w}


def _attributes(tag: str) -> tuple[set[str], bool]:
    """Names in class, id and role, and whether the element is hidden."""
    names: set[str] = set()
    hidden = False
    head = TAG.match(tag)
    for m in ATTRIBUTE.finditer(tag, head.end() if head else 0):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            names.update(value.split())
        hidden |= key == "hidden" and value != "false" or key == "aria-hidden" and value == "true" or key == "style" and bool(HIDING.search(value))
    return names, hidden or "hidden" in names


def _named_furniture(names: set[str]) -> set[str]:
    """The furniture that names speak of: whole names, or their first or last word."""
    found: set[str] = set()
    for name in names:
        words = [w for w in re.split(r"[_-]+", re.sub(r"[0-9]+", "", name)) if w]
        if not words or words[-1] in SETTINGS or STATES & set(words):
            continue
        ends = {words[0], words[-1], "-".join(words)} & FURNITURE
        if words[-1] == "header" and words[0] in ARTICLE:
            ends.discard("header")  # the head of the article
        found |= ends
    return found


def _suspicion(tag: str, names: set[str]) -> float:
    """The share of points below which an element of these names is furniture; 0 for none."""
    if tag in ("body", "html", "article", "main") or tag in INLINE and tag not in ("a", "span", "small"):
        return 0.0
    found = _named_furniture(names)
    return 0.0 if not found else MOST_COMMENTS if found & COMMENTS else MOST


def _left_out(tag: str, inside_article: bool) -> bool:
    return tag in DROPPED or tag == "header" and not inside_article


def read_tree(page: str) -> Element:
    """Tree of the page, its furniture marked as dropped; unclosed elements end where HTML says they do.

    A head is no element of its own: what may stand in it has no article text, and all else ends it.
    """
    root = Element("html", None, set())
    here, at = root, 0
    while at < len(page):
        m = TOKEN.match(page, at)
        token, at = m[0], m.end()
        tag = TAG.match(token)
        if tag is None:
            if not here.dropped and not token.startswith(("<!", "<?")):
                here.children.append(html.unescape(token))
            continue
        closing, name = bool(tag[1]), tag[2].lower()
        if closing:
            there: Element | None = here
            while there is not None and there.tag != name:
                # An inline end tag does not reach beyond its block.
                there = None if there.block and name in INLINE or there.tag in SEALED else there.parent
            if there is not None and there.parent is not None:
                here = there.parent
            elif name == "p" or name == "br":
                here.children.append(Element("br", here, set()))
            continue
        if name in ("html", "head", "body"):
            continue
        if name in RAW and not token.endswith("/>"):
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
        names, hidden = _attributes(token) if not here.dropped else (set(), False)
        if name not in INLINE and name not in WITHIN:
            up = here
            # A block ends the open paragraph.
            while up.tag in INLINE or up.tag == "p" or up.dropped and up.tag not in P_SCOPES:
                if up.tag == "p":
                    if not up.dropped or name in ENDS_P:
                        here = up.parent
                    break
                if up.parent is None:
                    break
                up = up.parent
            if name in CLOSES:
                up = here
                while up.parent is not None and up.tag not in SCOPES:
                    if up.tag in CLOSES[name]:
                        here = up.parent
                    up = up.parent
        node = Element(name, here, names)
        doubt = 0.0 if here.dropped else _suspicion(name, names)
        node.dropped = here.dropped or hidden or _left_out(name, here.inside) or doubt > 0 and not node.block
        if not node.dropped:
            node.suspect = doubt
            here.children.append(node)
        elif not here.dropped and name in ENDS_P:
            here.children.append(Element("hr", here, set()))
        if name not in VOID and name not in RAW and not token.endswith("/>"):
            here = node
    return root


def blocks(node: Element) -> list[tuple[Element, str, int]]:
    """(container, text, characters inside links) of every block with text, in page order."""
    out: list[tuple[Element, str, int]] = []
    held: list[str] = []
    linked = 0
    owner = node

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(held)).strip(" ")
        if text:
            out.append((owner, text, min(linked, len(text))))
        held.clear()
        linked = 0

    stack: list[tuple[Element, int, bool]] = [(node, 0, False)]
    while stack:
        here, at, in_link = stack.pop()
        if at == 0 and here.block:
            flush()
            owner = here
        while at < len(here.children):
            child = here.children[at]
            at += 1
            if isinstance(child, str):
                held.append(child)
                if in_link:
                    linked += len(child.strip())
            elif child.tag in ("br", "hr") and not child.children:
                if child.tag == "hr":
                    flush()
                held.append(" ")
            else:
                stack.append((here, at, in_link))
                stack.append((child, 0, in_link or child.tag == "a"))
                break
        else:
            if here.block:
                flush()
                up = here.parent
                while up is not None and not up.block:
                    up = up.parent
                owner = up or node
    flush()
    return out


def points_of(text: str) -> float:
    return 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3.0)


def without_furniture(found: list[tuple[Element, str, int]]) -> list[tuple[Element, str, int]]:
    """Blocks outside elements whose names say furniture, but for those that hold most of the points."""
    held: dict[int, float] = {}
    above: list[list[Element]] = []
    total = 0.0
    for owner, text, linked in found:
        points = points_of(text) * (1 - linked / len(text))
        total += points
        doubtful, up = [], owner
        while up is not None:
            if up.suspect:
                doubtful.append(up)
                held[id(up)] = held.get(id(up), 0.0) + points
            up = up.parent
        above.append(doubtful)
    return [b for b, doubtful in zip(found, above) if all(held[id(e)] > e.suspect * total for e in doubtful)]


def main_text(page: str) -> str:
    """The article's blocks, joined by an empty line."""
    root = read_tree(page)
    found = without_furniture(blocks(root))
    if not found:
        return ""
    total: dict[int, list[int]] = {}
    scored: dict[int, Element] = {}
    for owner, text, linked in found:
        up: Element | None = owner
        while up is not None:
            sums = total.setdefault(id(up), [0, 0])
            sums[0] += len(text)
            sums[1] += linked
            up = up.parent
        points = points_of(text)
        paragraph = owner.tag in ("p", "pre", "blockquote", "li", "td", "dd") or owner.tag[0] == "h" and owner.tag[1:].isdigit()
        up = owner.parent if paragraph and owner.parent is not None else owner
        for share in (1, 2, 3):
            if up is None:
                break
            if id(up) not in scored:
                scored[id(up)] = up
                if up.tag in ("article", "main") or words_of(up.names) & ARTICLE:
                    up.points += 25
            up.points += points / share
            up = up.parent

    def density(e: Element) -> float:
        size, linked = total.get(id(e), (0, 0))
        return linked / size if size else 0.0

    final = {k: e.points * (1 - density(e)) for k, e in scored.items()}
    best = max(scored.values(), key=lambda e: final[id(e)])
    kept = {id(best)}
    if best.parent is not None:
        least = max(10.0, 0.2 * final[id(best)])
        siblings = [c for c in best.parent.children if isinstance(c, Element)]
        plain = []
        for at, child in enumerate(siblings):
            size, linked = total.get(id(child), (0, 0))
            calm = size > 0 and density(child) < 0.25
            prose = child.tag == "p" and (size > 80 and calm or 0 < size and not linked)
            heading = child.tag[0] == "h" and child.tag[1:].isdigit()
            like = bool(best.names) and best.names == child.names or bool(words_of(child.names) & LEAD) or child.tag in LISTS
            if final.get(id(child), 0.0) >= least or prose or heading or calm and like:
                kept.add(id(child))
            elif calm:
                plain.append(at)
        places = [at for at, child in enumerate(siblings) if id(child) in kept]
        kept.update(id(siblings[at]) for at in plain if places[0] < at < places[-1])

    def inside(e: Element | None) -> bool:
        while e is not None:
            if id(e) in kept:
                return True
            e = e.parent
        return False

    return "\n\n".join(text for owner, text, _ in found if inside(owner))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with the main text of ``html`` as ``text`` and its length as ``n_chars``."""
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(page or "") for page in column], dtype=object)

    return pages.withColumn("text", F.pandas_udf(texts, "string")("html")).withColumn(
        "n_chars", F.length("text").cast("bigint"))
