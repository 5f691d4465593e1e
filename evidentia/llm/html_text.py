"""Operator 8: HTML extraction by tree scoring.

A page is read into a tree of elements by one pass over its tags; tags that are left open are closed where
HTML closes them (a paragraph by the next block, a list item by the next item, everything by the end).
Subtrees that are never main text (scripts, styles, navigation, headers and footers of the page, what is hidden or marked by
its role, adverts by their plain class) are cut. Forms, and elements one of whose class or id tokens names a sidebar, a menu, a notice, sharing or reader
comments, are under suspicion. A token names something if it is that word, or if that is the first or the last of its words, which
hyphens, underscores and capitals part; a token of several words that begins with ``has``, ``no``, ``with`` and the like names nothing, and a
token that begins with ``comment`` names comments. What is under suspicion is cut, but for the case that a mark is on the article itself: an
element that holds nearly all the prose of the page (``MOST`` times what is outside of all suspicion; for forms, notices and comments: all of it) is
cleared, the outermost first, and the scores decide. Every remaining paragraph gives points, one for itself, one for each comma and one for each hundred
characters up to three, to its container and half of them to the container's container, and less for each
further one. Containers lose points by their share of text inside links. The best container is the main
one; its siblings are kept too when they score near it or are plain prose. An element marked as the
article (or the page's main part) starts with points of its own, as an author's mark is stronger than
any count: where the best container lies inside an article (or else a main part), that element is the result
with all it holds, however many points its inner parts have. Elsewhere headings, lists, tables, figures,
quotations and code beside the best container are kept too, unless they are mostly links or it lies right in
the page's body. The blocks of what is kept are joined in page order.

Defined cases: a null or empty page gives an empty text; a page without any container gives the blocks of
its body; nothing is shortened. Nesting may be of any depth. A formula is text of its line. A tag with a quote that is
never closed ends at its first ``>``. Repeated rows give repeated rows. Columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import text_slices
from .session import bounded_batches, table

#: Elements whose content is not markup, up to their own end tag.
_RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "title", "xmp", "noembed", "noframes", "svg"}
#: Elements that are cut with all they hold.
_CUT = _RAW | {"head", "nav", "footer", "aside", "button", "select", "input", "option", "fieldset", "dialog", "menu", "object", "embed", "canvas", "audio", "video", "map", "annotation", "annotation-xml"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "label"}
#: Formulas are part of their line.
_INLINE |= {"math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mstyle", "mspace", "mpadded", "mphantom", "menclose", "mfenced", "merror"}
_CONTAINER = {"article", "main", "section", "div", "body", "td", "center", "html", "blockquote", "#root"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dt", "dd"}
#: What belongs to the text beside it, if it is not mostly links.
_BESIDE = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "ul", "ol", "dl", "pre", "table", "figure", "blockquote"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "section", "main", "body", "html", "#root", "blockquote", "div", "td", "th", "nav", "footer", "header", "aside", "form"}

#: Words of classes and ids: of adverts, which are always cut; of notices; of comments; of the layout around an article.
_ADVERT = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor", "sponsors", "sponsored"}
_NOTICE = {"promo", "promos", "promotion", "promotions", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "newsletter", "subscribe", "signup", "login", "popup", "modal", "overlay"}
_REPLIES = {"comment", "comments", "disqus", "respond", "reply", "replies"}
_LAYOUT = {"banner", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "side", "widget", "widgets", "footer", "header", "masthead", "related", "recommend", "recommended", "recommendation", "recommendations"}
_LAYOUT |= {"share", "sharing", "social", "toolbar", "pagination", "pager", "tags", "hidden", "skip"}
_NO_NAME = {"has", "have", "is", "no", "not", "non", "with", "without", "hide", "show", "js", "single", "open"}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Times the prose outside of suspicion that clears an element of layout; characters from which a block is prose.
MOST, PROSE = 4, 25
_NOT_MAIN_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?P<open_end>/?)(?P<open_name>[a-zA-Z][^\s/>]*)(?P<open_attributes>[^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in _RAW}
_WHITE = re.compile(r"\s+")


class Element:
    __slots__ = ("name", "parent", "parts", "cut", "doubt", "points", "own", "linked", "length")

    def __init__(self, name: str, parent: Element | None, cut: bool, doubt: int = 0) -> None:
        self.name, self.parent, self.cut, self.doubt = name, parent, cut, doubt
        self.parts: list[Element | str] = []
        self.points = 0.0
        self.own = self.linked = self.length = 0


#: Doubts of an element: it is cleared if it holds nearly all prose, or only if it holds all.
_SOME, _MUCH = 1, 2


def _named(token: str) -> set[str]:
    """What a token of a class or id names."""
    if token.lower() in _ADVERT | _NOTICE | _REPLIES | _LAYOUT:
        return {token.lower()}
    words = [w.lower() for w in _WORDS.findall(token)]
    if not words or words[0] in _NO_NAME:
        return set()
    if words[0].startswith("comment"):
        return {"comments"}
    return {words[0], words[-1]} if len(words) > 1 else set()


def _judged(name: str, attributes: str, inside_article: bool) -> tuple[bool, int]:
    """Whether an element with these attributes is never main text, and the doubt it is under."""
    if name in _CUT or (name == "header" and not inside_article):
        return True, 0
    doubt = _MUCH if name == "form" else 0
    if not attributes or name in ("html", "body", "article", "main"):
        return False, doubt
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            tokens = value.split()
            if any(t.lower() in _ADVERT for t in tokens):
                return True, 0
            named = set().union(*map(_named, tokens))
            doubt = max(doubt, _MUCH if named & (_NOTICE | _REPLIES | _ADVERT) else _SOME if named & _LAYOUT else 0)
        if key == "role" and value.strip().lower() in _NOT_MAIN_ROLE:
            return True, 0
        if name == "label" and key == "for":
            return True, 0
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
            return True, 0
    return False, doubt


class _Open:
    """The open elements, with the places of each name and of blocks, so that no lookup walks down a deep page."""

    def __init__(self, root: Element) -> None:
        self.stack, self.blocks = [root], [0]
        self.named: dict[str, list[int]] = {}

    def push(self, e: Element) -> None:
        if e.name not in _INLINE:
            self.blocks.append(len(self.stack))
        self.named.setdefault(e.name, []).append(len(self.stack))
        self.stack.append(e)

    def last(self, names) -> int:
        """The place of the innermost element of some names; 0 if none is open."""
        return max((self.named[n][-1] for n in names if self.named.get(n)), default=0)

    def close(self, place: int) -> None:
        """Close the element at a place and all in it."""
        for e in self.stack[place:]:
            self.named[e.name].pop()
        del self.stack[place:]
        while self.blocks[-1] >= place:
            self.blocks.pop()


def parse(page: str) -> Element:
    root = Element("#root", None, False)
    at, opened = 0, _Open(root)
    for _ in iter(int, 1):
        token = _TOKEN.search(page, at)
        here = opened.stack[-1]
        if token is None:
            break
        if token.start() > at:
            here.parts.append(unescape(page[at : token.start()]))
        at = token.end()
        name = token["name"] or token["open_name"]  # the second: a quote in the tag is never closed
        if name is None:
            if token[0].startswith("<![CDATA["):
                here.parts.append(token[0][9:-3])
            continue
        name = name.lower()
        if token["end"] or token["open_end"]:
            found = opened.last((name,))
            # a stray end of an inline element does not close the blocks that opened after it
            if found and not (name in _INLINE and opened.blocks[-1] > found):
                opened.close(found)
            continue
        if name in _CLOSES_P and opened.stack[opened.blocks[-1]].name == "p":
            opened.close(opened.blocks[-1])
        if name in _SELF_CLOSING:
            found = opened.last(_SELF_CLOSING[name])
            if found > opened.last(_SCOPE - _SELF_CLOSING[name]):
                opened.close(found)
        here = opened.stack[-1]
        if name == "br":
            here.parts.append(" ")
            continue
        cut, doubt = _judged(name, token["attributes"] or token["open_attributes"] or "", bool(opened.named.get("article")))
        element = Element(name, here, here.cut or cut, doubt)
        here.parts.append(element)
        if name in _VOID:
            continue
        if name in _RAW:
            end = _ENDS[name].search(page, at)
            at = page.find(">", end.end()) + 1 if end else len(page)
            at = at or len(page)
            continue
        opened.push(element)
    if at < len(page):
        opened.stack[-1].parts.append(unescape(page[at:]))
    return root


def _in_order(root: Element) -> list[Element]:
    """Elements that are not cut, parents before children."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        if not e.cut:
            out.append(e)
            todo += reversed([x for x in e.parts if isinstance(x, Element)])
    return out


def _settle(root: Element) -> None:
    """Clear or cut what is under doubt."""
    order = _in_order(root)
    under: dict[int, Element | None] = {}  # the innermost element under doubt that holds each element
    held: dict[int, list[float]] = {}  # of these: prose in them that no inner one holds; all prose in them, of blocks and of any length
    clean = [0.0, 0.0]
    doubted = []
    for e in order:
        above = under.get(id(e.parent)) if e.parent is not None else None
        under[id(e)] = e if e.doubt else above
        if e.doubt:
            doubted.append(e)
            held[id(e)] = [0.0, 0.0]
    if not doubted:
        return
    for e in order:
        if e.name in _INLINE or e.name in _HEADINGS:
            continue
        size = len(_WHITE.sub(" ", _text(e, links=False)).strip())
        into = clean if under[id(e)] is None else held[id(under[id(e)])]
        into[0] += size if size >= PROSE else 0
        into[1] += size
    inner: dict[int, list[Element]] = {}
    outer = []
    for e in doubted:
        above = under.get(id(e.parent)) if e.parent is not None else None
        inner.setdefault(id(above), []).append(e) if above is not None else outer.append(e)
    total = {}
    for e in reversed(doubted):
        total[id(e)] = held[id(e)][0] + sum(total[id(x)] for x in inner.get(id(e), []))
    todo = outer
    while todo:
        best = max(todo, key=lambda x: total[id(x)])
        some = total[id(best)]
        if not some or (clean[0] * MOST > some if best.doubt == _SOME else clean[1] > 0):
            break
        # the mark is on what holds the article: what is in it is judged by itself
        best.doubt = 0
        clean = [c + h for c, h in zip(clean, held[id(best)], strict=True)]
        todo = [x for x in todo if x is not best] + inner.get(id(best), [])
    for e in order:
        e.cut = e.doubt > 0 or (e.parent is not None and e.parent.cut)


def _measure(order: list[Element]) -> None:
    for e in order:
        e.own = sum(len(_WHITE.sub(" ", x).strip()) for x in e.parts if isinstance(x, str))
    for e in reversed(order):
        e.length += e.own
        if e.name == "a":
            e.linked = e.length
        if e.parent is not None:
            e.parent.length += e.length
            e.parent.linked += e.linked


def _text(e: Element, links: bool = True) -> str:
    """Inline text directly in a block: its strings and those of inline elements in it, those of links or without."""
    out, todo = [], list(reversed(e.parts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.cut and x.name in _INLINE and (links or x.name != "a"):
            todo += reversed(x.parts)
    return "".join(out)


def _score(order: list[Element]) -> None:
    for e in order:
        if e.name in ("article", "main"):
            e.points += 50
        if e.name in _INLINE or e.name == "html":
            continue
        prose = _WHITE.sub(" ", _text(e)).strip()
        if len(prose) < PROSE:
            continue
        points = 1 + prose.count(",") + min(len(prose) // 100, 3)
        holder = e if e.name in _CONTAINER and e.name != "blockquote" else e.parent
        share, step = 1.0, 0
        while holder is not None and step < 5:
            if holder.name in _CONTAINER or step == 0:
                holder.points += points * share
                step += 1
                share = 0.5 if step == 1 else 1 / (3 * step)
            holder = holder.parent


def blocks(kept: list[Element]) -> list[str]:
    """The text of each block in page order, white space turned into single spaces, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _WHITE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list[Element | str | None] = []
    for e in reversed(kept):
        todo += [None, *reversed(e.parts), None]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif not x.cut:
            if x.name in _INLINE:
                todo += reversed(x.parts)
            else:
                todo += [None, *reversed(x.parts), None]
    close()
    return out


def _marked(best: Element) -> Element:
    """The outermost article around the best container, or else the outermost main part, or else itself."""
    around, e = [], best
    while e is not None:
        around.append(e)
        e = e.parent
    for name in ("article", "main"):
        found = [x for x in around if x.name == name]
        if found:
            return found[-1]
    return best


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    order = _in_order(root)
    _measure(order)
    _score(order)
    worth = lambda e: e.points * (1 - e.linked / e.length if e.length else 0.0)
    holders = [e for e in order if e.name in _CONTAINER and e.points > 0 and e.length]
    if not holders:
        body = next((e for e in order if e.name == "body"), order[0] if order else None)
        return "\n\n".join(blocks([body])) if body is not None else ""
    best = _marked(max(holders, key=worth))
    line = max(10.0, worth(best) * 0.2)
    kept = []
    inner = best.name not in ("article", "main", "body", "html", "#root") and best.parent is not None and best.parent.name not in ("body", "html", "#root")
    for x in best.parent.parts if best.parent is not None else [best]:
        if not isinstance(x, Element) or x.cut:
            continue
        density = x.linked / x.length if x.length else 0.0
        prose = x.name == "p" and ((x.length > 80 and density < 0.25) or (0 < x.length <= 80 and not density and "." in _text(x)))
        if x is best or (x.name in _CONTAINER and worth(x) >= line and best.name not in ("body", "html", "#root")) or (prose and best.name != "article") or (inner and x.name in _BESIDE and density < 0.25):
            kept.append(x)
    return "\n\n".join(blocks(kept))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    bounded_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def main_text(column: pa.Array) -> pa.Array:
        out: list[str] = []
        for start, stop, _, _ in text_slices(column):
            out += [extract(x) for x in column.slice(start, stop - start).to_pylist()]
        return pa.array(out, pa.string())

    return pages.select("page_id", "url", main_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
