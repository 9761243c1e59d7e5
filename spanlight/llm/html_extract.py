"""HTML main-text extraction by tree scoring.

A page becomes a tree. Elements that a page declares to be something else than its article
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader comments; by
element, role, class or id) are cut out. Every paragraph then earns a point, one more for each
comma and up to three for its length, and passes them to its ancestors: whole to the parent,
half to the grandparent, a third part and less of that further up. A container's points are
discounted by the share of its text that lies in links; farther than LEVELS up nothing arrives. The container with the most points is
the article; it grows to the `article` or `main` element around it, and siblings that hold
enough points or read like paragraphs are kept with it; without such an element, so are all
siblings of which less than a quarter lies in links.

A form is cut unless most of the page's text lies in it, in three paragraphs or more, or an `article` or `main` does: then it is the
page's frame, and only its fields go. A button is a form's control wherever it stands. A name cuts an element inside an article only if all its words name things
beside an article or their places: comment-list does, commentary and sponsors-of-the-bill do not. A list of
links inside an article is kept. The title before an article that has none is kept.

Blocks come in page order, joined by two line feeds; white space inside a block is one space;
character references are decoded. No length is cut. A page that has no paragraph at all gives
the blocks left in its body that are not link lists.

Null, empty or text-free pages give an empty text. Unclosed and stray tags are repaired as
browsers do: a block start closes an open paragraph, an end tag closes what is open inside
its element; both also end a cut element that is not closed. What stands inside a script or style
ends at its end tag only. Rows are extracted one by one, so nulls or repeats in other columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup munder mover munderover mspace mstyle mpadded semantics".split())
CUT = frozenset("nav footer aside button select option input fieldset menu dialog head svg object template noscript annotation annotation-xml".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
ARTICLE = frozenset("article main".split())
#: Elements that end an open drawing, which cannot hold them.
OUT_OF_SVG = frozenset("article blockquote body center code dd div dl dt em h1 h2 h3 h4 h5 h6 hr img li main ol p pre section small span strong sub sup table ul".split())
TABLE = frozenset("table caption tbody thead tfoot tr td th".split())
#: Paragraphs that earn points.
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
#: How far up points are passed.
LEVELS = 30
#: What a start tag closes, up to the nearest element of the second set.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

#: Words of class and id values that name advertising or comment services wherever they stand.
SERVICES = frozenset("adsense adslot adbox advert adverts advertisement advertisements disqus gdpr outbrain taboola".split())
#: Words that name what is not the article, and beginnings of such words; inside an article only beside each other or words for places.
CUT_WORDS = frozenset("ad ads nav menu menus rail widget widgets footer masthead topbar infobar disqus popup modal overlay signup login toolbar pager pagination aside tooltip toast".split())
CUT_STARTS = ("advert", "navig", "navbar", "breadcrumb", "sidebar", "cookie", "newsletter", "subscri", "paywall")
#: Words that name it only alone or beside such words, as in share-bar but not in share-price.
CUT_ALONE = frozenset(
    "respond reply replies discussion notice notices alert alerts warning share sharing social related trending popular search form hidden disclaimer teaser teasers ticker feedback skip "
    "banner banners sponsor sponsors sponsored promo promos promotion promotions promoted promotional comment comments commentlist commenter consent recommend recommended recommendation recommendations".split()
)
CONTAINERS = frozenset(
    "area article bar block body bottom box btn button buttons card cards center col column container content copy dialog feed footer global grid group header holder icon icons inline inner item items left link links "
    "list main message module more nav news outer page panel reader readers slot thread unit x parent post posts right row section sections side site small stories strip text title to top user widget wrap wrapper".split()
)
#: Words that take the meaning of the following one away: has-sidebar.
NOT_WORDS = frozenset("has with no without hide show".split())
KEPT_WHATEVER = frozenset("html body article main".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=/>][^\s"'=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "points", "chars", "link_chars")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list = []
        self.points = 0.0
        self.chars = self.link_chars = 0


def _names_other(names: str, in_article: bool) -> bool:
    """Whether one of the names in a class or id value says that the element is no part of the article."""
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        strong = [w in CUT_WORDS or w.startswith(CUT_STARTS) for w in words]
        for k, w in enumerate(words):
            if k and words[k - 1] in NOT_WORDS:
                continue
            if w in SERVICES or strong[k] and not in_article:
                return True
            if (strong[k] or w in CUT_ALONE) and all(x or v in CUT_ALONE or v in CONTAINERS or v.isdigit() for v, x in zip(words, strong)):
                return True
    return False


def _is_cut(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in CUT or tag == "header" and not in_article:
        return True
    if not attrs or tag in KEPT_WHATEVER:
        return False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in CUT_ROLES and not (tag == "form" and value.lower() == "form") or name in ("class", "id") and _names_other(value, in_article):
            return True
    return False


#: Where an element ends whose content is no markup.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}


def _after_raw(page: str, place: int, tag: str) -> int:
    """Where the page goes on after an element without markup inside: behind its end tag, whatever stands before it."""
    m = RAW_END[tag].search(page, place)
    return m.end() if m else len(page)


class Open:
    """The open elements from the outermost on, and at which depths each tag stands, so that no question walks up the tree."""

    def __init__(self):
        self.tags: list[str] = []
        self.nodes: list[Node] = []
        self.where: dict[str, list[int]] = {}
        self.no_inline = self.no_plain = 0

    def push(self, tag: str, node: Node | None = None) -> None:
        self.where.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)
        self.no_inline += tag not in INLINE
        self.no_plain += tag not in INLINE and tag not in PLAIN

    def cut(self, depth: int) -> None:
        """Closes what stands at this depth and deeper."""
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.nodes.pop()
            self.where[tag].pop()
            self.no_inline -= tag not in INLINE
            self.no_plain -= tag not in INLINE and tag not in PLAIN

    def last(self, tags) -> int:
        """The depth of the innermost open element of these tags; -1 if there is none."""
        return max((w[-1] for t in tags if (w := self.where.get(t))), default=-1)

    def closable(self, tags: frozenset, until: frozenset) -> int:
        """The depth of the element that a start tag closes: of `tags`, with none of `until` inside it; -1 if none."""
        depth = self.last(tags)
        return depth if depth > self.last(until) else -1


PLAIN = frozenset(("div", "p", "address"))
P, TABLE_OR_BUTTON = frozenset(("p",)), frozenset(("table", "button"))


def parse(page: str) -> Node:
    """The page's tree without the elements that are cut."""
    root = Node("#root", "", None)
    open_, skipped = Open(), Open()  # skipped: open elements inside one that is cut
    open_.push("#root", root)
    place, forms = 0, []
    while place < len(page):
        m = TOKEN.match(page, place)
        place, tag = m.end(), m[2]
        if tag is None:
            text = m[0]
            if not skipped.tags and (text[0] != "<" or text == "<"):
                open_.nodes[-1].parts.append(html.unescape(text))
            continue
        tag, closing = tag.lower(), bool(m[1])
        if not closing and tag in RAW:
            place = _after_raw(page, place, tag)
            continue
        if skipped.tags:
            if closing and (depth := skipped.last((tag,))) >= 0:
                skipped.cut(depth)
                continue
            if closing:
                if not (_reaches(tag, skipped) and open_.last((tag,)) >= 0):
                    continue
                skipped.cut(0)
            else:
                if tag == "body":
                    skipped.cut(0)
                elif tag in OUT_OF_SVG and skipped.where.get("svg") and not skipped.where.get("foreignobject"):
                    skipped.cut(skipped.where["svg"][0])
                if skipped.tags and tag not in INLINE and tag != "br":
                    _close_skipped(skipped, open_, P, TABLE_OR_BUTTON)
                if tag in CLOSES and skipped.tags:
                    _close_skipped(skipped, open_, *CLOSES[tag])
                if skipped.tags:
                    if tag not in VOID:
                        skipped.push(tag)
                    continue
        if closing:
            if (depth := open_.last((tag,))) > 0:
                open_.cut(depth)
            continue
        if tag not in INLINE and tag != "br" and (depth := open_.closable(P, TABLE_OR_BUTTON)) > 0:
            open_.cut(depth)
        if tag in CLOSES and (depth := open_.closable(*CLOSES[tag])) > 0:
            open_.cut(depth)
        at = open_.nodes[-1]
        if tag in VOID:
            at.parts.append(" " if tag in ("br", "img", "wbr") else "")
            if tag == "hr":
                at.parts.append(Node("hr", "", at))
            continue
        if _is_cut(tag, m[3], open_.last(ARTICLE) >= 0):
            if not m[3].rstrip().endswith("/"):
                skipped.push(tag)
            at.parts.append(" ")
            continue
        x = Node(tag, m[3], at)
        at.parts.append(x)
        open_.push(tag, x)
        if tag == "form":
            forms.append(x)
    if forms:
        _cut_forms(root, forms)
    return root


def _close_skipped(skipped: Open, open_: Open, tags: frozenset, until: frozenset) -> None:
    """A start tag's closing inside a cut element; nothing is skipped any more if the element itself or one around it closes."""
    low, high = skipped.last(until), skipped.last(tags)
    if max(low, high) >= 0:
        if high > low:
            skipped.cut(high)
    elif not skipped.no_plain and open_.closable(tags, until) > 0:
        skipped.cut(0)


def _reaches(tag: str, skipped: Open) -> bool:
    """Whether an end tag closes an element around the open elements of one that is cut."""
    if tag in INLINE:
        return not skipped.no_inline
    if tag in TABLE:
        return skipped.last(("table",)) < 0
    return skipped.last(TABLE) < 0 and (tag != "li" or skipped.last(("ul", "ol", "menu")) < 0)


def _in_order(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(p for p in reversed(x.parts) if isinstance(p, Node))
    return order


def _cut_forms(root: Node, forms: list[Node]) -> None:
    """Empties the forms that are no frame of the page."""
    order = _in_order(root)
    size: dict[int, int] = {}
    paragraphs: dict[int, int] = {}
    framed: set[int] = set()
    for x in reversed(order):
        size[id(x)] = sum(len(p.strip()) if isinstance(p, str) else size[id(p)] for p in x.parts)
        below = [p for p in x.parts if isinstance(p, Node)]
        paragraphs[id(x)] = (x.tag in PARAGRAPH) + sum(paragraphs[id(p)] for p in below)
        if x.tag in ARTICLE or any(id(p) in framed for p in below):
            framed.add(id(x))
    for x in forms:
        if id(x) not in framed and (2 * size[id(x)] <= size[id(root)] or paragraphs[id(x)] < 3):
            x.parts = [" "]


def _score(root: Node) -> list[Node]:
    """Sets the points and sizes of all nodes; returns the elements in page order."""
    order = _in_order(root)
    commas: dict[int, int] = {}
    direct: dict[int, int] = {}
    for x in reversed(order):
        own = [" ".join(p.split()) for p in x.parts if isinstance(p, str)]
        size = sum(map(len, own))
        direct[id(x)] = size
        commas[id(x)] = sum(t.count(",") + t.count("，") + t.count("、") for t in own)
        for p in x.parts:
            if isinstance(p, Node):
                x.chars += p.chars
                x.link_chars += p.chars if p.tag == "a" else p.link_chars
                if p.tag in INLINE:
                    commas[id(x)] += commas[id(p)]
                    direct[id(x)] += direct[id(p)]
        x.chars += size
    for x in order:
        if x.tag in INLINE or x.parent is None or direct[id(x)] < 25 or x.tag not in PARAGRAPH and x.tag not in ("div", "section", "article", "main", "body"):
            continue
        points = (1 + commas[id(x)] + min(direct[id(x)] / 100, 3)) * (1 - x.link_chars / max(1, x.chars))
        y, level = (x.parent if x.tag in PARAGRAPH else x), 0
        while y is not None and level < LEVELS:
            y.points += points / (1, 2)[level] if level < 2 else points / (3 * level)
            y, level = y.parent, level + 1
    for x in order:
        x.points *= 1 - x.link_chars / max(1, x.chars)
    return order


def _links(x: Node) -> float:
    return x.link_chars / max(1, x.chars)


def _chosen(root: Node) -> list[Node]:
    order = _score(root)
    held = [x for x in order if x.tag not in INLINE and x.points > 0 and x.tag not in ("#root", "html")]
    if not held:
        return [root]
    best = max(held, key=lambda x: x.points)
    x = best
    while x is not None and x.tag not in ARTICLE:
        x = x.parent
    best = x or best
    if best.parent is None or best.tag == "body":
        return [best]
    out, titled = [], best.tag not in ARTICLE or any(x.tag == "h1" for x in _in_order(best))
    for x in best.parent.parts:
        if not isinstance(x, Node):
            continue
        if x is best:
            titled = True  # what follows is no title
        prose = x.tag in PARAGRAPH and x.tag != "li" and x.chars and (_links(x) < 0.25 if x.chars > 80 else not x.link_chars)
        heading = x.tag in ("h1", "h2") and best.tag not in ARTICLE and _links(x) < 0.5 or x.tag == "h1" and not titled and x.chars and _links(x) < 0.5
        sparse = best.tag not in ARTICLE and x.tag not in INLINE and x.tag != "hr" and x.chars and _links(x) < 0.25
        twin = best.tag in ARTICLE and x.tag in ARTICLE and x.chars and _links(x) < 0.33
        if x is best or twin or x.points >= max(10.0, 0.2 * best.points) or prose or heading or sparse:
            out.append(x)
    return out


def _blocks(tops: list[Node]) -> list[str]:
    out, now = [], []

    def end():
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                now.append(x)
            elif x.tag in INLINE:
                todo.extend(reversed(x.parts))
            elif x.tag in ("td", "th"):
                now.append(" ")
                todo.extend(reversed(x.parts))
            elif x.tag in ("ul", "ol", "div", "section") and _links(x) > 0.6 and x.chars and x is not top and top.tag not in ARTICLE:
                end()  # a list of links is a menu
            else:
                end()
                todo.append(None)
                todo.extend(reversed(x.parts))
        end()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(_blocks(_chosen(parse(page)))) if page else ""


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """A row per input row: page_id, url, text and its code points; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), column(texts, pa.string()), column([len(t) for t in texts], pa.int64())], names=[page_id, url, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    return pages.select(page_id, url, page).mapInArrow(run, f"`{page_id}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long")
