"""Main text of web pages by scoring the tree of their elements.

A page is read once, tag by tag, into a tree of elements and the blocks of text between block-level tags.  Elements that cannot be
part of an article go first: scripts, forms, navigation, and whatever a role, class or id calls an advert, a notice, a sidebar or a
comment.  Every block of prose that is left earns points for its length and its commas, less for text that stands in links, and
passes them on: all to the element around it, half to the next one, a third to the one beyond.  The element with the most points,
discounted by the share of link text below it, holds the article; neighbours with enough points of their own are kept too.

Pages are judged one by one inside Arrow batches, so that nothing is shuffled and a task holds one page's tree at a time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that hold no mark-up, up to their end tag, and elements inside a block whose text is not read.
RAW = ("script", "style", "noscript", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
MUTE = frozenset("template svg math object audio video canvas select datalist button".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
#: A start tag ends an open element of these kinds, unless one of the second kinds was opened in between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Elements and roles that hold no article text; ``header`` and ``footer`` are judged by where they stand.
NEVER = frozenset("nav aside form menu dialog head search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tooltip".split())
#: Words of a class or an id, told apart by anything that is no letter and by a capital after a small letter.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner sponsor sponsored sponsors promo promos promotion promoted outbrain taboola"
    " nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager toolbar sidebar sidebars aside rail footer foot masthead"
    " cookie cookies consent gdpr notice notices notification notifications alert disclaimer popup modal overlay lightbox paywall interstitial"
    " comment comments commentlist disqus respond replies reply discussion reactions feedback"
    " share sharing social related recommended recommendations newsletter subscribe subscription signup login register search form widget widgets header".split()
)
#: Those that take text inside a block away; there the others may mean something else.
INLINE = frozenset("ad ads adsbygoogle advert advertisement share sharing".split())
#: Those that count whatever else a class says.
STRICT = frozenset("ad ads comment comments cookie sidebar footer nav menu related".split())
FOR = frozenset("article body content entry main page post text story blog hentry prose".split())
#: Elements that are parts of a text and hold no article by themselves.
PARTS = frozenset("p ul ol li dl dt dd menu dir table caption thead tbody tfoot tr th blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 hgroup".split())
#: Headings above what readers wrote.
_REMARKS = re.compile(r"\W*\d*\W*(?:reader |user )?(?:comments?|responses?|replies|discussion|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)\b[\W\d]*$", re.I)

_TAG = re.compile(
    r"<!--(?:.*?--!?>|>|->|.*\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|.*\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: An end tag of these kinds closes nothing outside the table cell that it stands in.
_CELLS, _NONE = frozenset({"td", "th", "table"}), frozenset()
_FENCED = frozenset("p div section article span li ul ol dl dd dt blockquote".split())
#: A block shorter than this earns points for its length alone.
PROSE = 25
#: Points of an element that is meant to hold an article, or of a fitting class; and of a neighbour that is kept, at least and as a share.
MEANT, FITTING, LEAST, SHARE = 25.0, 10.0, 10.0, 0.2


class Element:
    """An element of the tree; ``parts`` are its elements and blocks in page order."""

    __slots__ = ("tag", "parent", "parts", "words", "role", "hidden", "mute", "points", "length", "linked", "linking", "first", "prose", "paragraphs", "titled", "within", "marked")

    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag, self.parent, self.parts = tag, parent, []
        self.words, self.role, self.hidden, self.mute = frozenset(), "", False, 0
        self.points, self.length, self.linked, self.linking = 0.0, 0, 0, 0
        if attributes and "=" in attributes or "hidden" in attributes:
            named = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
            self.words = frozenset(w.lower() for key in ("class", "id", "itemprop") for w in _WORD.findall(named.get(key, "")))
            self.role = named.get("role", "").strip().lower()
            self.hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in re.sub(r"\s", "", named.get("style", "").lower())


class Block:
    """A stretch of text between two block-level tags, and how many of its characters stand in links."""

    __slots__ = ("text", "linked", "parent")

    def __init__(self, text: str, linked: int, parent: Element):
        self.text, self.linked, self.parent = text, linked, parent


def parse(page: str) -> Element:
    """The tree of a page; broken mark-up is mended as far as a browser would: open elements are closed where they must end."""
    root = Element("#page", None)
    stack, holders, pieces, at = [root], [root], [], 0
    links = mutes = paragraphs = 0  # how many of these are open

    def flush() -> None:
        if pieces:
            text = " ".join("".join([t for t, _ in pieces]).split())
            if text:
                holders[-1].parts.append(Block(text, min(len(text), sum(len(t.strip()) for t, linked in pieces if linked)), holders[-1]))
            pieces.clear()

    def close(down_to: int) -> None:
        nonlocal links, mutes, paragraphs
        for e in reversed(stack[down_to:]):
            links -= e.tag == "a"
            mutes -= e.mute
            paragraphs -= e.tag == "p"
            if e is holders[-1]:
                flush()
                holders.pop()
        del stack[down_to:]

    def innermost(tags: set[str], fence: frozenset[str] | set[str]) -> int | None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in fence:
                return None
        return None

    for m in _TAG.finditer(page):
        if m.start() > at and not mutes:
            text = page[at : m.start()]
            pieces.append((html.unescape(text) if "&" in text else text, links > 0))
        at = m.end()
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if tag == "br" or tag == "hr" and m["end"]:
            pieces.append((" ", False))
        elif m["end"]:
            if tag in BLOCKS:
                found = innermost({tag}, _CELLS - {tag} if tag in _FENCED else _NONE) if tag != "p" or paragraphs else None
                if found is None:
                    flush()
            else:
                found = innermost({tag}, BLOCKS)
            if found is not None:
                close(found)
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            block = tag in BLOCKS
            if block:
                if paragraphs and (found := innermost({"p"}, _CELLS)) is not None:
                    close(found)
                flush()
            if tag in ENDS and (found := innermost(*ENDS[tag])) is not None:
                close(found)
            if tag == "a" and links and (found := innermost({"a"}, BLOCKS)) is not None:
                close(found)
            element = Element(tag, holders[-1], m["attributes"])
            if block:
                holders[-1].parts.append(element)
                holders.append(element)
            else:
                element.mute = int(tag in MUTE or element.hidden or not element.words.isdisjoint(INLINE))
            links += tag == "a"
            mutes += element.mute
            paragraphs += tag == "p"
            stack.append(element)
    if at < len(page) and not mutes:
        pieces.append((html.unescape(page[at:]), links > 0))
    flush()
    return root


def _walk(e: Element) -> Iterator[Element]:
    """``e`` and all elements below it, in page order; no recursion, as pages may nest deeply."""
    todo = [e]
    while todo:
        e = todo.pop()
        yield e
        todo.extend(x for x in reversed(e.parts) if isinstance(x, Element))


def _measure(root: Element) -> list[Element]:
    """What is below and around every element, in one pass each way; the elements in page order."""
    elements = list(_walk(root))
    for e in elements:
        e.within = e.parent is not None and (e.parent.within or e.parent.tag in ("article", "main"))
    for e in reversed(elements):
        e.first, e.prose, e.paragraphs, e.titled, e.marked = None, 0, int(e.tag == "p"), e.tag in ("h1", "h2", "hgroup"), 0
        for x in e.parts:
            if isinstance(x, Block):
                e.first, e.prose = e.first or x, e.prose + len(x.text) - x.linked
            else:
                e.first, e.prose, e.paragraphs, e.titled, e.marked = e.first or x.first, e.prose + x.prose, e.paragraphs + x.paragraphs, e.titled or x.titled, e.marked + x.marked
        e.marked += e.tag in ("article", "main") and not _unfit(e)
    return elements


def _unfit(e: Element) -> bool:
    """Whether an element is no part of an article, by its kind, role, class or id."""
    if e.tag in ("#page", "html", "body", "main"):
        return False
    if e.tag in NEVER or e.hidden or e.role in ROLES or e.tag == "footer":
        return True
    if e.tag == "header":  # an article's own header holds its title
        return not (e.within and e.titled)
    if e.tag in ("section", "div") and e.first is not None and e.first.parent.tag in ("h2", "h3", "h4", "h5", "h6", "summary", "legend") and _REMARKS.match(e.first.text):
        return True
    if not e.words & AGAINST or re.fullmatch("h[1-6]", e.tag):
        return False
    return e.tag == "article" or not e.words & FOR or bool(e.words & STRICT)


def _prune(root: Element) -> None:
    """Takes out what is no part of an article, unless it wraps all articles that the page marks or, where none is marked, most of its prose."""
    _measure(root)
    todo = [root]
    while todo:
        e, gone = todo.pop(), set()
        for x in e.parts:
            if isinstance(x, Block):
                continue
            wraps = False
            if (unfit := _unfit(x)) and x.tag in ("form", "div", "section", "fieldset") and not x.hidden:
                if root.marked:
                    wraps = x.marked == root.marked
                else:
                    wraps = x.prose > (0.5 if x.tag == "form" else 0.8) * root.prose and x.paragraphs >= (1 if x.tag == "form" else 3)
            if unfit and not wraps:
                gone.add(x)
            else:
                todo.append(x)
        if gone:
            e.parts = [x for x in e.parts if x not in gone]


def _score(root: Element) -> list[Element]:
    """Hands the points of all blocks to the elements around them; the elements in page order."""
    elements = list(_walk(root))
    for e in elements:
        holder_of = e if any(isinstance(x, Element) for x in e.parts) or e.parent is None or e.tag in ("body", "article", "main") else e.parent
        for b in e.parts:
            if not isinstance(b, Block):
                continue
            plain = 1 - min(1.0, b.linked / len(b.text))
            points = len(b.text) / 100
            if len(b.text) >= PROSE:
                points += 1 + sum(map(b.text.count, ",、，،"))
            holder = holder_of
            for share in (1, 2, 3):
                holder.points += points * plain / share
                if holder.parent is None:
                    break
                holder = holder.parent
    for e in reversed(elements):
        e.length += sum(len(b.text) for b in e.parts if isinstance(b, Block))
        e.linked += sum(b.linked for b in e.parts if isinstance(b, Block))
        e.linking += sum(b.linked > 0 for b in e.parts if isinstance(b, Block))
        if e.parent is not None:
            e.parent.length += e.length
            e.parent.linked += e.linked
            e.parent.linking += e.linking
    return elements


def _worth(e: Element) -> float:
    extra = (MEANT if e.tag in ("article", "main") or {"article", "body"} <= e.words else FITTING if e.words & FOR and e.tag != "body" else 0) if e.length else 0
    return (e.points + extra) * (1 - e.linked / max(1, e.length))


def _links_only(e: Element) -> bool:
    """Whether an element below the article is a list of links and not prose."""
    return e.tag in ("ul", "ol", "div", "section", "table", "dl") and e.linked > 0.6 * e.length and e.linking >= 2


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; an empty text if the page has none."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    elements = _score(root)
    best = max((e for e in elements if e.length), key=_worth, default=None)  # the first of equals
    if best is None:
        return ""
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    best = around or best
    while best.tag in PARTS and best.parent is not None:
        best = best.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("body", "html"):
        bar, worth = max(LEAST, SHARE * _worth(best)), _worth
        for x in best.parent.parts:
            if x is best:
                kept.append(x)
            elif isinstance(x, Block):
                if best.tag not in ("article", "main") and len(x.text) >= PROSE and x.linked < 0.25 * len(x.text):
                    kept.append(x)
            elif best.tag in ("article", "main"):
                if x.tag == best.tag and worth(x) >= bar:
                    kept.append(x)
            elif worth(x) >= bar or x.tag in ("h1", "h2", "h3") or x.tag in ("p", "blockquote", "pre") and x.length >= PROSE and x.linked < 0.25 * x.length:
                kept.append(x)
        kept = kept[1:]
    out: list[str] = []
    for top in kept:
        todo: list[Element | Block] = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, Block):
                out.append(x.text)
            elif x is top or not _links_only(x):
                todo.extend(reversed(x.parts))
    return "\n".join(out)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: the main text, blocks joined by a line feed, and its code points.

    A null or empty page has an empty text.  Null and repeated ids and urls pass through, row by row; an empty table gives an empty
    one, and other columns, whatever their names, are not read.  Of elements with equal points the first on the page is taken.  A page of
    any length is read whole, in one pass; what a page without end tags leaves open ends with the page, and an unfinished tag is no text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
