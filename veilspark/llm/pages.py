"""Main text of HTML pages by two passes of block rules.

Method (after jusText): blocks are classified by link density, length and stop-word density; short blocks that
this leaves open inherit the label of the nearest decided neighbour. Elements whose name or role says
that they hold no main text decide their blocks beforehand, and so do class words and forms unless most good text is below them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without main text.
OUTSIDE = frozenset(
    "head nav footer aside dialog menu button select option datalist canvas svg math object embed audio video template map "
    "search noscript".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Elements and roles that hold no main text, unless a whole page stands in them.
SOFT = frozenset(["form"])
#: Words of class names and ids that mark elements without main text.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register paywall nav "
    "navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer foot masthead topbar toolbar comment "
    "comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations "
    "trending popular pagination pager copyright legal disclaimer search skip tags".split()
)
#: First parts of class names that tell what a page has or is filed under, not what the element is.
STATES = frozenset("has no with without category".split())
INSIDE = frozenset(["article", "main"])
# The most frequent function words of a few languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all "
    "she there would their we him been has when who will more no if out so what up said its about than into them can only other "
    "le la les de des du et un une en que qui est dans pour par sur au aux pas avec ce il elle ne se son sa ses plus ou mais nous vous "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am "
    "el los las y del por con para una su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split()
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
#: Characters and densities of the first pass.
SHORT, LONG, STOPS, LINKS = 40, 140, 0.12, 0.4
#: Density of stop words that a long block has at least, on a page in a language whose stop words are known.
FEW_STOPS = 0.03


class _Element:
    __slots__ = ("inside", "name", "outside", "worded")

    def __init__(self, name: str, outside: bool, inside: bool, worded: tuple[int, ...] = ()) -> None:
        self.name, self.outside, self.inside, self.worded = name, outside, inside, worded


class Block:
    """Text of one block: its pieces, how much of it is link text, and where it stands.

    ``worded`` are the places of the elements around it whose class or id has a word of ``OUTSIDE_WORDS``.
    """

    __slots__ = ("good", "heading", "inside", "links", "outside", "text", "worded")

    def __init__(self, text: str, links: float, outside: bool, inside: bool, heading: bool, worded: tuple[int, ...] = ()) -> None:
        self.worded = worded
        self.text, self.links, self.outside, self.inside, self.heading = text, links, outside, inside, heading
        self.good: bool | None = None


def _marked(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether the element's name or role says that it holds no main text, and whether a class or id word does."""
    if name in OUTSIDE:
        return True, False
    worded = name in SOFT
    if name in ("html", "body") or "=" not in attributes and "hidden" not in attributes.lower():
        return False, worded
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'"))
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" and name not in INSIDE:
            return True, False
        if key == "role" and not OUTSIDE_ROLES.isdisjoint(value.lower().split()):
            return True, False
        worded |= key == "role" and not SOFT.isdisjoint(value.lower().split())
        if key in ("class", "id") and name != "main" and not (name in HEADINGS or name == "a"):
            for one in value.split():
                words = _SPLIT.split(_CAMEL.sub("-", one).lower())
                worded |= words[0] not in STATES and not OUTSIDE_WORDS.isdisjoint(words)
    return False, worded


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order."""
    found: list[Block] = []
    stack: list[_Element] = []
    pieces: list[str] = []
    linked: list[str] = []
    links = 0
    heading = False
    scope = _Element("", False, False)

    def close_block() -> None:
        nonlocal pieces, linked, heading
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                inner = " ".join(html.unescape("".join(linked)).split())
                found.append(Block(text, len(inner) / len(text), scope.outside, scope.inside, heading, scope.worded))
        pieces, linked = [], []
        heading = False

    def add(text: str) -> None:
        pieces.append(text)
        if links:
            linked.append(text)

    def pop_to(k: int) -> None:
        nonlocal scope, links
        for x in stack[k:]:
            links -= x.name == "a"
        del stack[k:]
        scope = stack[-1] if stack else _Element("", False, False)

    def last(names: frozenset[str] | tuple[str, ...], until: frozenset[str] | tuple[str, ...] = ()) -> int | None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                return k
            if stack[k].name in until:
                return None
        return None

    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            add(page[at:])
            break
        if tag > at:
            add(page[at:tag])
        following = page[tag + 1 : tag + 2]
        if following in ("!", "?"):
            if page.startswith("<!--", tag):
                end = page.find("-->", tag + 4)
                # A comment may also be closed at once; one that is never closed hides the rest.
                at = tag + 5 if page.startswith("<!-->", tag) else n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", tag):
                end = page.find("]]>", tag)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", tag)
                at = n if end < 0 else end + 1
            continue
        m = (_TAG.match(page, tag) or _LOOSE_TAG.match(page, tag)) if following == "/" or following.isalpha() else None
        if m is None:
            if following == "/" or following.isalpha() and page.find(">", tag) < 0:
                end = page.find(">", tag)
                at = n if end < 0 else end + 1  # a broken or cut off tag is no text
            else:
                add("<")
                at = tag + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "br":
                add(" ")
            elif name in BLOCKS or name == "a":
                if name != "a":
                    close_block()
                barrier = ("table", "article", "main") if name in ("p", "li", "td", "th", "dd", "dt", "div") else ()
                k = last((name,), () if name in barrier else barrier)
                if k is not None:
                    pop_to(k)
            elif name in OUTSIDE and (k := last((name,))) is not None:
                pop_to(k)
            elif name in ("span", "font", "small", "section") and (k := last((name,), tuple(BLOCKS))) is not None:
                pop_to(k)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            close_at = n if end is None else page.find(">", end.start())
            at = n if close_at < 0 else max(close_at, at) + (end is not None)
            continue
        if name == "br":
            add(" ")
            continue
        block = name in BLOCKS
        if block:
            close_block()
            # Elements that a new one ends.
            k = last(("p",), ("table", "article", "main", "button"))
            if k is not None and name not in ("html", "body", "head"):
                pop_to(k)
            if name in ("li", "dd", "dt", "option") and (k := last((name,), ("ul", "ol", "dl", "menu", "select", "table"))) is not None:
                pop_to(k)
            if name in ("td", "th", "tr") and (k := last(("td", "th") if name != "tr" else ("tr",), ("table",))) is not None:
                pop_to(k)
            if name in INSIDE and (k := last(("nav", "head", "menu"))) is not None:
                pop_to(k)
            elif name not in ("head", "html") and (k := last(("head",))) is not None:
                pop_to(k)
        if name in VOID or m[3].endswith("/") and not block and name != "a":
            continue
        if name in HEADINGS:
            heading = True
        marked, word = _marked(name, m[3])
        word = word and not (scope.outside or marked)
        if word and not block:
            marked = True
        outside = scope.outside or marked or name == "header" and not scope.inside
        inside = scope.inside or name in INSIDE and not outside
        if block or outside != scope.outside or name == "a":
            if outside and not scope.outside and not block and name != "a":
                # An inline part without main text ends no block; it is left out of it.
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                close_at = n if end is None else page.find(">", end.start())
                at = n if close_at < 0 else close_at + (end is not None)
                continue
            scope = _Element(name, outside, inside, (*scope.worded, tag) if word and block else scope.worded)
            stack.append(scope)
            links += name == "a"
    close_block()
    return found


def _stops(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _content(b: Block, known: bool) -> bool | None:
    """The label that a block's own text gives it. ``known``: stop words of the page's language are known.

    A long block without stop words is a list of names and numbers; inside an article its neighbours decide.
    """
    if b.links > LINKS and not b.heading:
        return False
    if len(b.text) <= SHORT:
        return None
    stops = _stops(b.text)
    if len(b.text) > LONG:
        return True if not known or stops >= FEW_STOPS else None if b.inside else False
    return True if stops >= STOPS else None


def _known(found: list[Block]) -> bool:
    """Has a long block of the page as many stop words as prose has?"""
    return any(len(b.text) > LONG and b.links <= LINKS and _stops(b.text) >= STOPS for b in found)


def _settle_words(found: list[Block]) -> None:
    """Blocks under a class or id word or a form are outside, unless its element holds over half of the page's good text.

    Where an article or main element without such a word has good text, it is the main text and all words hold.
    """
    known = _known(found)
    good = [b for b in found if not b.outside and _content(b, known)]
    held: dict[int, int] = {}
    for b in good:
        for place in b.worded:
            held[place] = held.get(place, 0) + len(b.text)
    most = sum(len(b.text) for b in good) / 2
    plain = any(b.inside and not b.worded for b in good)
    for b in found:
        if any(plain or held.get(place, 0) <= most for place in b.worded):
            b.outside = True
            b.inside = False


def classify(found: list[Block]) -> None:
    """Sets ``good`` of each block.

    First pass: a block of an element without main text is bad, and so is one that is mostly links. A long one with
    some stop words, or one of medium length with many, is good; where the page's language isn't known any long one is. Second pass: a heading takes the label of the next decided
    block, any other short block that of the nearest (the earlier one if both are as near). Inside an article
    element only neighbours inside count, and blocks that none decides are good there; so are they on
    a page where nothing at all is decided as good.
    """
    _settle_words(found)
    known = _known([b for b in found if not b.outside])
    for b in found:
        b.good = False if b.outside else _content(b, known)
    decided = [b.good for b in found]
    for k, b in enumerate(found):
        if decided[k] is not None:
            continue
        near: list[tuple[float, bool]] = []
        for step, first in ((-1, k - 1), (1, k + 1)):
            at = first
            while 0 <= at < len(found):
                x = found[at]
                if b.inside and not x.inside and decided[at] is not True:
                    if not x.outside:
                        break
                elif decided[at] is not None and not (b.inside and x.outside):
                    near.append((abs(at - k) - 0.5 * (step < 0) - 100 * (b.heading and step > 0), bool(decided[at])))
                    break
                at += step
        label = min(near)[1] if near else True
        b.good = label or b.inside and b.links <= LINKS


def main_text(page: str | None) -> str:
    """The good blocks of a page, two line breaks between them. Null, empty and hopeless pages give ''."""
    found = blocks(page or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.good)


def extract_main_text(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in column ``name``; all other columns but ``source`` stay.

    One row in, one row out: repeated rows, null keys and extra columns pass through. Nothing is shuffled. A
    column that is already called ``name`` is replaced.
    """

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(x) for x in part], dtype=object)

    return pages.withColumn("__main", texts(F.col(source))).drop(source, name).withColumnRenamed("__main", name)
