"""Main text of HTML pages by the distribution of text over lines.

Markup becomes lines, one a block. A line's weight is its text outside links, or nothing
if links are most of it. Sums of weights over sliding windows of WINDOW lines rise from
nothing at surge points and fall back at dive points; what lies between is a stretch, with
all its lines, short ones too. Link lists between two stretches of one container belong to
both, and make one stretch of them. Windows don't reach into or out of a marked article
(the article and main elements). The distribution decides what is kept: the stretches of
all marked articles together, unless one stretch outside is more than TRUST times as heavy
(articles that are only teasers); without marks, the heaviest stretch and the others that
begin in its container, so that an article isn't cut by figures or lists of links.

Scripts, styles, comments and forms weigh nothing, as do elements whose tag, role, class
or id marks them as page furniture: their lines are no part of a stretch. An element that
holds the page's heaviest article or most of its text outside links is never furniture. A
class or id marks furniture if all its parts say so ("site-footer", "comment-list"), not
if one does ("share-price-note", "has-sidebar").

Defined cases: null and empty html give an empty text; unclosed elements end where their
parent's end tag or the page ends; character references are decoded after tags are gone;
white space (also U+00A0) inside a line becomes one blank; equal stretches: the first;
repeated pages each have a row. Broken pages are read as HTML's rules say, in linear time.
Extra columns pass through; added columns replace those of the same name. Pages are read
in slices of about SLICE bytes, so a batch of long ones isn't held as lines at once.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common, packed

WINDOW, TRUST, SLICE = 3, 3, 1 << 23
#: HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset(("script", "style"))
RAW = CODE | frozenset("noscript textarea title iframe xmp noembed noframes".split())
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: Elements that aren't text of the page, or that hold none.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button head template svg math object canvas select".split())
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
PARTS = re.compile(r"[_-]+|(?<=[a-z0-9])(?=[A-Z])")
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset(("br", "td", "th"))
#: Words in class, id and role that mark page furniture.
FURNITURE_WORDS = frozenset("ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related replies responses share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topnav widget widgets".split())
#: Words of place in front of them, of what remarks belong to, and of form behind.
PLACES = frozenset("site page global top bottom left right main l c o u js".split())
OWNERS = frozenset("post article entry user reader".split())
REMARKS = frozenset("comment comments replies responses".split())
FORMS = frozenset("area articles bar block body box buttons container content holder inner item items links list posts section slot stories thread unit wrap wrapper".split())
#: Those words that mark a paragraph or heading inside an article too.
NOTICES = frozenset("ad ads advert advertisement adverts consent cookie cookies gdpr newsletter notice notices promo promoted signup sponsor sponsored subscribe".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())

#: A tag by HTML's rules: quotes count only where a value begins, and other values end at white space.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+)>""")
OPENS = re.compile(r"<(?=[a-zA-Z!?/])")
MARK = re.compile(r"""(?<![^\s/"'])(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)""", re.I)


@dataclass(frozen=True)
class Tag:
    start: int
    end: int
    closes: bool
    name: str
    attributes: str


def tags(page: str) -> list[Tag]:
    """The page's tags in order; comments, and raw elements with what they hold, are tags without a name.

    Takes time linear in the page. A tag that runs to the page's end under the quoting rules
    shows that a quote isn't closed; from there on tags end at the next `>`. A script or style
    that isn't closed, and a tag that isn't, take the rest of the page.
    """
    out: list[Tag] = []
    at, plain, open_ended = 0, False, set()
    while m := OPENS.search(page, at):
        start = m.start()
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            out.append(Tag(start, at, False, "", ""))
            continue
        if page[start + 1] in "!?" or (page[start + 1] == "/" and not page[start + 2 : start + 3].isascii()) or (page[start + 1] == "/" and not page[start + 2 : start + 3].isalpha()):
            end = page.find(">", start)
            at = len(page) if end < 0 else end + 1
            out.append(Tag(start, at, False, "", ""))
            continue
        found = None if plain else TAG.match(page, start)
        if found:
            at, closes, name, attributes = found.end(), bool(found[1]), found[2], found[3]
        else:
            plain, end = True, page.find(">", start)
            if end < 0:
                out.append(Tag(start, len(page), False, "", ""))
                break
            body = NAME.match(page, start)
            at, closes, name = end + 1, bool(body[1]), body[2]
            attributes = page[body.end() : end]
        name = name.lower()
        if name in RAW and not closes and name not in open_ended:
            end = RAW_ENDS[name].search(page, at)
            if end:
                at = page.find(">", end.end()) + 1 or len(page)
                name = ""
            elif name in CODE:
                at, name = len(page), ""
            else:
                open_ended.add(name)
        out.append(Tag(start, at, closes, name, attributes))
    return out


def _furniture(tag: str, attributes: str, inside: bool) -> bool:
    if tag in FURNITURE_TAGS or (tag == "header" and not inside):
        return True
    if tag in ("body", "html", "main") or not attributes:
        return False
    for name, value in MARK.findall(attributes):
        value = value.strip("\"'")
        if name.lower() == "role" and value.lower() in ROLES:
            return True
        if any(_named(token, inside, tag in TEXTS) for token in value.split()):
            return True
    return False


@lru_cache(1 << 14)
def _named(token: str, inside: bool, text: bool = False) -> bool:
    """All parts of a class or id mark furniture, but for words of place in front of them and of
    form behind. Inside an article, a header is its own, as the header element is, and a
    paragraph or heading is furniture only as a notice or an advert."""
    parts = [x.lower() for x in PARTS.split(token) if x]
    while len(parts) > 1 and parts[-1] in FORMS:
        parts = parts[:-1]
    while len(parts) > 1 and (parts[0] in PLACES or (parts[0] in OWNERS and parts[-1] in REMARKS)):
        parts = parts[1:]
    words = NOTICES if inside and text else FURNITURE_WORDS
    return bool(parts) and words.issuperset(parts) and not (inside and parts == ["header"])


def _bodies(page: str, found: list[Tag]) -> set[int]:
    """Starts of elements that aren't furniture whatever their names say.

    These are the heaviest article or main and all that hold it, if one is outside furniture;
    else elements that hold the heaviest of all, and such that only their names make
    furniture (or forms) with most of the page's text outside links.
    """
    stack: list[tuple[str, int, int, bool]] = []
    sizes: list[tuple[int, int, int, str, bool]] = []
    opened: Counter[str] = Counter()
    size, at, articles = 0, 0, 0

    def close(k: int, end: int) -> None:
        nonlocal articles
        for tag, start, before, named in stack[k:]:
            sizes.append((start, end, size - before, tag, named))
            opened[tag] -= 1
            articles -= tag in ("article", "main") and not named
        del stack[k:]

    for m in found:
        if not opened["a"]:
            size += len(page[at : m.start].strip())
        at, tag = m.end, m.name
        if not tag:
            continue
        if m.closes:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k, m.end)
        elif tag not in VOID and not m.attributes.rstrip().endswith("/"):
            if tag == "p":
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span"):
                    close(len(stack) - 1, m.start)
            named = (stack[-1][3] if stack else False) or _furniture(tag, m.attributes, articles > 0)
            stack.append((tag, m.start, size, named))
            opened[tag] += 1
            articles += tag in ("article", "main") and not named
    if not opened["a"]:
        size += len(page[at:].strip())
    close(0, len(page))
    marked = [x for x in sizes if x[3] in ("article", "main") and x[2]]
    top = max(marked, key=lambda x: (not x[4], x[2], -x[0]), default=None)
    clear = top is not None and not top[4]
    whole = FURNITURE_TAGS - {"form"}  # a form may be wrapped around a page
    return {start for start, end, own, tag, _ in sizes if (2 * own > size and not clear and tag not in whole) or (top and start <= top[0] and end >= top[1])}


class Boxes:
    """The tree of block elements; number 0 is the page."""

    def __init__(self) -> None:
        self.parent, self.last = [0], [0]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        self.last.append(0)
        return len(self.parent) - 1

    def close(self, box: int) -> None:
        self.last[box] = len(self.parent) - 1

    def holds(self, box: int, other: int) -> bool:
        return box <= other <= (self.last[box] or len(self.parent))


#: Text, characters outside links, number of its marked article or 0, innermost block.
Line = tuple[str, int, int, int]


def lines(page: str) -> tuple[list[Line], Boxes]:
    """Each line with text that isn't furniture's, and the tree of blocks."""
    found = tags(page)
    out: list[Line] = []
    kept, boxes = _bodies(page, found), Boxes()
    text: list[str] = []
    bare: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, hidden, its block or 0
    opened: Counter[str] = Counter()
    skip, link, article, number, at, box = 0, 0, 0, 0, 0, 0

    def flush() -> None:
        joined = " ".join(htmllib.unescape("".join(text)).split())
        if joined:
            out.append((joined, len(" ".join(htmllib.unescape("".join(bare)).split())), number if article else 0, box))
        text.clear()
        bare.clear()

    def put(piece: str) -> None:
        if not skip:
            text.append(piece)
            if not link:
                bare.append(piece)

    def pop() -> None:
        nonlocal skip, link, article, box
        tag, hidden, own = stack.pop()
        opened[tag] -= 1
        skip -= hidden
        article -= not hidden and tag in ("article", "main")
        link -= not hidden and tag == "a"
        if own:
            boxes.close(own)
            box = boxes.parent[own]

    for m in found:
        put(page[at : m.start])
        at, tag = m.end, m.name
        if not tag:
            put(" ")
            continue
        if tag in BLOCKS and not skip:
            flush()
        elif tag in SPACED:
            put(" ")
        if m.closes:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID and not m.attributes.rstrip().endswith("/"):
            if tag == "p":  # a paragraph ends an open one
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span"):
                    pop()
            hides = m.start not in kept and _furniture(tag, m.attributes, article > 0)
            own = boxes.add(box) if tag in BLOCKS else 0
            box = own or box
            stack.append((tag, hides, own))
            opened[tag] += 1
            skip += hides
            if not hides and tag in ("article", "main"):
                number += not article and not skip
                article += 1
            link += not hides and tag == "a"
    put(page[at:])
    flush()
    return out, boxes


def _joins(found: list[Line], boxes: Boxes, last: int, first: int) -> bool:
    """The lines between two stretches are link lines of the container that holds both ends."""
    box = boxes.parent[found[last][3]]
    return box == boxes.parent[found[first][3]] and all(boxes.holds(box, x[3]) and 2 * x[1] < len(x[0]) for x in found[last + 1 : first])


def stretches(found: list[Line], boxes: Boxes) -> list[tuple[int, int, int, int]]:
    """(first line, line after the last, weight, article number) between surge and dive points."""
    # In a marked article links are text too, so that its lists of them are kept.
    weights = [len(t) if inside else w if 2 * w >= len(t) else 0 for t, w, inside, _ in found]
    spans: list[tuple[int, int, int, int]] = []
    start = 0
    while start < len(found):
        region, stop = found[start][2], start
        while stop < len(found) and found[stop][2] == region:
            stop += 1
        surge, own = None, sum(weights[start : min(start + WINDOW, stop)])
        for k in range(start, stop + 1):  # own: the window's sum that starts at k
            if own > 0 and surge is None and k < stop and weights[k]:
                surge = k
            elif own == 0 and surge is not None:
                dive = max(j for j in range(surge, k) if weights[j]) + 1
                if spans and not region and not spans[-1][3] and _joins(found, boxes, spans[-1][1] - 1, surge):
                    surge = spans.pop()[0]
                spans.append((surge, dive, sum(weights[surge:dive]), region))
                surge = None
            if k < stop:
                own += (weights[k + WINDOW] if k + WINDOW < stop else 0) - weights[k]
        start = stop
    return spans


def main_text(page: str | None) -> str:
    found, boxes = lines(page or "")
    spans = stretches(found, boxes)
    heaviest = max((x for x in spans if not x[3]), key=lambda x: (x[2], -x[0]), default=(0, 0, 0, 0))
    marked = [x for x in spans if x[3]]
    if marked and TRUST * sum(x[2] for x in marked) >= heaviest[2]:
        kept = marked
    elif heaviest[2]:
        home = lambda x: boxes.parent[found[x[0]][3]]
        kept = [x for x in spans if not x[3] and home(x) == home(heaviest)]
    else:
        kept = []
    return "\n\n".join(t for first, last, _, _ in kept for t, _, _, _ in found[first:last])


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with their main text and n_chars, its length in code points."""
    low = {text.lower(), "n_chars"}
    pages = pages.select(*(common.quoted(c) for c in pages.columns if c.lower() not in low))
    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in (part for whole in batches for part in packed.sliced(whole, html, SLICE)):
            found = [main_text(x) for x in batch.column(html).to_pylist()]
            columns = [*batch.columns, pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, text, "n_chars"])

    return pages.mapInArrow(run, schema)
