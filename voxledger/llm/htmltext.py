"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass decides from
where a block stands (menu, advert, comment ...), its length, the share of its
text inside links and the share of stop words.  What is too short or too plain
to tell stays open, and the second pass gives it the label of the nearest
decided blocks on either side: good if both, or the only one, are good, else
that of the nearer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.quality import STOP_WORDS
from voxledger.llm.work import small_batches

#: Share of a block's characters in links from which it is a list of links.
LINK_DENSITY = 0.5
#: Characters below which a block is too short to tell.
SHORT = 70
#: Share of stop words in prose; below LOW a block outside an article is not prose.
PROSE, LOW = 0.30, 0.10

#: Elements that hold no main text, and those that only hold it.
_DROPPED = frozenset(
    "head title nav footer aside form button select option textarea input label fieldset noscript template iframe object svg "
    "math canvas audio video dialog menu map".split()
)
_MAIN = frozenset(("article", "main"))
_BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre hr header footer nav aside form figure figcaption address details summary center hgroup".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class, id and role that name what is not main text.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion sidebar sidebars "
    "widget widgets menu menus nav navbar navigation navi breadcrumb breadcrumbs footer foot masthead topbar toolbar comment "
    "comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "outbrain taboola pagination pager copyright legal disclaimer skip complementary contentinfo dialog".split()
)
#: Of these, the names below which an article is none, but in a wrapper.
_FIRM = frozenset(
    "menu menus nav navbar navigation navi breadcrumb breadcrumbs footer foot contentinfo complementary cookie cookies consent gdpr "
    "dialog popup modal".split()
)
#: Of these, the names of what readers wrote, where an article is a comment.
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Whole class names of what is not shown; as a part of a name (overflow-hidden) the word says nothing.
_UNSEEN = frozenset("hidden is-hidden u-hidden visually-hidden visuallyhidden".split())
#: Names that tell what the page has or lacks, or the state of an element, not what it is.
_ABOUT = re.compile(r"(?:^|[-_])(?:has|no|with|without)[-_]|[-_](?:open|opened|closed|enabled|disabled|allowed|active|inactive|lazy|free)$")
#: Share of the text of a page from which an element is a wrapper, whatever its name.
MOST = 0.5
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_NAME = re.compile(r"[^a-z0-9]+")
_STOP = frozenset(STOP_WORDS)
_EDGE = ".,;:!?()[]\"'«»„“”#*$%&|<>"


@dataclass
class Block:
    text: str
    in_links: int
    place: str  # "main", "dropped" or "page"


#: Where content stands: the place, and the hinted elements around it, outside and inside of the innermost article.
#: A hinted element is its number and how firmly its name tells: 0 a hint, 1 a firm part of a name, 2 a firm name.
_Marks = tuple[tuple[int, int], ...]
_Where = tuple[str, _Marks, _Marks]


def _attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def _place(tag: str, attributes: str, outer: _Where, number: int) -> _Where:
    """Where the content of an element stands; number is that of the element."""
    place, outside, inside = outer
    if place == "dropped" or tag in _DROPPED or (tag == "header" and place != "main"):
        return "dropped", (), ()
    hinted: _Marks = ()
    if attributes and tag not in ("html", "body"):
        given = _attributes(attributes)
        if "hidden" in given or _NOT_SHOWN.search(given.get("style", "")):
            return "dropped", (), ()
        whole = {n for a in ("class", "id", "role") for n in given.get(a, "").lower().split() if not _ABOUT.search(n)}
        names = {n for w in whole for n in _NAME.split(w)}
        if given.get("role", "").lower().strip() == "main":
            return "main", outside + inside, ()
        if not _UNSEEN.isdisjoint(whole) or not _COMMENTS.isdisjoint(names):
            return "dropped", (), ()
        if not _FIRM.isdisjoint(names):
            hinted = ((number, 1 if _FIRM.isdisjoint(whole) else 2),)
        elif not _HINTS.isdisjoint(names):
            hinted = ((number, 0),)
    if tag in _MAIN:
        return "main", outside + inside + hinted, ()
    return place, outside, inside + hinted


def _settled(found: list[tuple[str, int, _Where]]) -> list[Block]:
    """Blocks with their places: hinted elements are dropped unless they hold most of the text or the only article.

    Elements of firm names are dropped with any article in them unless they hold most of the text and an article
    besides; a name of which only a part is firm may do without one where the page has none.
    """
    held: dict[int, int] = {}
    firm: dict[int, int] = {}
    around: set[int] = set()
    for text, _, (_, outside, inside) in found:
        for number, degree in {*outside, *inside}:
            held[number] = held.get(number, 0) + len(text)
            if degree:
                firm[number] = degree
        around.update(number for number, _ in outside)
    total = sum(len(text) for text, _, where in found if where[0] != "dropped")
    has_main = any(where[0] == "main" for _, _, where in found)
    gone = {n for n, d in firm.items() if held[n] <= MOST * total or not (n in around or d == 1 and not has_main)}
    left = [(t, k, ("dropped", (), ()) if any(n in gone for n, _ in w[1] + w[2]) else w) for t, k, w in found]
    total = sum(len(text) for text, _, where in left if where[0] != "dropped")
    bad = {n for n, size in held.items() if n not in firm and size <= MOST * total}

    def free(marks: _Marks) -> bool:
        return all(n not in bad for n, _ in marks)

    clear = any(p == "main" and free(o + i) for _, _, (p, o, i) in left)
    return [
        Block(text, links, place if free(inside) and (free(outside) or not clear) else "dropped")
        for text, links, (place, outside, inside) in left
    ]


def blocks(html: str) -> list[Block]:
    out: list[tuple[str, int, _Where]] = []
    parts: list[str] = []
    links = in_link = 0
    open_: list[tuple[str, _Where]] = []
    page: _Where = ("page", (), ())
    place = page

    def flush() -> None:
        nonlocal links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append((text, links, place))
        parts.clear()
        links = 0

    for m in _TOKEN.finditer(html):
        if m[8] is not None:
            parts.append(m[8])
            if in_link:
                links += len("".join(m[8].split()))
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in _VOID:
            if tag in _BLOCK:
                flush()
            continue
        if closing:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if tag in _BLOCK or at is not None and open_[at][1] != place:
                flush()
            if at is not None and (tag in _BLOCK or tag in _DROPPED):
                del open_[at:]
                place = open_[-1][1] if open_ else page
            continue
        if tag == "body":
            flush()
            open_.clear()
            place = page
        here = _place(tag, attributes, place, m.start())
        if tag in _BLOCK or here != place:
            flush()
        if tag in _BLOCK or tag in _DROPPED or here != place:
            if attributes.rstrip().endswith("/") and tag not in _BLOCK:
                continue
            open_.append((tag, here))
            place = here
    flush()
    return _settled(out)


def _first_pass(b: Block, has_main: bool, known: bool = True) -> bool | None:
    """Good, bad, or open; where the language is not known, stop words do not tell, and long text is good."""
    if b.place == "dropped" or (has_main and b.place != "main"):
        return False
    if b.in_links >= LINK_DENSITY * len(b.text.replace(" ", "")):
        return False if b.in_links else None
    words = b.text.split()
    stops = sum(w.strip(_EDGE).lower() in _STOP for w in words) / max(1, len(words))
    if len(b.text) >= SHORT:
        if stops >= PROSE or not known:
            return True
        if stops < LOW and b.place != "main":
            return False
    return None


def _second_pass(labels: list[bool | None], edge: list[bool]) -> list[bool]:
    """Open blocks get the label of the nearest decided ones; edge is the label beyond the ends of a run."""
    n = len(labels)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for near, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = None
        for i in order:
            near[i] = last
            if labels[i] is not None:
                last = (i, labels[i])
    out = []
    for i, label in enumerate(labels):
        if label is None:
            a, b = before[i], after[i]
            if a is None and b is None:
                label = edge[i]
            elif a is None or b is None:
                label = (a or b)[1]
            else:
                label = a[1] if a[1] == b[1] or i - a[0] <= b[0] - i else b[1]
        out.append(label)
    return out


def main_text(html: str | None) -> str:
    """Text of the good blocks in page order, joined by one space; empty for null."""
    found = blocks(html or "")
    has_main = any(b.place == "main" for b in found)
    if has_main:  # what stands in the article is judged among itself, and is good where nothing decides
        found = [b for b in found if b.place == "main"]
    first = [_first_pass(b, has_main) for b in found]
    if not has_main and True not in first:
        first = [_first_pass(b, has_main, known=False) for b in found]
    labels = _second_pass(first, [b.place == "main" for b in found])
    return " ".join(b.text for b, good in zip(found, labels, strict=True) if good)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text in place of the html column: its main text, empty if there is none.

    Null and empty pages give an empty text.  A column of pages named text is
    replaced; all others stay.
    """
    small_batches(pages.sparkSession, 500)
    keep = [c for c in pages.columns if c not in (html, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(h) for h in b.column("_html").to_pylist()], pa.string())
            yield pa.record_batch([*[b.column(c) for c in keep], text], [*keep, "text"])

    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html).alias("_html"))
    schema = rows.drop("_html").schema.add("text", "string")
    return rows.mapInArrow(run, schema)
