"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each with the path of block tags from the
root to it. Per path the text length and the punctuation of its blocks are
summed and divided by their number; both ratios are smoothed over paths in page
order, scaled to the page's largest and fused. What a page's own markup says
counts too: a path inside article or main gets a bounded bonus on its ratio,
paths through navigation, headers, footers, sidebars, notices, adverts, forms
and comments get none at all. Marks by element or hiding hold for all within.
Marks by words of class, id or role can be wrong about a wrapper: article, main
and long blocks within lift them, under words for other texts than the page's
own (comments, adverts, notices) only if no other path is left. Paths at or
above the threshold, which is one for all, are content; their blocks are kept
whole and in order.

Defined results: null or empty html, and pages without content, give an empty
string of length 0; a null id or url stays null; repeated rows give repeated
results; an empty table gives an empty one; further columns, whatever their
names, are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelog.llm.textbuf import tidy

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+|[^>]*)>""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?、。，]")
BLOCKS = frozenset("html head body title address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option select caption".split())
RAW = frozenset("script style textarea template noscript iframe svg math object xmp noembed noframes".split())
#: Elements that never hold main text.
BOILERPLATE = frozenset("head title nav footer aside form menu dialog button select option label input fieldset search".split())
#: Words in class, id or role that mark boilerplate.
MARKED = frozenset("ad ads advert adverts advertisement adsense banner sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent notice notices alert popup modal overlay comment comments commentlist disqus replies share sharing social related recommended promo promoted sponsor sponsored newsletter subscribe subscription signup login search pagination pager widget toolbar copyright complementary contentinfo".split())
#: Those of them that mean other texts than the page's own, however long.
OTHERS = frozenset("ad ads advert adverts advertisement adsense cookie cookies consent notice notices alert popup comment comments commentlist disqus replies related recommended promo promoted sponsor sponsored newsletter subscribe subscription signup login".split())
#: Parts that a marked word may have beside it in one name: site-footer, left-sidebar, comment-list.
BESIDE = frozenset("site page top left right bottom primary secondary global list item slot box bar block links text".split())
#: Characters of a block that is long enough to lift a mark.
LONG = 200
#: Marks of a block: none; by a word, lifted by article, main or length; by a word for other texts; by element or hiding.
NONE, WORD, OTHER, FIRM = range(4)
#: What a path inside article or main gets on top of its ratio, which is below 1; less than the threshold, so that markup alone decides nothing.
BONUS = 0.25
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _marked(attributes: str) -> int:
    """The mark that attributes give: a name counts if it is a marked word, or made of such and of parts that may stand beside it."""
    if ("hidden" in attributes or "none" in attributes) and _HIDDEN.search(attributes):
        return FIRM
    mark = NONE
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [w for w in re.split(r"[^a-z]+", name) if w]
            if "".join(parts) in MARKED:
                parts = ["".join(parts)]
            words = [w for w in parts if w in MARKED]
            if words and all(w in MARKED or w in BESIDE for w in parts):
                mark = max(mark, WORD if OTHERS.isdisjoint(words) else OTHER)
    return mark


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}", re.IGNORECASE | re.ASCII)


def blocks(page: str) -> list[tuple[int, str, bool, int]]:
    """(tag path as a number, text, inside article or main, mark) of every block with text, in page order; OTHER is left only where nothing lifts it or other text is there."""
    stack: list[tuple[str, bool, int, bool, int]] = []  # tag, article or main so far, mark so far, article or main within the mark, path
    paths: dict[tuple[int, str], int] = {}  # a path is the one above it and a tag
    open_: Counter = Counter()
    parts: list[str] = []
    out: list[tuple[int, str, bool, int]] = []
    spare: list[int] = []  # blocks to lift if no other is left

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", references.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                inside, mark, lifts, path = stack[-1][1:] if stack else (False, NONE, False, 0)
                if mark in (WORD, OTHER) and (lifts or len(text) >= LONG):
                    if mark == OTHER:
                        spare.append(len(out))
                    else:
                        mark = NONE
                out.append((path, text, inside, mark))

    def pop() -> None:
        open_[stack.pop()[0]] -= 1

    def close(tag: str, within: tuple[str, ...] = ()) -> None:
        """End the innermost `tag`, unless one of `within` is opened in it."""
        if not open_[tag]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in within:
                return
            if stack[k][0] == tag:
                flush()
                while len(stack) > k:
                    pop()
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = _raw_end(tag).search(page, at)
                stop = page.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else size
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if m[1]:
            close(tag)
            continue
        if stack and stack[-1][0] == "p":
            pop()  # a block ends an open paragraph
        for other in _CLOSES.get(tag, ()):
            close(other, ("ul", "ol", "dl", "table", "select", "menu"))
        inside, mark, lifts, path = stack[-1][1:] if stack else (False, NONE, False, 0)
        if tag in BOILERPLATE or tag == "header" and not inside:
            own = FIRM
        else:
            own = _marked(m[3]) if tag not in ("html", "body", "article", "main") else NONE
        if tag in ("article", "main"):
            lifts = mark in (WORD, OTHER)
        elif own:
            lifts = False
        if own and mark == WORD and stack[-1][3]:
            mark = NONE  # lifted already; only the new mark holds
        stack.append((tag, inside or tag in ("article", "main"), max(mark, own), lifts, paths.setdefault((path, tag), len(paths) + 1)))
        open_[tag] += 1
        if m[3].endswith("/"):
            pop()
    flush()
    if all(b[3] for b in out):
        for k in spare:
            out[k] = (*out[k][:3], NONE)
    return out


def main_text(page: str | None, threshold: float = 0.35) -> str:
    """The blocks of content paths, joined by two line feeds."""
    found = blocks(page) if page else []
    paths: dict[tuple[int, bool, int], list[str]] = defaultdict(list)
    for path, text, inside, mark in found:
        paths[path, inside, mark].append(text)
    live = [p for p in paths if not p[2]]
    if not live:
        return ""
    length = [sum(map(len, paths[p])) / len(paths[p]) for p in live]
    marks = [sum(len(_PUNCTUATION.findall(t)) for t in paths[p]) / len(paths[p]) for p in live]
    kept = set()
    for k, score in enumerate(_fused(length, marks)):
        if score + BONUS * live[k][1] >= threshold:
            kept.add(live[k])
    return "\n\n".join(text for path, text, inside, mark in found if (path, inside, mark) in kept)


def _smooth(v: list[float]) -> list[float]:
    """Each path keeps half of its ratio and takes a quarter of either neighbour's."""
    return [(v[max(k - 1, 0)] + 2 * x + v[min(k + 1, len(v) - 1)]) / 4 for k, x in enumerate(v)]


def _fused(length: list[float], marks: list[float]) -> list[float]:
    """Both ratios smoothed, by the page's largest of each, in the middle; below 1."""
    a, b = _smooth(length), _smooth(marks)
    most, dots = max(a), max(b)
    return [(x / most + (y / dots if dots else x / most)) / 2 * 0.999 for x, y in zip(a, b)]


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars (code points of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    out = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")).mapInArrow(tidy(run), f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_column, "url": url_column})
