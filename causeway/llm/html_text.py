"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. Lines of page furniture
(menus, headers, footers, forms, adverts and the like, told by element, role or
class) count as empty, and so do lines made of links. Inside an article paragraphs,
headings and list items are told by element and role alone. Text lengths are summed
over sliding windows of lines; where the sums surge from nothing a region begins,
where they dive to nothing it ends. The text from the first region that reaches
a fixed height to the last one is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import chunks

#: HTML element and class names.
RAW = "script style textarea"
UNSEEN = "noscript template svg math iframe object canvas audio video select datalist"
CHOICES = "select datalist optgroup option"
FURNITURE = f"nav footer aside form menu dialog button fieldset input {CHOICES}"
PROSE = "p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption"
BLOCKS = "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul"
VOID = "area base br col embed hr img input link meta param source track wbr"
CLOSED_BY_NEXT = "p li dt dd td th tr option"
#: Inside an article these are the article's own, whatever they are named.
NAMED_FREELY = f"{PROSE} figure li dt td th"
HEADING_NAMES = "head header masthead"
FURNITURE_ROLES = "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar"
FURNITURE_NAMES = (
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promotions nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail widget "
    "footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register search searchbox form comment comments "
    "commentlist respond reply replies disqus share sharing social follow related recommended recommendations trending popular pager pagination skip toolbar copyright legal disclaimer"
)
_SETS = {k: frozenset(v.split()) for k, v in {"raw": RAW, "unseen": UNSEEN, "choices": CHOICES, "prose": PROSE, "freely": NAMED_FREELY, "headings": HEADING_NAMES, "furniture": FURNITURE, "blocks": BLOCKS, "void": VOID, "next": CLOSED_BY_NEXT, "roles": FURNITURE_ROLES, "names": FURNITURE_NAMES}.items()}

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_RAW = re.compile(r"<(%s)\b" % "|".join(sorted(_SETS["raw"])), re.I)
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in _SETS["raw"]}
_UNSEEN = re.compile(r"<(?:/(?P<end>{0})\s*>|(?P<start>{0})\b)".format("|".join(sorted(_SETS["unseen"]))), re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in _SETS["furniture"] or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) or re.search(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attributes, re.I):
        return True
    for key, *value in _ATTRIBUTE.findall(attributes):
        value = "".join(value)
        if key.lower() == "role" and value.strip().lower() in _SETS["roles"]:
            return True
        if key.lower() in ("class", "id") and not (in_article and name in _SETS["freely"]):
            words = {x.lower() for x in _WORD.findall(value)} & _SETS["names"]
            if words - (_SETS["headings"] if in_article else frozenset()):
                return True
    return False


def without_raw(page: str) -> str:
    """The page with a space for each script and the like; one that is not closed goes on to the page's end. Each sign is passed once."""
    kept, at, last = [], 0, page.rfind(">")
    while (m := _RAW.search(page, at)) and m.start() < last:
        end = _RAW_END[m[1].lower()].search(page, page.find(">", m.end()) + 1)
        kept.append(page[at : m.start()])
        at = end.end() if end else len(page)
    kept.append(page[at:])
    return " ".join(kept)


def without_unseen(page: str) -> str:
    """The page with a space for each element that holds no text of it, from the last of its starts before an end. Each sign is passed once."""
    closes = np.flatnonzero(np.frombuffer(page.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == ord(">"))
    spans, opened, tag_end = [], {}, -1
    for m in _UNSEEN.finditer(page):
        if m["end"]:
            start = opened.pop(m["end"].lower(), None)
            if start is not None:
                spans.append((start, m.end()))
        elif m.start() > tag_end:
            k = int(np.searchsorted(closes, m.end()))
            if k == len(closes):
                break
            tag_end = int(closes[k])
            if page[tag_end - 1] != "/":
                opened[m["start"].lower()] = m.start()
    kept, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            kept.append(page[at:a])
            at = b
    kept.append(page[at:])
    return " ".join(kept)


class Lines:
    """Lines of a page: text, weight (0 for furniture and lines of links), in article or main or not, a paragraph of links or not."""

    def __init__(self, page: str):
        page = without_unseen(without_raw(_COMMENT.sub("", page)))
        self.text: list[str] = []
        self.weight: list[int] = []
        self.core: list[bool] = []
        self.linked: list[bool] = []
        self._buffer: list[str] = []
        self._linked: list[str] = []
        stack: list[tuple[str, bool]] = []
        depth: Counter[str] = Counter()
        blocks: list[str] = []
        furniture = core = links = head = 0
        at = 0

        def push(text: str) -> None:
            self._buffer.append(text)
            if links:
                self._linked.append(text)

        def flush() -> None:
            if self._buffer:
                text, linked = (" ".join(html.unescape("".join(x)).split()) for x in (self._buffer, self._linked))
                if text:
                    unseen, mostly = furniture or head, 2 * len(linked) > len(text)
                    block = blocks[-1] if blocks else ""
                    self.text.append(text)
                    self.weight.append(0 if unseen or mostly else len(text))
                    self.core.append(bool(core) and not furniture)
                    self.linked.append(mostly and not unseen and block in _SETS["prose"])
            self._buffer, self._linked = [], []

        def pop() -> None:
            nonlocal furniture, core
            name, bad = stack.pop()
            depth[name] -= 1
            if name in _SETS["blocks"]:
                blocks.pop()
            furniture -= bad
            core -= name in ("article", "main")

        # After the last ">" there is no tag, and every start before it has an end: no start is scanned in vain.
        for m in _TAG.finditer(page, 0, page.rfind(">") + 1):
            if m.start() > at:
                push(page[at : m.start()])
            at = m.end()
            end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            name = name.lower()
            if name == "a":
                links = 0 if end else 1
                continue
            if name in _SETS["blocks"]:
                flush()
                links = 0
            if name in ("head", "title"):
                head = 0 if end else 1
            elif name in ("body", "article", "main"):
                head = 0
            if name in _SETS["void"] or (attributes or "").endswith("/"):
                continue
            if end:
                if depth[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if name in ("article", "main"):  # an open menu or header above it was left unclosed
                while any(depth[x] for x in ("nav", "header", "aside", "menu", "form", "ul", "ol", "li")):
                    pop()
            if name in _SETS["blocks"] and name not in _SETS["choices"]:
                while stack and stack[-1][0] in _SETS["choices"]:
                    pop()
            if name in _SETS["next"] and stack and stack[-1][0] == name:
                pop()
            if name in _SETS["blocks"] or name in _SETS["furniture"] or attributes:
                bad = _is_furniture(name, attributes or "", core > 0)
                stack.append((name, bad))
                depth[name] += 1
                if name in _SETS["blocks"]:
                    blocks.append(name)
                furniture += bad
                core += name in ("article", "main")
        if at < len(page):
            push(page[at:].split("<")[0] if re.match(r"<[a-zA-Z/]", page[at:]) else page[at:])
        flush()


def main_text(page: str | None, span: int = 3, surge: int = 60) -> str:
    """The text between the first surge and the last dive point of the page's line-block distribution.

    span: lines a window; surge: the characters a window must reach for a region to
    surge, whatever the others hold. Lines of article and main count as surging and
    are judged in one distribution with all others. Between the first region that
    surges and the last one all lines with weight are kept, and paragraphs that are
    links for the most part; on a page where nothing surges there is nothing to
    compare, and all are kept.
    """
    lines = Lines(page or "")
    weight = np.array(lines.weight, dtype=np.int64)
    core = np.array(lines.core, dtype=bool)
    if not weight[core].any():  # links alone are no article
        core[:] = False
    keep = between(weight, core, np.array(lines.linked, dtype=bool), span, surge)
    return " ".join(t for t, k in zip(lines.text, keep, strict=True) if k)


def between(weight: np.ndarray, core: np.ndarray, linked: np.ndarray, span: int, surge: int) -> np.ndarray:
    """Lines with weight, or linked, from the first to the last region that surges; core lines weigh one at least."""
    n = len(weight)
    keep = np.zeros(n, dtype=bool)
    if not weight.any():
        return keep
    weight = np.where(core, np.maximum(weight, 1), weight)
    sums = np.convolve(weight, np.ones(span, dtype=np.int64))[span - 1 :]  # of the lines i .. i+span-1
    rising = np.flatnonzero((sums > 0) & np.concatenate([[True], sums[:-1] == 0]))
    diving = np.flatnonzero((sums > 0) & np.concatenate([sums[1:] == 0, [True]]))
    regions = [(a, min(n, b + span), int(sums[a : b + 1].max())) for a, b in zip(rising, diving, strict=True)]
    surging = [(a, b) for a, b, high in regions if high >= surge or core[a:b].any()]
    first, last = (surging[0][0], surging[-1][1]) if surging else (0, n)
    keep[first:last] = True
    return keep & ((weight > 0) | linked)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with a column text_col, the main text of its html, in place of html_col.

    All other columns pass through (one named text_col is replaced). A null or
    empty page, and a page of furniture alone, has an empty text. Elements that hold
    no text of the page (svg, select, object and the like) are left out with what they
    hold; one that is never closed, or closes itself, hides nothing. Very long pages
    are read whole; rows given twice are given back twice, and an empty table gives
    an empty one.
    """
    others = [c for c in pages.columns if c not in (html_col, text_col)]
    rows = pages.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias(text_col))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            texts = [main_text(x) for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], schema=batch.schema)

    return rows.mapInArrow(extract, rows.schema)
