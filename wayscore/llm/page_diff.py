"""Main text of web pages by structure and by differencing with the nearest page of the same host.

Pages are range-partitioned and sorted by host and URL path, so that each task walks along the paths of a host, however
many pages it has, and meets neighbours one after the other. A page is cut into lines (its blocks of text). Of the page
before and the page after it in its partition, the one of the same host whose path shares more leading parts is its
partner. The longest common subsequence of the two pages' lines is what the site's template puts on both; those lines
are deleted.

Differencing alone can't give right results in two cases, where structure decides: menus and adverts that differ from
page to page are no shared lines, so blocks inside elements that declare themselves as such are deleted too; and lines
of an article that two pages carry (mirrors, quoted passages) are shared but are not template, so the blocks of a declared
article stay. Where no element declares the article, a partner that shares over half of the text left is a mirror, and
its lines stay as well.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import parts_for, shuffle_partitions

#: HTML's own vocabulary (fixed values): elements without content, with raw content, that part blocks, and that are no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
CLOSE_P = BLOCKS - {"html", "body"}
ASIDE = frozenset("nav footer aside form button select option datalist dialog menu head label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
#: Words of class and id names that declare a block as something else than the article.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets "
    "footer masthead cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login search share sharing social related "
    "recommended recommendations comment comments commentlist respond reply replies disqus discussion pagination pager toolbar copyright disclaimer".split()
)
HEADS = frozenset("header site topbar".split())
MAINS = frozenset("article post entry story content main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: What a line is: outside of the article, in a declared article, or undeclared.
DROPPED, ARTICLE, OPEN = range(3)


class Page(NamedTuple):
    place: tuple[str, tuple[str, ...]]
    lines: list[str]
    kinds: list[int]


def _marks(attributes: str) -> tuple[set[str], dict[str, str]]:
    if not attributes.strip():
        return set(), {}
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    words = {w.lower() for k in ("class", "id") for w in _PARTS.findall(found.get(k, ""))}
    return words, found


def _role(tag: str, attributes: str, in_article: bool) -> str:
    """What an element says it is: 'drop', 'article' (article proper), 'main' (a place for one), or ''."""
    words, found = _marks(attributes)
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    if tag in ASIDE or role in ROLES or words & MARKS or hidden:
        return "drop" if tag not in ("html", "body") else ""
    if tag == "header" and not in_article or words & HEADS and not in_article and not words & MAINS and tag not in ("html", "body", "main", "article"):
        return "drop"
    if tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody":
        return "article"
    if tag == "main" or role == "main" or tag in ("div", "section") and words & MAINS:
        return "main"
    return ""


def read_page(source: str) -> tuple[list[str], list[int]]:
    """The lines of a page and what each is. Unknown and unclosed markup never fails: an end tag closes what is open inside
    its element, a stray one is passed over."""
    lines: list[str] = []
    states: list[tuple[bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]  # element, dropped, in article, in main
    text: list[str] = []

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append(line)
                states.append(stack[-1][1:])

    def close(upto: int) -> None:
        while len(stack) > upto:
            if stack[-1][0] in BLOCKS or stack[-1][1] != stack[-2][1]:
                flush()
            stack.pop()

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text.append(source[at:])
            break
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in RAW or tag in VOID:
                if tag == "br":
                    text.append(" ")
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                close(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag in CLOSE_P or tag in ("td", "th"):
            same = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd", ("dl",)), "dt": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",))}.get(tag)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" and tag in CLOSE_P or same and stack[i][0] == same[0]:
                    close(i)
                    break
                if stack[i][0] in (same[1] if same else BLOCKS) or stack[i][0] in ("td", "th", "table", "button"):
                    break
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        _, dropped, article, main = stack[-1]
        role = "drop" if dropped else _role(tag, m[3], article)
        if role == "drop" and not dropped:
            flush()
        stack.append((tag, dropped or role == "drop", article or role == "article", main or role == "main"))
    close(1)
    flush()
    kept = [s for s in states if not s[0]]
    level = 1 if any(s[1] for s in kept) else 2 if any(s[2] for s in kept) else 0
    kinds = [DROPPED if s[0] else OPEN if not level else ARTICLE if s[level] else DROPPED for s in states]
    return lines, kinds


def place_of(url: str | None) -> tuple[str, tuple[str, ...]]:
    """Host and path parts of a URL."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), tuple(p for p in parts.path.split("/") if p)
    except ValueError:
        return "", ()


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of two lists, by bit-parallel dynamic programming."""
    n, masks = len(a), {}
    for i, line in enumerate(a):
        masks[line] = masks.get(line, 0) | 1 << i
    full, row, rows = (1 << n) - 1, (1 << n) - 1, []
    for line in b:
        rows.append(row)
        hit = row & masks.get(line, 0)
        row = (row + hit | row & ~hit) & full
    rows.append(row)
    out, i, j = set(), n - 1, len(b)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:  # the length doesn't grow with line i
            i -= 1
        elif rows[j - 1] >> i & 1:
            # line i first counts with line j of b
            out.add(i)
            i, j = i - 1, j - 1
        else:
            j -= 1
    return out


def _nearness(a: Page, b: Page | None) -> int:
    if b is None or not a.place[0] or a.place[0] != b.place[0]:
        return -1
    n = 0
    for x, y in zip(a.place[1], b.place[1], strict=False):
        if x != y:
            break
        n += 1
    return n


def main_text(page: Page, before: Page | None, after: Page | None) -> str:
    """The lines that neither structure nor the partner's shared lines delete, joined by empty lines."""
    partner = before if _nearness(page, before) >= _nearness(page, after) else after
    keep = [k != DROPPED for k in page.kinds]
    if _nearness(page, partner) >= 0:
        shared = [i for i in shared_lines(page.lines, partner.lines) if page.kinds[i] == OPEN]
        total = sum(len(x) for x, k in zip(page.lines, page.kinds, strict=True) if k == OPEN)
        if 2 * sum(len(page.lines[i]) for i in shared) <= total:
            for i in shared:
                keep[i] = False
    return "\n\n".join(x for x, k in zip(page.lines, keep, strict=True) if k)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for page_id, url, source in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                yield page_id, url, Page(place_of(url), *read_page(source.as_py() or ""))

    def made() -> pa.RecordBatch:
        ids, urls, texts = zip(*out, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        out.clear()
        return batch

    before, here = None, None
    for row in _then_none(rows()):
        if here is not None:
            out.append((here[0], here[1], main_text(here[2], before, row[2] if row else None)))
            before = here[2]
            if len(out) == 500:
                yield made()
        here = row
    if out:
        yield made()


def _then_none(rows: Iterator) -> Iterator:
    yield from rows
    yield None


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (blocks joined by two newlines), n_chars (code points).

    Null and empty pages have an empty text; pages without a readable host have no partner; repeated rows give a row each,
    each other's mirrors; an empty table gives no rows; further columns are dropped.
    """
    spark = pages.sparkSession
    n = parts_for(pages, "html", 16, shuffle_partitions(spark))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    bare = F.regexp_replace("url", r"^\w+://", "")
    rows = rows.withColumn("_host", F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0))).withColumn("_path", F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1))
    walked = rows.repartitionByRange(n, "_host", "_path", "page_id").sortWithinPartitions("_host", "_path", "page_id", "html")
    return walked.drop("_host", "_path").mapInArrow(_walk, "page_id long, url string, text string, n_chars long")
