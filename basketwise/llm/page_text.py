"""Main text of web pages: markup says what it can, the nearest page of the host shows the rest.

A page is read into blocks, each with its text and what the markup says about it: part of the main content, part of
something else (menu, header, footer, notice, advert, form, comments), or nothing. Pages of a host are sorted by path, and each
is paired with the neighbour whose path has the longer beginning in common. Lines of both are aligned by their longest
common subsequence; what they share outside the marked main content belongs to the site, not to the page, and is
deleted.

Only hashes of lines are sorted and paired. They leave the tables of texts where they are, and what comes back is which
lines to delete.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from basketwise.llm.store import kept, range_parts, table
from basketwise.llm.url_filter import url_host, url_path

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td"
    " tfoot th thead title tr ul".split()
)
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video map select datalist".split())
ELSEWHERE = frozenset("nav footer aside form menu dialog button input textarea fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements that an opening tag closes where the end tag was left out.
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
        " hgroup hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Words of class names and ids that mark something beside the content.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adsbygoogle|advert|adverts|advertisement|advertising|adbox|banner|sponsor|sponsored|promo|promotion|cookie|cookies"
    r"|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|nav|navbar|navigation|menu|breadcrumb|breadcrumbs"
    r"|sidebar|side|widget|footer|masthead|site-header|page-header|topbar|toolbar|share|sharing|social|related|recommended|comment|comments"
    r"|disqus|discussion|reply|replies|respond|pagination|pager|skip|copyright|legal)\d*(?:$|[\s_-])",
    re.IGNORECASE,
)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
MAIN_ROLES = frozenset(["main", "article"])
MAIN, OTHER, UNMARKED = 2, 1, 0


class Element(NamedTuple):
    tag: str
    seen: bool
    mark: int


class PageReader(HTMLParser):
    """Blocks of a page as (text, mark). End tags may be missing or come without a start; a cut page is read to its end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.blocks: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.block_mark = UNMARKED

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def mark(self) -> int:
        return self.open[-1].mark if self.open else UNMARKED

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.block_mark))
            self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
            return
        for k in range(len(self.open) - 1, -1, -1):  # an element whose end tag was left out
            inner = self.open[k].tag
            if tag in CLOSED_BY.get(inner, ()):
                self.end_block()
                del self.open[k:]
                break
            if inner in BLOCKS:
                break
        if tag in BLOCKS:
            self.end_block()
        if tag in VOID:
            return
        outer = self.open[-1] if self.open else Element("", True, UNMARKED)
        seen, mark = outer.seen and tag not in UNSEEN, outer.mark
        beside, roles = tag in ELSEWHERE, ()
        if attrs:
            named = {k: v or "" for k, v in attrs}
            if "role" in named:
                roles = set(named["role"].lower().split())
                beside = beside or bool(roles & ROLES)
            if "class" in named or "id" in named:
                beside = beside or bool(NAMES.search(HUMP.sub("-", f"{named.get('class', '')} {named.get('id', '')}")))
            if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or HIDDEN.search(named.get("style", "")):
                seen = False
        if tag == "header" and mark != MAIN:
            beside = True
        if mark == OTHER or (beside and tag not in ("html", "body")):
            mark = OTHER
        elif tag in ("article", "main") or (roles and roles & MAIN_ROLES):
            mark = MAIN
        self.open.append(Element(tag, seen, mark))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                if tag in BLOCKS or any(e.tag in BLOCKS for e in self.open[k + 1 :]):
                    self.end_block()
                del self.open[k:]
                return
            if tag not in BLOCKS and self.open[k].tag in BLOCKS:
                return  # a stray end tag closes nothing beyond its block

    def handle_data(self, data: str) -> None:
        if self.open and not self.open[-1].seen:
            return
        if not self.parts:
            self.block_mark = self.mark()
        elif self.mark() != self.block_mark and data.strip():
            self.end_block()
            self.block_mark = self.mark()
        self.parts.append(data)


def read_blocks(html: str | None) -> list[tuple[str, int]]:
    """The page's blocks in order."""
    reader = PageReader()
    reader.feed(html or "")
    reader.close()
    reader.end_block()
    return reader.blocks


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each page's lines; those of marked main content aren't compared."""
    for batch in batches:
        lines = [
            [xxhash.xxh3_64_intdigest(text.encode()) >> 1 for text, mark in read_blocks(html.as_py()) if mark != MAIN]
            for html in batch.column("html")
        ]
        keys = [batch.column(c) for c in ("page", "host", "path")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(lines, pa.list_(pa.int64()))], ["page", "host", "path", "lines"])


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which places of ``a`` are on a longest common subsequence with ``b``; of equally long ones, the one that matches earliest in ``a``."""
    shared = np.zeros(len(a), dtype=bool)
    at = np.flatnonzero(np.isin(a, b))  # other lines can't be on it
    x, y = a[at], b[np.isin(b, a)]
    n, m = len(x), len(y)
    head = 0
    while head < min(n, m) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and x[n - 1 - tail] == y[m - 1 - tail]:
        tail += 1
    shared[at[:head]] = True
    shared[at[n - tail :]] = True
    x, y, at = x[head : n - tail], y[head : m - tail], at[head : n - tail]
    if len(x) and len(y):
        best = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)  # longest from (i, j) on
        for i in range(len(x) - 1, -1, -1):
            row = np.maximum(best[i + 1, :-1], np.where(y == x[i], best[i + 1, 1:] + 1, 0))
            best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j] and best[i, j] == best[i + 1, j + 1] + 1:
                shared[at[i]] = True
                i, j = i + 1, j + 1
            elif best[i, j] == best[i, j + 1]:
                j += 1
            else:
                i += 1
    return shared


def _same_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, drop): which compared lines the page shares with the nearer of its neighbours, none of which is a copy."""
    for batch in batches:
        rows = {c: batch.column(c) for c in ("page", "path", "lines", "prev_path", "prev_lines", "next_path", "next_lines")}
        pages, drops = [], []
        for i in range(len(batch)):
            path = rows["path"][i].as_py()
            near, most = None, -1
            for side in ("prev", "next"):
                other = rows[f"{side}_path"][i].as_py()
                if other is not None and (same := _same_start(path, other)) > most:
                    near, most = side, same
            if near is None:
                continue
            mine = np.array(rows["lines"][i].as_py(), dtype=np.int64)
            theirs = np.array(rows[f"{near}_lines"][i].as_py(), dtype=np.int64)
            shared = np.flatnonzero(common_lines(mine, theirs))
            if len(shared):
                pages.append(rows["page"][i].as_py())
                drops.append(shared.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(drops, pa.list_(pa.int32()))], ["page", "drop"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """(page, host, path, html) -> (page, drop): numbers, among the lines compared, of those to delete. ``page`` is unique."""
    hashed = pages.mapInArrow(_line_hashes, "page long, host string, path string, lines array<long>")
    order = ["host", "path", "page"]
    sorted_pages = range_parts(hashed, order)
    here = F.struct("host", "path", "lines")
    within = Window.partitionBy("_part").orderBy(*order)
    # the first page of a range meets the last one of the range before, and the other way round
    ends = sorted_pages.groupBy("_part").agg(F.min_by(here, F.struct(*order)).alias("first"), F.max_by(here, F.struct(*order)).alias("last"))
    ranges = Window.orderBy("_part")  # as many rows as ranges
    ends = ends.select("_part", F.lag("last").over(ranges).alias("from_left"), F.lead("first").over(ranges).alias("from_right"))
    beside = sorted_pages.join(F.broadcast(ends), "_part", "left").withColumns(
        {"left": F.coalesce(F.lag(here).over(within), "from_left"), "right": F.coalesce(F.lead(here).over(within), "from_right")}
    )
    # a copy of the page tells nothing about the site: the neighbour is the next page in line with other lines
    differs = lambda side: F.when((F.col(f"{side}.host") != F.col("host")) | (F.col(f"{side}.lines") != F.col("lines")), F.col(side))
    beside = beside.withColumns({"left": differs("left"), "right": differs("right")})
    key = F.struct(*order)
    past = beside.groupBy("_part").agg(
        F.max_by("left", F.when(F.col("left").isNotNull(), key)).alias("left"), F.min_by("right", F.when(F.col("right").isNotNull(), key)).alias("right")
    )
    back, unbounded = Window.orderBy(F.desc("_part")), Window.unboundedPreceding
    past = past.select(
        "_part",
        F.last("left", ignorenulls=True).over(ranges.rowsBetween(unbounded, -1)).alias("before"),
        F.last("right", ignorenulls=True).over(back.rowsBetween(unbounded, -1)).alias("after"),
    )
    backward = Window.partitionBy("_part").orderBy(*[F.desc(c) for c in order])
    beside = beside.join(F.broadcast(past), "_part", "left").withColumns(
        {
            "prev": F.coalesce(F.last("left", ignorenulls=True).over(within.rowsBetween(unbounded, 0)), "before"),
            "next": F.coalesce(F.last("right", ignorenulls=True).over(backward.rowsBetween(unbounded, 0)), "after"),
        }
    )
    beside = beside.select(
        "page",
        "path",
        "lines",
        *[F.when(F.col(f"{s}.host") == F.col("host"), F.col(f"{s}.{c}")).alias(f"{s}_{c}") for s in ("prev", "next") for c in ("path", "lines")],
    )
    return beside.mapInArrow(_differences, "page long, drop array<int>")


def _texts(kind: pa.DataType):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is left of each page."""
        for batch in batches:
            out = []
            for html, drop in zip(batch.column("html"), batch.column("drop").to_pylist()):
                blocks, gone = read_blocks(html.as_py()), set(drop or ())
                compared = -1
                kept_blocks = []
                for text, mark in blocks:
                    compared += mark != MAIN
                    if mark == MAIN or (mark == UNMARKED and compared not in gone):
                        kept_blocks.append(text)
                out.append("\n".join(kept_blocks))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").cast(kind), batch.column("url"), pa.array(out, pa.string())], ["row", "url", "text"]
            )

    return texts


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: (id, url, text, n_chars).

    The text is the marked main content (article, main and their roles), without what is marked as something else within it, and
    the unmarked lines less those shared with the nearest page of the host that has other lines.
    Null and empty pages have an empty text. Pages without host, alone on their host, or whose host has nothing but copies
    lose none by comparison. Repeated rows are rows of their own, equal paths are next to each other in order of a
    hash of the row. White space is what Unicode counts as such. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = pages.select(F.col(id_col).alias("row"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("row", "url", "html"))
    keyed = rows.select("page", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    drops = shared_lines(keyed.filter(F.col("host") != "")).groupBy("page").agg(F.first("drop").alias("drop"))
    kind = rows.schema["row"].dataType
    met = rows.join(kept(drops, "drops"), "page", "left").select("row", "url", "html", "drop")
    texts = met.mapInArrow(_texts(to_arrow_type(kind)), f"row {kind.simpleString()}, url string, text string")
    return texts.select(F.col("row").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op2_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(table(spark, folder, "pages"))
