"""Main text of web pages by differencing with the page of the nearest URL.

A page becomes lines of text, one per block, each in a zone: inside the article, inside a part that its tag or class marks
as boilerplate, or neither. Pages of a host are ordered by URL path, and a page is compared with its neighbour in
that order: lines in a longest common subsequence of both are shared. Shared lines and marked lines go; in an
article, paragraphs, headings, lists, quotes and tables stay even if shared, since articles quote each other. Where
a page has an article, lines outside it are not part of it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.batches import slices
from topicloom.scale import checkpoint, drop_step, ordered_index, ship_with_tasks

# Tags without an end tag; tags that end a line; tags whose content is no text; tags of boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
NO_TEXT = frozenset("script style noscript template iframe object svg canvas math head title audio video map".split())
RAW = frozenset("script style noscript template iframe svg textarea title".split())
MARKED = frozenset("nav footer aside form button select textarea dialog menu fieldset label input".split())
ARTICLE = frozenset("article main".split())
OWN_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption".split())
# Words of a class, id or role that mark boilerplate.
MARKS = frozenset(
    "nav navbar navigation menu footer foot header masthead topbar sidebar side aside widget cookie cookies consent gdpr notice banner alert "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies share "
    "sharing social related recommended newsletter subscribe subscription signup login popup modal breadcrumb breadcrumbs pagination "
    "complementary contentinfo search".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_SPACE = re.compile(r"\s+")

PLAIN, INSIDE, OWN, BOILERPLATE = 0, 1, 2, 3  # zones; OWN is a text element inside an article


def _marks(attributes: str) -> bool:
    for _, value in _MARK.findall(attributes):
        if any(word in MARKS for word in re.split(r"[^a-z]+", value.lower())):
            return True
    return bool(_HIDDEN.search(attributes))


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The lines of a page with their zones. Unclosed and stray tags are taken as browsers take them, roughly."""
    page = page or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, no text, marked, in article, in a text element
    now = ("", False, False, False, False)
    held: list[str] = []

    def end_line() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((text, BOILERPLATE if now[2] else PLAIN if not now[3] else OWN if now[4] else INSIDE))

    at, match = 0, _TOKEN.search(page)
    while match:
        if not now[1] and match.start() > at:
            held.append(page[at : match.start()])
        at = match.end()
        closing, tag = match[1], (match[2] or "").lower()
        if tag:
            if tag in BREAKS and not now[1]:
                end_line()
            if closing:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if depth is not None:
                    del stack[depth:]
                    now = stack[-1] if stack else ("", False, False, False, False)
            elif tag not in VOID and not match[3].endswith("/"):
                if tag == "p" and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                    now = stack[-1] if stack else ("", False, False, False, False)
                article = now[3] or tag in ARTICLE
                marked = now[2] or tag in MARKED or (tag == "header" and not article) or (tag not in ("html", "body") and tag not in ARTICLE and bool(match[3]) and _marks(match[3]))
                now = (tag, now[1] or tag in NO_TEXT, marked, article, now[4] or tag in OWN_TEXT)
                stack.append(now)
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    if tag not in NO_TEXT and not now[1]:
                        held.append(page[at : end.start() if end else len(page)])
                        end_line()
                    at = end.end() if end else len(page)
                    stack.pop()
                    now = stack[-1] if stack else ("", False, False, False, False)
        match = _TOKEN.search(page, at)
    if not now[1]:
        held.append(page[at:])
        end_line()
    return out


def common_places(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in memory that grows with the lengths' sum."""
    low, high_a, high_b = 0, len(a), len(b)
    places: list[int] = []
    while low < high_a and low < high_b and a[low] == b[low]:
        places.append(low)
        low += 1
    tail: list[int] = []
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
        tail.append(high_a)
    middle = _split(a[low:high_a], b[low:high_b])
    return places + [low + i for i in middle] + tail[::-1]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _split(a: np.ndarray, b: np.ndarray) -> list[int]:
    keep = np.flatnonzero(np.isin(a, b))
    if len(keep) == 0:
        return []
    if len(keep) < len(a):  # lines that the other page lacks
        return [int(keep[i]) for i in _split(a[keep], b)]
    if len(a) == 1:
        return [0]
    half = len(a) // 2
    cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    return _split(a[:half], b[:cut]) + [half + i for i in _split(a[half:], b[cut:])]


def _hashes(lines: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) for text, _ in lines]


def candidates(lines: list[tuple[str, int]]) -> list[tuple[str, int, bool]]:
    """Lines that can be in the main text: text, place among all lines, and whether they stay even if shared."""
    has_article = any(zone in (INSIDE, OWN) for _, zone in lines)
    return [
        (text, place, zone == OWN)
        for place, (text, zone) in enumerate(lines)
        if zone in (OWN, INSIDE) or (zone == PLAIN and not has_article)
    ]


def main_text(lines: list[tuple[str, int]], neighbour: list[int] | None) -> str:
    """The main text of one page, given the line hashes of its neighbour."""
    shared = set(common_places(np.array(_hashes(lines), np.int64), np.array(neighbour or [], np.int64)))
    return "\n".join(text for text, place, sure in candidates(lines) if sure or place not in shared)


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            made = [_hashes(lines_of(x)) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("host"), part.column("path"), pa.array(made, pa.list_(pa.int64()))],
                names=["key", "host", "path", "lines"],
            )


_CANDIDATES = pa.list_(pa.struct([("text", pa.string()), ("place", pa.int32()), ("sure", pa.bool_())]))


def _candidate_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            made = [[dict(zip(("text", "place", "sure"), c, strict=True)) for c in candidates(lines_of(x))] for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("page_id"), part.column("url"), pa.array(made, _CANDIDATES)],
                names=["key", "page_id", "url", "candidates"],
            )


def _shared_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("lines").to_pylist(), batch.column("neighbour").to_pylist(), strict=True)
        made = [common_places(np.array(a, np.int64), np.array(b or [], np.int64)) for a, b in pairs]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("content"), pa.array(made, pa.list_(pa.int32()))], names=["host", "content", "shared"]
        )


def shared_lines(pages: DataFrame) -> DataFrame:
    """``key, shared``: for each page the places of the lines that it shares with the page before it by path, or else behind it.

    Only hashes of lines are ordered, joined and aligned. Pages with the same lines on a host are one, so that a copy
    is never compared with itself.
    """
    hashed = checkpoint(pages.mapInArrow(_line_hashes, "key long, host string, path string, lines array<long>"))
    content = F.xxhash64("host", "lines")
    one = hashed.groupBy("host", content.alias("content")).agg(F.min_by(F.struct("path", "key", "lines"), F.struct("path", "key")).alias("x"))
    placed = checkpoint(ordered_index(one.select("host", "content", F.col("x.path").alias("path"), F.col("x.lines").alias("lines")), ["host", "path", "content"], "place"))
    other = placed.select(F.col("host").alias("h"), F.col("place").alias("p"), F.col("lines").alias("neighbour"))
    before = placed.join(other, (F.col("place") == F.col("p") + 1) & (F.col("host") == F.col("h")), "left")
    before = before.select("host", "content", "place", "lines", F.col("neighbour").alias("before"))
    first = before.where("before is null").join(other, (F.col("place") == F.col("p") - 1) & (F.col("host") == F.col("h")), "left")
    chosen = before.where("before is not null").select("host", "content", "lines", F.col("before").alias("neighbour"))
    chosen = chosen.unionByName(first.select("host", "content", "lines", "neighbour"))
    aligned = chosen.mapInArrow(_shared_places, "host string, content long, shared array<int>")
    keyed = hashed.select("key", "host", content.alias("content")).distinct()
    found = checkpoint(keyed.join(aligned, ["host", "content"]).select("key", "shared"))
    drop_step(hashed, placed)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; null html is empty, a null url is a host of its own.

    Repeated rows give repeated results; other columns are ignored. Texts are shuffled once.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).select(
        "page_id", "url", "html",
        F.xxhash64("page_id", "url", "html").alias("key"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:www\.)?([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
    )
    found = shared_lines(keyed.select("key", "host", "path", "html"))
    lines = keyed.select("key", "page_id", "url", "html").mapInArrow(
        _candidate_lines, "key long, page_id long, url string, candidates array<struct<text:string,place:int,sure:boolean>>"
    )
    kept = F.filter("candidates", lambda c: c["sure"] | ~F.coalesce(F.array_contains("shared", c["place"]), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda c: c["text"]), "\n")
    # a shuffle at every size: pages are large and their number is not bounded
    joined = lines.hint("merge").join(found, "key", "left").select("page_id", "url", text.alias("text"))
    return joined.withColumn("n_chars", F.length("text").cast("long"))


ship_with_tasks(__name__)
