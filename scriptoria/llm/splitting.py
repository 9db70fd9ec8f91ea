"""Problem 5: split oversized items at natural boundaries into balanced pieces.

The least number of pieces is computed from the limit and the overlap, equal-length targets are placed
and each is snapped to the strongest boundary nearby. If a limit fails, or a cut finds no boundary,
further pieces are added.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from scriptoria.runtime import table, widen

#: Pieces tried beyond the least number before cuts are placed one after the other.
EXTRA = 3
#: Most kinds of items in one table of limits.
MAX_KINDS = 1000

# Boundaries of prose, strongest first; a cut lies at the end of the match.
_PROSE = [
    (8, re.compile(r"\n[ \t\r]*\n(?=[ \t]*(?:#{1,6}\s|<h[1-6]|```|~~~))")),
    (7, re.compile(r"(?:\r?\n[ \t]*){2,}(?=\S)")),
    (6, re.compile(r"\r?\n(?=[ \t]*(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|<(?:h[1-6]|p|div|li|tr|section|article|ul|ol|table|head|body|script|style|meta|link|title)\b|```|~~~))|</(?:p|div|li|tr|h[1-6]|section|article|ul|ol|table|head|title|script|style)>\s*(?!\s)")),
    (5, re.compile(r"[.!?…][\"'”’»)\]]*\s+(?=[^\sa-z])|[。！？｡][」』”’）】]*\s*(?!\s)|[।॥؟۔]\s*(?!\s)|\r?\n(?!\s*\n)")),
    (4, re.compile(r"[;:]\s+(?!\s)|[；：]|/?>(?=<)|(?<=[฀-๿]) +(?=[฀-๿])")),
    (3, re.compile(r",\s+(?!\s)|[、，،]\s*(?!\s)|[|}\])]\s+(?!\s)")),
    (2, re.compile(r"\s+(?!\s)")),
    (1, re.compile(r"[-_/,;.:&?=+|](?=\w)")),
]
# Boundaries of source code.
_CODE = [
    (8, re.compile(r"\n[ \t\r]*\n(?=[^\s})\]])")),
    (7, re.compile(r"\n[ \t\r]*\n(?=[ \t])")),
    (6, re.compile(r"\n(?=(?:def|class|async|function|public|private|protected|static|export|template|namespace|@)\b)|\n(?=[^\s})\]])")),
    (5, re.compile(r"(?<=[};>])[ \t\r]*\n")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[;}](?=\S)|(?<=[;{}])[ \t]+(?=\S)|\},(?=\S)")),
    (2, re.compile(r"[ \t\r]+(?=\S)|,(?=\S)")),
    (1, re.compile(r"(?<=[\])])(?=\S)|[(\[{](?=\S)")),
]


def boundaries(text: str, code: bool) -> tuple[list[int], list[int]]:
    """Positions of natural boundaries in ascending order, and their strengths."""
    found: dict[int, int] = {}
    for strength, pattern in _CODE if code else _PROSE:
        for m in pattern.finditer(text):
            found.setdefault(m.end(), strength)
    if not code:
        _weaken_fences(text, found)
    for at in (0, len(text)):
        found.pop(at, None)
    places = sorted(p for p in found if not _joined(text, p))
    return places, [found[p] for p in places]


def _weaken_fences(text: str, found: dict[int, int]) -> None:
    """Boundaries within a fenced block count as line ends at most."""
    spans, start, mark = [], -1, ""
    for m in re.finditer(r"(?m)^[ \t]*(```|~~~)[^\n]*$", text):
        if start < 0:
            start, mark = m.end(), m[1]
        elif m[1] == mark:
            spans.append((start, m.start()))
            start = -1
    if not spans:
        return
    starts = [a for a, _ in spans]
    for p, s in list(found.items()):
        i = bisect_right(starts, p) - 1
        if i >= 0 and p <= spans[i][1]:
            found[p] = min(s, 4)


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part characters that belong together."""
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    return (a == "\r" and b == "\n") or b in "‍️︎‌" or a == "‍" or (b > "̀" and unicodedata.category(b)[0] == "M") or "\U0001f3fb" <= b <= "\U0001f3ff"


def _safe(text: str, at: int, low: int, high: int) -> int | None:
    """The position in low..high nearest before ``at``, else after it, that parts no characters."""
    return next((p for p in (*range(at, low - 1, -1), *range(at + 1, high + 1)) if not _joined(text, p)), None)


def split(text: str, limit: int, overlap: int = 0, code: bool = False) -> list[tuple[int, int, int]]:
    """Pieces ``(start, cut, end)``: text[start:end] is the piece, text[cut:end] its part beyond the overlap.

    No piece is longer than ``limit``; start >= cut - overlap; the parts beyond the overlaps give back ``text``. An
    overlap of half the limit or more is cut down to below it. A text within the limit is one piece.
    """
    size = len(text)
    if size <= limit:
        return [(0, 0, size)]
    overlap = max(0, min(overlap, (limit - 1) // 2))
    stride = limit - overlap
    places, strengths = boundaries(text, code)
    least = max(2, ceil((size - overlap) / stride))
    best = None
    for n in range(least, least + EXTRA + 1):
        cuts, blind = _place(text, size, n, limit, stride, places, strengths)
        if cuts is not None and (best is None or blind < best[1]):
            best = cuts, blind
        if best is not None and best[1] == 0:
            break
    if best is None or best[1]:
        free = _place_freely(text, size, limit, stride, places, strengths)
        if best is None or free[1] < best[1]:
            best = free
    cuts = best[0]
    pieces, start = [], 0
    for i, end in enumerate([*cuts, size]):
        cut = cuts[i - 1] if i else 0
        if i:
            start = _overlap_start(text, cut, overlap, places, strengths)
        pieces.append((start, cut, end))
    return pieces


def _place(text: str, size: int, n: int, limit: int, stride: int, places: list[int], strengths: list[int]) -> tuple[list[int] | None, int]:
    """Cuts of ``n`` pieces, or None if a limit fails, and how many of them lie at no boundary."""
    cuts, blind, last = [], 0, 0
    for i in range(1, n):
        target = round(size * i / n)
        high = min(last + (limit if i == 1 else stride), size - 1)
        low = max(last + 1, size - (n - i) * stride)
        if low > high:
            return None, 0
        a, b = bisect_left(places, low), bisect_right(places, high)
        reach = max(1, size / n)
        at = max(range(a, b), key=lambda k: (strengths[k] - 6.0 * abs(places[k] - target) / reach, -places[k]), default=None)
        if at is None:
            blind += 1
            last = _safe(text, min(max(target, low), high), low, high)
            if last is None:
                return None, 0
        else:
            last = places[at]
        cuts.append(last)
    return (cuts, blind) if size - last <= stride else (None, 0)


def _place_freely(text: str, size: int, limit: int, stride: int, places: list[int], strengths: list[int]) -> tuple[list[int], int]:
    """Cuts of as many pieces as boundaries ask for: each target balances what is left, and any boundary within reach will do."""
    cuts, blind, last = [], 0, 0
    while size - last > (limit if not cuts else stride):
        reach = limit if not cuts else stride
        target = last + (size - last) / ceil((size - last) / reach)
        a, b = bisect_right(places, last), bisect_right(places, last + reach)
        near = bisect_right(places, last + reach // 3)
        at = max(range(near if near < b else a, b), key=lambda k: (strengths[k] - 6.0 * abs(places[k] - target) / reach, -places[k]), default=None)
        blind += at is None
        # a run of marks longer than a piece has to be parted somewhere
        last = (_safe(text, last + reach, last + 1, last + reach) or last + reach) if at is None else places[at]
        cuts.append(last)
    return cuts, blind


def _overlap_start(text: str, cut: int, overlap: int, places: list[int], strengths: list[int]) -> int:
    """Where a piece begins before its cut: at the strongest boundary within reach, else as early as allowed."""
    if not overlap:
        return cut
    low = cut - overlap
    a, b = bisect_left(places, low), bisect_left(places, cut)
    if a < b:
        return places[max(range(a, b), key=lambda k: (strengths[k], -places[k]))]
    p = low
    while p < cut and _joined(text, p):
        p += 1
    return p


_SCHEMA = StructType(
    [
        StructField("item_kind", StringType(), False),
        StructField("item_id", StringType()),
        *(StructField(n, IntegerType(), False) for n in ("piece", "pieces", "start_char", "cut_char", "end_char")),
        StructField("text", StringType()),
    ]
)


def pieces(items: DataFrame, limits: dict[str, tuple[int, int]], code_kinds: tuple[str, ...] = ("source",), texts: bool = True) -> DataFrame:
    """Ordered pieces of the oversized rows of ``items`` (item_kind, item_id, text).

    ``limits``: ``{item_kind: (max_chars, overlap_chars)}``. Rows within their limit, null and empty texts and kinds
    without a limit give no rows. A repeated item gives its pieces once. ``texts=False`` leaves the texts null.
    """

    def of(i: int) -> Column:
        out = F.lit(None).cast("int")
        for kind, pair in limits.items():
            out = F.when(F.col("item_kind") == kind, pair[i]).otherwise(out)
        return out

    large = widen(items.select("item_kind", F.col("item_id").cast("string").alias("item_id"), "text").where(F.length("text") > of(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, item, text in zip(pdf["item_kind"], pdf["item_id"], pdf["text"]):
                parts = split(text, *limits[kind], code=kind in code_kinds)
                rows += [(kind, item, i, len(parts), start, cut, end, text[start:end] if texts else None) for i, (start, cut, end) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=_SCHEMA.names)

    # items are cut where they lie: of repeated ones the short rows meet, and pieces only where they are asked for
    return large.mapInPandas(run, _SCHEMA).dropDuplicates(["item_kind", "item_id", "piece"])


def limits_of(size_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """The limits of each kind; rows without a positive limit are ignored, of several the smallest holds."""
    rows = size_limits.where("item_kind is not null and max_chars > 0").groupBy("item_kind").agg(F.min("max_chars").alias("m"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("o")).limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of items")
    return {r["item_kind"]: (r["m"], r["o"]) for r in rows}


def _items(spark, sf_dir: str) -> DataFrame:
    snippets = table(spark, sf_dir, "evidence").select(F.lit("snippet").alias("item_kind"), F.col("evidence_id").cast("string").alias("item_id"), F.col("snippet").alias("text"))
    sources = table(spark, sf_dir, "modules").select(F.lit("source").alias("item_kind"), F.col("module_id").alias("item_id"), F.col("source").alias("text"))
    return snippets.unionByName(sources)


def p5_found(spark, sf_dir: str) -> DataFrame:
    """The items that had to be split."""
    return pieces(_items(spark, sf_dir), limits_of(table(spark, sf_dir, "size_limits")), texts=False).select("item_kind", "item_id").distinct()


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    """All pieces of the oversized items."""
    return pieces(_items(spark, sf_dir), limits_of(table(spark, sf_dir, "size_limits")))
