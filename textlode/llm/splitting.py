"""Splitting oversized texts by recursive bisection at the strongest boundary near the middle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlode.session import ship

LIMIT, OVERLAP = 1500, 100

#: Boundaries from strong to weak; a cut falls at the end of a match.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),  # paragraph
    re.compile(r"\n\s*"),  # line
    re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？]"),  # sentence
    re.compile(r"\s+"),  # word
]
_SPACE = re.compile(r"\s")


def cut_near(text: str, a: int, b: int, reach: int) -> int:
    """Where to cut ``text[a:b]``: at the strongest boundary within ``reach`` of the middle, the nearest such one; in
    the middle itself if there is no boundary at all."""
    mid = (a + b) // 2
    lo, hi = max(a + 1, mid - reach), min(b - 1, mid + reach)
    for kind in BOUNDARIES:
        best = 0
        for m in kind.finditer(text, max(a, lo - 8), min(b, hi + 8)):
            at = m.end()
            if lo <= at <= hi and (not best or abs(at - mid) < abs(best - mid)):
                best = at
            if at > mid:
                break
        if best:
            return best
    return mid


def cores(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ends of the pieces without their overlaps: each at most ``limit - overlap`` long, together the whole text."""
    if len(text) <= limit:
        return [(0, len(text))]
    most, out, todo = limit - overlap, [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            out.append((a, b))
            continue
        # a quarter of the part either way keeps the depth logarithmic; near the end a cut must leave small parts
        cut = cut_near(text, a, b, max(1, min((b - a) // 4, 4 * most)))
        todo += [(cut, b), (a, cut)]
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, core, end)`` of each piece of the stripped ``text``: ``text[start:core]`` is shared with the piece before, at
    most ``overlap`` long and from the start of a word where there is one; white space at the ends is left out."""
    out = []
    for a, b in cores(text, limit, overlap):
        start = a
        if out and overlap:
            start = max(a - overlap, out[-1][1])
            if start > 0 and not text[start - 1].isspace():
                space = _SPACE.search(text, start, a)
                start = space.end() if space else start
        while b > start and text[b - 1].isspace():
            b -= 1
        while start < b and text[start].isspace():
            start += 1
        out.append((start, max(a, start), b))
    return [p for p in out if p[2] > p[0]]


def split_oversized(df: DataFrame, row_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row for each piece of each text: ``(row_id, piece_no, n_pieces, start, core, end, piece)``.

    Texts are first stripped of Unicode white space; offsets count code points in the stripped text. A text within the limit
    is one piece; a null or blank text has none. Every character that isn't white space lies in exactly one core
    ``[core, end)``. No piece is longer than ``limit``. Repeated rows are split alike; other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if limit - overlap < 2:
        raise ValueError("limit must exceed overlap by two or more")
    ship(df.sparkSession)
    key = df.schema[row_id]
    schema = T.StructType([T.StructField("row_id", key.dataType)])
    for name in ("piece_no", "n_pieces", "start", "core", "end"):
        schema = schema.add(name, T.IntegerType())
    schema = schema.add("piece", T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for key, body in zip(batch["row_id"], batch["text"]):
                body = body.strip()
                found = pieces(body, limit, overlap) if body else []
                rows += [(key, n, len(found), s, c, e, body[s:e]) for n, (s, c, e) in enumerate(found)]
                size += len(body)
                if size > 8_000_000:
                    yield pd.DataFrame(rows, columns=schema.names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=schema.names)

    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    return rows.mapInPandas(run, schema).withColumnRenamed("row_id", row_id)
