"""Splitting oversized texts at natural boundaries.

Every position of a text gets a boundary strength (blank line before a
definition, blank line, definition, line end, sentence end, clause, word). A sparse table over
the strengths answers range-maximum queries; each cut is the strongest boundary
of the permissible window, ties to the right, and the next piece starts up to
``overlap`` characters before the cut, again at the strongest boundary there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1800
OVERLAP = 200
#: Characters that one table of boundary strengths covers.
STRIDE = 1 << 18

# strengths, weakest first; a boundary lies before the character at its position
_WORD, _CLAUSE, _SENTENCE, _LINE, _DEF, _BLANK, _BLANK_DEF = 1, 2, 3, 4, 5, 6, 7
_DEFINITION = re.compile(
    r"^[ \t]*(?:@\w|#{1,6} |/\*\*|///|#\[|(?:export |default |public |private |protected |static |final |abstract |async |pub(?:\([a-z]+\))? |unsafe )*(?:def|class|func|function|fn|interface|impl|struct|enum|trait|type|mod)\b)",
    re.M,
)
_SENTENCE_END = re.compile(r"[.!?…][\"'”»)\]]*[ \t]+(?=\S)|[。！？；]+[”」』）]*")
_CLAUSE_END = re.compile(r"[,;:][ \t]+|[，、：]|[)}\]]\s+|[;{}](?=\S)")
_WORD_END = re.compile(r"(?<!\s)\s+(?=\S)")
_LINE_END = re.compile(r"\r\n|\n|\r")
_BLANK_LINE = re.compile(r"(?:(?:\r\n|\n|\r)[ \t]*){2,}")


def strengths(text: str) -> np.ndarray:
    """Strength of the boundary before each position 0..len(text)."""
    s = np.zeros(len(text) + 1, dtype=np.int8)

    def put(pattern: re.Pattern[str], value: int, at_start: bool = False) -> None:
        at = np.fromiter((m.start() if at_start else m.end() for m in pattern.finditer(text)), dtype=np.int64)
        if len(at):
            s[at] = np.maximum(s[at], value)

    put(_WORD_END, _WORD)
    put(_CLAUSE_END, _CLAUSE)
    put(_SENTENCE_END, _SENTENCE)
    put(_LINE_END, _LINE)
    starts = np.fromiter((m.start() for m in _DEFINITION.finditer(text)), dtype=np.int64)
    if len(starts):
        s[starts] = np.maximum(s[starts], _DEF)
    for m in _BLANK_LINE.finditer(text):
        # the end of a blank run may lie inside the indent of the next line: go back to the line's start
        at = max(m.group().rfind("\n"), m.group().rfind("\r")) + 1 + m.start()
        s[at] = max(s[at], _BLANK_DEF if s[at] == _DEF else _BLANK)
    cr = [i + 1 for i, c in enumerate(text[:-1]) if c == "\r" and text[i + 1] == "\n"] if "\r" in text else []
    s[cr] = 0
    return s


class RangeMax:
    """Sparse table: position of the rightmost maximum of any range of up to ``widest`` values in constant time.

    A level for each power of two up to ``widest`` is kept, so the table's size per value does not depend on their number.
    """

    def __init__(self, values: np.ndarray, widest: int) -> None:
        self.values = values
        n = min(len(values), widest)
        self.rows = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= n:
            last = self.rows[-1]
            m = len(values)
            a, b = last[: m - 2 * width + 1], last[width : m - width + 1]
            self.rows.append(np.where(values[a] > values[b], a, b))
            width *= 2

    def rightmost(self, lo: int, hi: int) -> int:
        """Of the inclusive range lo..hi."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = int(self.rows[k][lo]), int(self.rows[k][hi - (1 << k) + 1])
        return a if self.values[a] > self.values[b] else b


class _Window(RangeMax):
    """A table over the part of the text that begins at ``base``; positions are those of the text."""

    def __init__(self, values: np.ndarray, base: int, widest: int) -> None:
        super().__init__(values, widest)
        self.base = base

    def rightmost(self, lo: int, hi: int) -> int:
        return super().rightmost(lo - self.base, hi - self.base) + self.base


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of consecutive pieces of at most ``limit`` code points.

    A text within the limit is one piece; an empty one too. Each piece but the
    last ends in the second half of its permissible length at the strongest
    boundary there; where there is none, at the strongest boundary before it that
    lies behind the last cut; where there is none at all, at the limit. The next piece
    begins at the strongest boundary within ``overlap`` characters before the
    cut, or exactly ``overlap`` before it where there is none; a piece too short
    for that is followed from its end on.
    """
    if limit < 2 or not 0 <= overlap < limit // 2:
        raise ValueError("limit must be at least 2 and overlap less than half of it")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    out = []
    start = end = 0
    # the table slides along: it covers STRIDE characters at a time, and what a piece may need beyond them
    whole, base, index = strengths(text), 0, None
    while n - start > limit:
        before = end
        if index is None or start + limit >= base + len(index.values):
            base = max(0, start - overlap)
            index = _Window(whole[base : base + STRIDE + 3 * limit], base, limit)
        end = index.rightmost(start + limit // 2 + 1, start + limit)
        if whole[end] == 0:
            end = index.rightmost(before + 1, start + limit // 2)
        if whole[end] == 0:
            end = start + limit
            if text[end - 1] == "\r" and text[end] == "\n":
                end -= 1
        out.append((start, end))
        low = max(end - overlap, start + 1)
        if low < end:
            back = index.rightmost(low, end - 1)
            start = back if whole[back] > 0 else low if low == end - overlap else end
        else:
            start = end
    out.append((start, n))
    return out


def _split_batch(batches: Iterator[pd.DataFrame], limit: int, overlap: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, text, first in zip(pdf["key"], pdf["text"], pdf["first_line"], strict=True):
            # line number of each position, counted within the text; CRLF is one line end
            ends = np.fromiter((m.end() for m in _LINE_END.finditer(text)), dtype=np.int64)
            known = first is not None and first == first and first >= 1
            base = int(first) if known else 1
            for k, (a, b) in enumerate(pieces(text, limit, overlap)):
                top = base + int(np.searchsorted(ends, a, "right"))
                bottom = base + int(np.searchsorted(ends, max(a, b - 1), "right"))
                rows.append((key, k, text[a:b], a, b, top, bottom, known))
            if len(rows) > 2000:
                yield pd.DataFrame(rows, columns=_COLS)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_COLS)


_COLS = ["key", "chunk_index", "text", "char_start", "char_end", "line_start", "line_end", "lines_known"]
_SCHEMA = "key string, chunk_index int, text string, char_start int, char_end int, line_start int, line_end int, lines_known boolean"


def split_oversized(df: DataFrame, key: str, text: str, first_line: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the rows of ``df`` whose text is longer than ``limit`` code points.

    Returns key, chunk_index (0-based within the row), text, char_start,
    char_end, line_start, line_end, lines_known. Lines count from ``first_line``
    where that is at least 1, else from 1 within the text and ``lines_known`` is
    false. Rows with a null or short text give nothing; repeated rows give repeated pieces;
    other columns of ``df`` are ignored.
    """
    line = F.col(first_line).cast("int") if first_line else F.lit(None).cast("int")
    long = df.where(F.length(text) > limit).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), line.alias("first_line"))
    return long.mapInPandas(lambda it: _split_batch(it, limit, overlap), _SCHEMA)
