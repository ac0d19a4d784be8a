"""Splitting oversized texts at natural boundaries by dynamic programming.

Cut positions carry a penalty by kind; a piece costs the penalty of its end plus the squared
relative gap between its length and the even length. The cheapest chain of pieces from the
text's start to its end wins. No piece is longer than `limit`, each starts about `overlap`
characters before the end of the one before and never more, and together they cover the text. The
overlap is less only before a run without cuts that a piece couldn't hold otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Penalty of a cut by kind.
KINDS = ("paragraph", "line", "sentence", "clause", "word", "forced")
PENALTY = np.array([0.0, 0.05, 0.1, 0.6, 1.0, 1000.0])
#: The kinds (paragraph, line, sentence) whose chain bounds the search over all boundaries.
STRONG = 2

# The characters that end a natural unit.
SEPARATOR = r"[\s.!?;:,。！？、，]"
_EDGE = re.compile(rf"(?<={SEPARATOR})(?!{SEPARATOR})|(?<!{SEPARATOR})(?={SEPARATOR})")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"[.!?]+[\"')\]”’]*\s+|[。！？]+[」』”]?\s*")
_CLAUSE = re.compile(r"[;:,]\s+|[、，]\s*")


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted cut positions, their kinds, and all word edges (for starts of overlaps)."""
    n = len(text)
    kind_at: dict[int, int] = {}
    for kind, finder in ((0, _PARAGRAPH), (1, _LINE), (2, _SENTENCE)):
        for m in finder.finditer(text):
            kind_at.setdefault(m.end(), kind)
    edges = np.fromiter((m.start() for m in _EDGE.finditer(text)), np.int64)
    edges = edges[(edges > 0) & (edges < n)]
    for m in _CLAUSE.finditer(text):
        kind_at.setdefault(m.end(), 3)
    for p in edges.tolist():
        kind_at.setdefault(p, 4)
    bounds = np.concatenate(([0], edges, [n]))
    for i in np.flatnonzero(np.diff(bounds) > limit).tolist():  # a run that no piece can hold
        a, b = int(bounds[i]), int(bounds[i + 1])
        for p in range(a + limit // 28, b, limit // 28):
            kind_at.setdefault(p, 5)
    at = np.array(sorted(p for p in kind_at if 0 < p < n), np.int64)
    return at, np.array([kind_at[int(p)] for p in at], np.int64), edges


def split_text(text: str, limit: int = 1400, overlap: int = 240) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at end) of each piece; the last piece's kind is 'end'.

    A text within the limit is one piece, an empty one none. Needs 0 <= overlap < limit / 2.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and under half the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    cuts, kinds, edges = boundaries(text, limit)
    ends = np.concatenate((cuts, [n]))
    price = np.concatenate((PENALTY[kinds], [0.0]))
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    even = (n + (pieces - 1) * overlap) / pieces

    def cheapest(from_cuts: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cost, origin, start of the piece) for each end, pieces beginning only after the cuts given;
        a cut that costs more than a whole known chain is in no cheapest one and left out."""
        best = np.full(len(ends), np.inf)
        origin = np.full(len(ends), -2, np.int64)
        begin = np.zeros(len(ends), np.int64)

        def relax(i: int, start: int, base: float) -> None:
            lo, hi = i + 1, int(np.searchsorted(ends, start + limit, "right"))
            if hi <= lo:
                return
            cost = base + price[lo:hi] + ((ends[lo:hi] - start - even) / even) ** 2
            better = np.flatnonzero(cost < best[lo:hi] - 1e-12)
            best[lo + better] = cost[better]
            origin[lo + better] = i
            begin[lo + better] = start

        relax(-1, 0, 0.0)
        for i in from_cuts.tolist():
            if not best[i] <= bound:
                continue
            e = int(ends[i])
            low = max(e - overlap, int(ends[i + 1]) - limit, int(begin[i]))  # from there the next cut is in reach
            k = int(np.searchsorted(edges, low))
            start = int(edges[k]) if k < len(edges) and edges[k] <= e - (e - low) // 2 else low
            relax(i, start, best[i])
        return best, origin, begin

    known = cheapest(np.flatnonzero(kinds <= STRONG), np.finfo(float).max)[0][-1]
    best, origin, begin = cheapest(np.arange(len(cuts)), min(known + 1e-9, np.finfo(float).max))
    out = []
    i = len(ends) - 1
    while i >= 0:
        out.append((int(begin[i]), int(ends[i]), KINDS[kinds[i]] if i < len(cuts) else "end"))
        i = int(origin[i])
    return out[::-1]


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 1400, overlap: int = 240) -> DataFrame:
    """(key, piece, start, end, kind, text): the pieces of every text, numbered from 0.

    start and end count characters within the text, 0-based, end exclusive. Null and empty texts
    have no pieces; a text within the limit is one. Rows with equal keys are split each; other
    columns are ignored, whatever their names. No shuffle: one pass, a text per step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts, stops, kinds, parts = [], [], [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for number, (a, b, kind) in enumerate(split_text(t or "", limit, overlap)):
                    rows.append(r), numbers.append(number), starts.append(a), stops.append(b), kinds.append(kind), parts.append(t[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(kinds, pa.string()), pa.array(parts, pa.string())],
                names=["key", "piece", "start", "end", "kind", "text"],
            )

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"key {kind}, piece int, start int, `end` int, kind string, text string")
