"""Where a line may be broken, and how a text is laid over a number of lines."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import PLACEHOLDER

#: Weights of a layout's faults: a line wider than WIDEST, a break inside a phrase, an uneven line.
TOO_WIDE, INSIDE, UNEVEN = 1000, 100, 1
WIDEST = 320
CLOSING, OPENING = "，。！？；：、）】》」』”’,.!?;:)]}>", "（【《「『“‘([{<"
WHOLE = re.compile(f"{PLACEHOLDER}|https?://\\S+|[A-Za-z0-9]+(?:['’.-][A-Za-z0-9]+)*")


def width(text: str) -> int:
    """Columns: two for wide and full-width characters."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def breaks(text: str) -> list[int]:
    """Places before which a line may begin: not inside a word, number, address or placeholder, not before closing marks or
    behind opening ones, and never at the edges."""
    inside = {k for m in WHOLE.finditer(text) for k in range(m.start() + 1, m.end())}
    return [k for k in range(1, len(text)) if k not in inside and text[k] not in CLOSING and text[k - 1] not in OPENING and not text[k].isspace()]


def faults(flat: str, points: list[int], lines: int) -> np.ndarray:
    """The fault of a line from each point to each later one, times the square of ``lines`` so that all are whole numbers; infinite
    for lines without text."""
    at = np.array(points)
    columns = np.concatenate([[0], np.cumsum([1 if c.isascii() else width(c) for c in flat])])
    seen = [k for k, c in enumerate(flat) if not c.isspace()]
    starts = np.array([*seen, len(flat)])[np.searchsorted(seen, at)]  # the first visible character from here on
    ends = np.array([0, *(k + 1 for k in seen)])[np.searchsorted(seen, at)]  # behind the last one before here
    wide = columns[ends][None, :] - columns[starts][:, None]
    inside = np.array([0 if p == len(flat) or (p and flat[p - 1] in CLOSING + " ") else INSIDE for p in points])
    whole = UNEVEN * (lines * wide - columns[-1]) ** 2 + lines**2 * (inside[None, :] + TOO_WIDE * np.maximum(wide - WIDEST, 0))
    return np.where((at[:, None] < at[None, :]) & (wide > 0), whole, np.inf)


def laid(text: str, lines: int) -> list[str] | None:
    """The text over so many lines, none empty, with the least sum of faults; null if it has too few places to break. A tie goes
    to the earlier breaks, so that what was laid out once comes out again as it was."""
    flat = " ".join(text.split())
    if not flat:
        return [""] if lines == 1 else None
    points = [0, *breaks(flat), len(flat)]
    if lines < 1 or len(points) <= lines:
        return None
    last = len(points) - 1
    fault = faults(flat, points, lines)
    best, came = np.full(last + 1, np.inf), []
    best[0] = 0
    for _ in range(lines):
        sums = best[:, None] + fault
        came.append(sums.argmin(0))  # of equals the first
        best = sums.min(0)
    if best[last] == np.inf:
        return None
    cuts, b = [last], last
    for at in reversed(came):
        b = int(at[b])
        cuts.append(b)
    cuts.reverse()
    return [flat[points[a] : points[b]].strip() for a, b in zip(cuts, cuts[1:], strict=False)]


def wrapped(text: Column, lines: Column) -> Column:
    """The text broken into so many lines, or null where it can't be. A passage is a few lines, so its table of places and
    lines is small; passages of more than LONGEST characters are refused."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, counts in batches:
            out = []
            for t, n in zip(texts.to_pylist(), counts.to_pylist(), strict=True):
                own = laid(t, n) if t is not None and n is not None and len(t) <= LONGEST else None
                out.append("\n".join(own) if own else None)
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text, lines)


LONGEST = 2000
