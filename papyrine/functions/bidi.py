"""Right-to-left text: from the order in which a line was drawn to the order in which it is read.

After the Unicode annex on bidirectional text, for lines without explicit marks, on whole columns at once: characters are
codes of a class, the strong neighbours of a character are running maxima of places, and rules are tables of classes.
"""

from __future__ import annotations

import unicodedata
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Brackets that mirror in right-to-left text (fixed values).
MIRRORED = {"(": ")", ")": "(", "[": "]", "]": "[", "{": "}", "}": "{", "<": ">", ">": "<", "«": "»", "»": "«", "‹": "›", "›": "‹"}
#: Letters that are written right to left: Hebrew, Arabic and their neighbours, presentation forms.
RTL = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
LEFT, RIGHT, DIGIT, OTHER = range(4)
#: Classes of the annex (fixed values).
_CLASS = {"L": LEFT, "R": RIGHT, "AL": RIGHT, "EN": DIGIT, "AN": DIGIT}


def classes(text: str) -> np.ndarray:
    """LEFT, RIGHT, DIGIT or OTHER for each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known, place = np.unique(codes, return_inverse=True)
    return np.array([_CLASS.get(unicodedata.bidirectional(chr(c)), OTHER) for c in known], np.int8)[place] if len(codes) else np.zeros(0, np.int8)


def _sides(flow: np.ndarray, line: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each character the flow (LEFT or RIGHT) of the nearest one before and after it in its line that has one (is not
    negative); edge, for each line, where there is none."""
    at, n = np.arange(len(flow)), len(flow)
    before = np.maximum.accumulate(np.where(flow >= 0, at, -1))
    after = np.minimum.accumulate(np.where(flow >= 0, at, n)[::-1])[::-1]
    pick = lambda k: np.where((k >= 0) & (k < n) & (line[np.clip(k, 0, n - 1)] == line), flow[np.clip(k, 0, n - 1)], edge[line])
    return pick(before), pick(after)


def levels(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all characters of the lines together their embedding levels and line, and for each line its own level.

    A line runs right to left if it has any letters that do and at least as many as others. Digits beside such letters
    keep their order inside them; what has no direction goes with its neighbours if they agree, else with the line.
    """
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    line = np.repeat(np.arange(len(lines)), size)
    kind = classes("".join(lines))
    right, left = (np.bincount(line[kind == k], minlength=len(lines)) for k in (RIGHT, LEFT))
    base = ((right > 0) & (right >= left)).astype(np.int8)
    if not len(kind):
        return kind, line, base
    strong = np.where(kind <= RIGHT, kind, -1).astype(np.int8)
    near = np.maximum(*_sides(strong, line, base))  # RIGHT if either side, or an open side of the line, runs that way
    flow = np.where(kind == DIGIT, near, strong)
    a, b = _sides(flow, line, base)
    flow = np.where(flow >= 0, flow, np.where(a == b, a, base[line]))
    even = 2 * base[line]  # of text that runs left to right
    level = np.where(kind == DIGIT, np.where(flow == RIGHT, 2, even), np.where(flow == RIGHT, 1, even))
    return level.astype(np.int8), line, base


def _read(text: str, level: list[int]) -> str:
    """Stretches over level 0 are read from their end; in these, stretches of level 2 stay as they are."""
    out = []
    for inner, run in groupby(zip(text, level, strict=True), key=lambda x: x[1] > 0):
        if not inner:
            out.append("".join(c for c, _ in run))
            continue
        parts = ["".join(c for c, _ in part) if deep else "".join(MIRRORED.get(c, c) for c, _ in part)[::-1] for deep, part in groupby(run, key=lambda x: x[1] == 2)]
        out.append("".join(reversed(parts)))
    return "".join(out)


def logical_lines(lines: list[str]) -> list[str]:
    """Lines that were drawn left to right, in the order in which they are read."""
    level, line, _ = levels(lines)
    ends = np.cumsum(np.bincount(line, minlength=len(lines))) if len(lines) else np.zeros(0, np.int64)
    return [_read(t, level[e - len(t) : e].tolist()) for t, e in zip(lines, ends.tolist(), strict=True)]


def logical(text: str) -> str:
    return logical_lines([text])[0]


def logical_text(text):
    """A column of single lines in logical order. Only lines with right-to-left letters go through pandas."""

    @F.pandas_udf("string")
    def reorder(s: pd.Series) -> pd.Series:
        out, some = pd.Series([None] * len(s), index=s.index, dtype=object), s.notna()
        out[some] = logical_lines(s[some].tolist())
        return out

    has = F.coalesce(text.rlike(RTL), F.lit(False))
    return F.when(has, reorder(F.when(has, text))).otherwise(text)
