"""Reading orders of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def simple(blocks: DataFrame) -> DataFrame:
    """Adds `place`: blocks of a page by bottom edge, then left edge, then content order."""
    w = Window.partitionBy("doc", "page").orderBy("y1", "x0", "block")
    return blocks.withColumn("place", (F.row_number().over(w) - 1).cast("int"))


def rows_by_tolerance(blocks: DataFrame, tolerance: float = 1.25) -> DataFrame:
    """Adds `place`: blocks by top edge rounded to the tolerance, then left edge."""
    w = Window.partitionBy("doc", "page").orderBy(F.bround(F.col("y0") / tolerance) * tolerance, "x0", "block")
    return blocks.withColumn("place", (F.row_number().over(w) - 1).cast("int"))


def by_rank(blocks: DataFrame) -> DataFrame:
    """Blocks with a rank (from a tagged structure) are permuted among their own slots; the others keep theirs."""
    rest = [c for c in blocks.columns if c not in ("doc", "page", "rank", "block")]
    row, tagged = F.struct("rank", "block", *rest), F.col("rank").isNotNull()
    pages = blocks.groupBy("doc", "page").agg(
        F.array_sort(F.collect_list(F.when(tagged, row))).alias("moved"), F.array_sort(F.collect_list(F.when(tagged, F.col("block")))).alias("slots"), F.collect_list(F.when(~tagged, row)).alias("others")
    )
    placed = F.concat(F.zip_with("moved", "slots", lambda r, s: F.struct(r.alias("r"), s.alias("place"))), F.transform("others", lambda r: F.struct(r.alias("r"), r["block"].alias("place"))))
    return pages.select("doc", "page", F.explode(placed).alias("x")).select("doc", "page", "x.r.*", "x.place").select(*blocks.columns, "place")


def xy_cut(blocks: DataFrame, gap_x: float = 12.5, gap_y: float = 2.0, rtl: bool = False) -> DataFrame:
    """Adds `place`: pages are cut at white gutters into columns, else into strips, again and again.

    Recursive, so it runs in pandas, on the blocks of whole pages (some hundreds of rows each).
    """
    columns = blocks.columns
    schema = blocks.withColumn("place", F.lit(0)).schema

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            key = (held["doc"] != held["doc"].iloc[-1]) | (held["page"] != held["page"].iloc[-1]) if len(held) else None
            if key is not None and key.any():
                yield _placed(held[key], gap_x, gap_y, rtl)
                held = held[~key]
        if held is not None and len(held):
            yield _placed(held, gap_x, gap_y, rtl)

    return blocks.select(columns).repartition("doc", "page").sortWithinPartitions("doc", "page", "block").mapInPandas(pages, schema)


def _placed(frame: pd.DataFrame, gap_x: float, gap_y: float, rtl: bool) -> pd.DataFrame:
    place = np.empty(len(frame), np.int32)
    for at in frame.reset_index(drop=True).groupby(["doc", "page"], sort=False).indices.values():
        place[at[cut(frame[["x0", "y0", "x1", "y1"]].to_numpy()[at], gap_x, gap_y, rtl)]] = np.arange(len(at))
    return frame.assign(place=place)


def gutters(low: np.ndarray, high: np.ndarray, least: float) -> np.ndarray:
    """Where the white stretches of `least` and more between intervals start: the farthest end so far, over which the next
    interval starts late enough. Intervals of no length at the very beginning make none."""
    by = np.lexsort((high, low))
    start, reach = low[by], np.maximum.accumulate(high[by])
    return reach[:-1][(start[1:] - reach[:-1] >= least) & (reach[:-1] > start[0])]


def cut(boxes: np.ndarray, gap_x: float, gap_y: float, rtl: bool = False, depth: int = 50) -> list[int]:
    """The reading order of boxes (rows of x0, y0, x1, y1).

    A set of boxes with white columns is dealt to these, another one to strips between white rows; neighbouring strips that
    have a white column in common stay together. Sets are taken from a pile, and what a set is dealt to goes back on top.
    """
    x0, y0, x1, y1 = boxes.T if len(boxes) else np.zeros((4, 0))
    white = lambda at, least: gutters(x0[at], x1[at], least)
    dealt = lambda at, middle, cuts: [at[np.searchsorted(cuts, middle[at], "left") == k] for k in range(len(cuts) + 1)]
    out: list[int] = []
    pile = [(np.arange(len(boxes)), 0)] if len(boxes) else []
    while pile:
        at, level = pile.pop()
        parts, top = [], y0[at]
        if len(at) > 1 and level <= depth:
            columns = white(at, gap_x)
            rows = gutters(y0[at], y1[at], gap_y) if not len(columns) else columns
            if len(columns):
                parts = dealt(at, (x0 + x1) / 2, columns)[:: -1 if rtl else 1]
            elif len(rows):
                for strip in dealt(at, (y0 + y1) / 2, rows):
                    whole = [*parts[-1:], strip, np.concatenate([*parts[-1:], strip])]
                    if parts and all(len(s) and len(white(s, gap_x)) for s in whole):
                        parts[-1] = whole[-1]
                    elif len(strip):
                        parts.append(strip)
            else:
                top = np.rint(top)
        parts = [p for p in parts if len(p)]
        if len(parts) > 1:
            pile += [(p, level + 1) for p in reversed(parts)]
        else:
            out += at[np.lexsort((x0[at], top))].tolist()
    return out
