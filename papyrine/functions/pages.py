"""Selections of pages."""

from __future__ import annotations

from collections.abc import Iterable


def select(pages: None | int | str | Iterable[int], n: int) -> list[int]:
    """Page numbers from 0, in the order asked for, repeats kept: None for all, a number, several, or text such as
    "0,2-5", "-1", "3-". Negative numbers count from the end; a page that is not there is an IndexError."""

    def one(k: int) -> int:
        if not -n <= k < n:
            raise IndexError(f"page {k} of {n}")
        return k % n

    if pages is None:
        return list(range(n))
    if isinstance(pages, int):
        return [one(pages)]
    if not isinstance(pages, str):
        return [one(int(k)) for k in pages]
    out: list[int] = []
    for part in pages.replace(" ", "").split(","):
        first, dash, last = part[1:].partition("-") if part[:1] == "-" else part.partition("-")
        low = one(int(("-" if part[:1] == "-" else "") + first))
        high = low if not dash else one(int(last)) if last else n - 1
        out += range(low, high + 1)
    return out


def ranges(spec: str) -> list[tuple[int, int | None]]:
    """The parts of a selection as (first, last): negative numbers from the end, None for the last page."""
    out: list[tuple[int, int | None]] = []
    for part in spec.replace(" ", "").split(","):
        sign, body = (-1, part[1:]) if part[:1] == "-" else (1, part)
        first, dash, last = body.partition("-")
        out.append((sign * int(first), (int(last) if last else None) if dash else sign * int(first)))
    return out


def select_pages(pages, spec: str):
    """Pages (doc, page from 0 without gaps) of a selection such as "0,2-5,-1", with sel_ord, their place in it. A document
    that does not have a page asked for is an error when its rows are read."""
    from pyspark.sql import functions as F

    counts = pages.groupBy("doc").agg((F.max("page") + 1).alias("n"))
    at = lambda k: F.lit(k) if k >= 0 else F.col("n") + k
    parts = [F.sequence(at(a), at(b) if b is not None else F.col("n") - 1) for a, b in ranges(spec)]
    whole = F.posexplode(F.concat(*parts)).alias("sel_ord", "page")
    asked = counts.select("doc", "n", whole)
    missing = F.raise_error(F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" of "), F.col("n").cast("string")))
    asked = asked.withColumn("page", F.when((F.col("page") < 0) | (F.col("page") >= F.col("n")), missing).otherwise(F.col("page"))).drop("n")
    return pages.join(asked, ["doc", "page"])
