"""Joins of boxes: words to cells, characters to links, redaction areas, crossings of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions.geometry import cover, overlap

#: Rows of a box table that callers pass by value; beyond it the boxes have to carry doc and page and are joined on them.
SMALL = 10_000


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    if len(rows) > SMALL:
        raise ValueError(f"at most {SMALL} rows by value; pass a table with doc and page instead")
    return F.broadcast(spark.createDataFrame(rows, schema))


def _joined(items: DataFrame, boxes: DataFrame, prefix: str) -> DataFrame:
    """Pairs that touch. Boxes without doc and page hold for every page and come by value."""
    named = boxes.select(*[F.col(c).alias(c if c in ("doc", "page") else f"{prefix}{c}") for c in boxes.columns])
    touch = (F.col(f"{prefix}x0") <= F.col("x1")) & (F.col(f"{prefix}x1") >= F.col("x0")) & (F.col(f"{prefix}y0") <= F.col("y1")) & (F.col(f"{prefix}y1") >= F.col("y0"))
    if "doc" in boxes.columns:
        return items.join(named, ["doc", "page"]).where(touch)
    return items.join(named, touch)


def assign(items: DataFrame, boxes: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Each item with the box that covers most of it, the first of equals, if that is at least `least`.

    The best box of an item is kept by an aggregate, so an item's pairs are never sorted.
    """
    pairs = _joined(items, boxes, "b_").withColumn("cover", cover("", "b_")).where((F.col("cover") >= least) & (F.col("cover") > 0))
    best = pairs.groupBy(*keys).agg(F.max(F.struct("cover", (-F.col("b_id")).alias("n"))).alias("top"))
    return best.select(*keys, (-F.col("top.n")).alias("box"), F.col("top.cover").alias("cover"))


def link_runs(chars: DataFrame, links: DataFrame) -> DataFrame:
    """doc, page, pline, run, url, text: each line cut where the link under its characters changes.

    links: id, url and a box. A gap is linked only between two characters of one link.
    """
    own = assign(chars, links, ["doc", "page", "gidx"]).select("doc", "page", "gidx", "box")
    urls = links.select(F.col("id").alias("box"), "url")
    marked = chars.join(own, ["doc", "page", "gidx"], "left").join(urls, "box", "left").withColumn("url", F.coalesce("url", F.lit("")))
    w = Window.partitionBy("doc", "page", "pline").orderBy("gidx")
    change = F.coalesce(F.lag("url").over(w) != F.col("url"), F.lit(True))
    runs = marked.withColumn("run", (F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    text = F.concat(F.when(F.col("gap") & ~F.col("_cut"), " ").otherwise(""), F.col("c"))
    runs = runs.withColumn("_cut", change)
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gidx", text.alias("t")))), lambda x: x["t"]), "")
    return runs.groupBy("doc", "page", "pline", "run", "url").agg(pieces.alias("text"))


def hit(prefix: str):
    """Whether a redaction area takes a glyph: enough of either one's width and height."""
    gw, gh = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rw, rh = F.col(f"{prefix}x1") - F.col(f"{prefix}x0"), F.col(f"{prefix}y1") - F.col(f"{prefix}y0")
    iw = overlap(F.col("x0"), F.col("x1"), F.col(f"{prefix}x0"), F.col(f"{prefix}x1"))
    ih = overlap(F.col("y0"), F.col("y1"), F.col(f"{prefix}y0"), F.col(f"{prefix}y1"))
    return ((iw >= 0.1 * gw) | (iw >= 0.5 * rw)) & ((ih >= 0.5 * gh) | (ih >= 0.5 * rh)) & (iw > 0) & (ih > 0)


def redaction_report(chars: DataFrame, areas: DataFrame) -> DataFrame:
    """doc, page, chars, removed, touched (in contact with an area but left), half (covered by half, left)."""
    pairs = _joined(chars, areas, "r_")
    state = pairs.groupBy("doc", "page", "gidx").agg(F.max(hit("r_")).alias("hit"), F.max(cover("", "r_") >= 0.5).alias("half"))
    rows = chars.select("doc", "page", "gidx").join(state, ["doc", "page", "gidx"], "left")
    yes = lambda c: F.count_if(c)
    return rows.groupBy("doc", "page").agg(
        F.count("*").alias("chars"),
        yes(F.col("hit")).alias("removed"),
        yes(F.col("hit").isNotNull() & ~F.col("hit")).alias("touched"),
        yes(F.col("half") & ~F.col("hit")).alias("half"),
    )


def unmatched(before: DataFrame, after: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Characters of `before` without a partner in `after` (same character, same box up to rounding), as multisets."""
    keys = [F.round(F.col(c) / tolerance).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return before.select("doc", "page", "c", *keys).exceptAll(after.select("doc", "page", "c", *keys))


def crossings(rules: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """page, h, v: horizontal and vertical rules (id, horizontal, position, start, stop) that meet."""
    h = rules.where("horizontal").select("page", F.col("id").alias("h"), F.col("position").alias("hp"), F.col("start").alias("ha"), F.col("stop").alias("hb"))
    v = rules.where("not horizontal").select("page", F.col("id").alias("v"), F.col("position").alias("vp"), F.col("start").alias("va"), F.col("stop").alias("vb"))
    meet = (F.col("vp") >= F.col("ha") - tolerance) & (F.col("vp") <= F.col("hb") + tolerance) & (F.col("hp") >= F.col("va") - tolerance) & (F.col("hp") <= F.col("vb") + tolerance)
    return h.join(v, "page").where(meet).select("page", "h", "v")


def merge_rules(segments: DataFrame, snap: float = 1.5, join: float = 2.5) -> DataFrame:
    """page, horizontal, position (least of its cluster), start, stop: collinear segments snapped and joined.

    Two gaps-and-islands steps: positions within `snap` of the one before, then spans that start before the farthest end.
    """
    w = Window.partitionBy("page", "horizontal").orderBy("position", "start", "stop")
    new = F.coalesce(F.col("position") - F.lag("position").over(w) > snap, F.lit(True)).cast("int")
    s = segments.withColumn("_new", new).withColumn("_cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = Window.partitionBy("page", "horizontal", "_cluster").orderBy("start", "stop")
    reach = F.max("stop").over(c.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_gap", F.coalesce(F.col("start") > reach + join, F.lit(True)).cast("int"))
    s = s.withColumn("_span", F.sum("_gap").over(c.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_position", F.min("position").over(Window.partitionBy("page", "horizontal", "_cluster")))
    return s.groupBy("page", "horizontal", "_cluster", "_span").agg(F.min("_position").alias("position"), F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_cluster", "_span")


def first_holder(items: DataFrame, boxes: DataFrame, keys: list[str], tolerance: float = 2.0) -> DataFrame:
    """keys, box: the first box (by id, by value) that holds an item's centre, within `tolerance`."""
    named = boxes.select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns])
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = mx.between(F.col("b_x0") - tolerance, F.col("b_x1") + tolerance) & my.between(F.col("b_y0") - tolerance, F.col("b_y1") + tolerance)
    return items.join(named, inside).groupBy(*keys).agg(F.min("b_id").alias("box"))


def slots(items: DataFrame, others: DataFrame) -> DataFrame:
    """doc, page, id, slot: before which place of a page's elements (place, y0) an item (id, y0) goes: the first that does
    not start over it, by a point; after the last otherwise."""
    n = others.groupBy("doc", "page").agg(F.count("*").alias("n"))
    rows = items.join(others.select("doc", "page", "place", F.col("y0").alias("o_y0")), ["doc", "page"]).where(F.col("o_y0") >= F.col("y0") - 1)
    first = rows.groupBy("doc", "page", "id").agg(F.min("place").alias("slot"))
    return items.select("doc", "page", "id").join(n, ["doc", "page"]).join(first, ["doc", "page", "id"], "left").select("doc", "page", "id", F.coalesce("slot", "n").cast("int").alias("slot"))
