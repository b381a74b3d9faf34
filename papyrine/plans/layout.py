"""From glyphs to characters in words, lines and blocks, by following the pen.

Only lag, running sums and last values over (doc, page) in content order are used: one exchange and one sort serve all of
them. Left-to-right text is handled; a page's direction may change between blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters that start a list item (fixed values).
BULLETS = "•◦▪–-*"


@dataclass(frozen=True)
class LayoutParams:
    """Distances as parts of the glyph's size, but indent_pt, which is in points."""

    word_gap: float = 0.14
    column_gap: float = 0.85
    baseline_tol: float = 0.85
    block_gap: float = 1.5
    dup_dist: float = 0.1
    indent_pt: float = 4.1
    superscript_rise: float = 0.21
    ascent: float = 0.8
    descent: float = -0.2


def drop_overprints(glyphs: DataFrame, params: LayoutParams = LayoutParams()) -> DataFrame:
    """Drops a glyph that repeats the one before it, in place and direction (fake bold)."""
    w = Window.partitionBy("doc", "page").orderBy("gidx")
    before = lambda c: F.lag(c).over(w)
    away = F.sqrt((F.col("px") - before("px")) * (F.col("px") - before("px")) + (F.col("py") - before("py")) * (F.col("py") - before("py")))
    same = (before("c") == F.col("c")) & (before("dx") * F.col("dx") + before("dy") * F.col("dy") >= 0.999) & (away / F.col("size") < params.dup_dist)
    return glyphs.withColumn("_dup", F.coalesce(same, F.lit(False))).where("not _dup").drop("_dup")


#: Letters that one glyph may stand for (fixed values).
LIGATURES = {"ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "st": "ﬆ"}


def recombine_ligatures(glyphs: DataFrame) -> DataFrame:
    """A glyph and the continuations after it (column cont) become one, if they spell a ligature; others stay."""
    w = Window.partitionBy("doc", "page").orderBy("gidx")
    goes_on = F.col("cont") & F.coalesce(F.lag("py").over(w) == F.col("py"), F.lit(False))  # a ligature does not cross a line
    g = glyphs.withColumn("cont", goes_on)
    g = g.withColumn("_set", F.sum((~F.col("cont")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc", "page", "_set").orderBy("gidx")
    text = F.col("c")
    for k in range(1, 3):  # three characters at most
        text = F.concat(text, F.coalesce(F.lead("c", k).over(whole), F.lit("")))
    all_ = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = g.withColumn("_n", F.count("*").over(all_)).withColumn("_text", F.first(F.when(~F.col("cont"), text), True).over(all_))
    g = g.withColumn("_text", F.when(F.col("_n") <= 3, F.col("_text")))
    one = F.lit(None).cast("string")
    for text, glyph in LIGATURES.items():
        one = F.when(F.col("_text") == text, glyph).otherwise(one)
    g = g.withColumn("_one", F.when(F.col("_n") > 1, one)).withColumn("_end", F.max("qx").over(all_))
    kept = g.where("_one is null or not cont")
    return kept.withColumn("c", F.coalesce("_one", "c")).withColumn("qx", F.when(F.col("_one").isNotNull(), F.col("_end")).otherwise(F.col("qx"))).select(*glyphs.columns)


def clip(glyphs: DataFrame, box: tuple[float, float, float, float], params: LayoutParams = LayoutParams()) -> DataFrame:
    """Glyphs whose box touches `box`; apply it before grouping, as a glyph left out does not move the pen."""
    x0, y0, x1, y1 = box
    return glyphs.where((F.col("qx") >= x0) & (F.col("px") <= x1) & (F.col("py") - F.lit(params.descent) * F.col("size") >= y0) & (F.col("py") - F.lit(params.ascent) * F.col("size") <= y1))


def group_glyphs(glyphs: DataFrame, params: LayoutParams = LayoutParams()) -> DataFrame:
    """chars: glyphs with block, pline and pword (numbers on the page), head (first of a line), gap (a space before it),
    sup and the box x0, y0, x1, y1."""
    w = Window.partitionBy("doc", "page").orderBy("gidx")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = glyphs
    for c in ("qx", "qy", "dx", "dy", "c"):
        g = g.withColumn(f"_{c}", F.lag(c).over(w))
    first = F.col("_qx").isNull()
    along = F.col("dx") * F.col("_dx") + F.col("dy") * F.col("_dy") >= 0.999
    spacing = ((F.col("px") - F.col("_qx")) * F.col("dx") + (F.col("py") - F.col("_qy")) * F.col("dy")) / F.col("size")
    shift = F.abs((F.col("py") - F.col("_qy")) * F.col("dx") - (F.col("px") - F.col("_qx")) * F.col("dy")) / F.col("size")
    g = g.withColumn("_spacing", spacing).withColumn("_shift", shift).withColumn("_along", along)
    level = F.col("_along") & (F.col("_shift") < params.baseline_tol)
    joined = level & ((F.abs("_spacing") < params.word_gap) | ((F.col("_spacing") > -params.column_gap) & (F.col("_spacing") < 0)))
    spaced = level & ~joined & (F.col("_spacing") > 0) & (F.col("_spacing") < params.column_gap)
    near = F.col("_along") & ~level & (F.col("_shift") <= params.block_gap)
    code = F.ascii("_c")
    allowed = (F.col("_c") != " ") & ((code < 0x700) | code.between(0x2000, 0x20CF))
    g = g.withColumn("head", F.when(first, True).otherwise(~(joined | spaced)))
    g = g.withColumn("gap", F.when(first, False).otherwise(spaced & allowed))
    g = g.withColumn("_hard", F.when(first, True).otherwise(~level & ~near)).withColumn("_near", F.coalesce(near, F.lit(False)))
    keep = lambda c: F.last_value(F.when(F.col("head"), F.col(c)), F.lit(True)).over(upto)
    g = g.withColumn("pline", (F.sum(F.col("head").cast("int")).over(upto) - 1).cast("int"))
    g = g.withColumn("pword", (F.sum((F.col("head") | F.col("gap")).cast("int")).over(upto) - 1).cast("int"))
    g = g.withColumn("_start", keep("px")).withColumn("_lead", keep("c")).withColumn("_base", keep("py"))
    g = g.withColumn("_start0", F.lag("_start").over(w)).withColumn("_lead0", F.lag("_lead").over(w))
    indented = F.col("_near") & (F.col("px") - F.col("_start0") > params.indent_pt) & ~F.col("_lead0").isin(*BULLETS)
    opens = F.col("head") & (F.col("_hard") | F.coalesce(indented, F.lit(False)))
    g = g.withColumn("block", (F.sum(opens.cast("int")).over(upto) - 1).cast("int"))
    g = g.withColumn("sup", (F.col("dx") >= 0.999) & (F.col("py") < F.col("_base") - F.col("size") * params.superscript_rise))
    box = [F.col("px").alias("x0"), (F.col("py") - params.ascent * F.col("size")).alias("y0"), F.col("qx").alias("x1"), (F.col("py") - params.descent * F.col("size")).alias("y1")]
    return g.select("doc", "page", "gidx", "c", "block", "pline", "pword", "head", "gap", "sup", *box, "px", "py", "size", "font", "color", "dx", "dy")


def mark_continuations(glyphs: DataFrame) -> DataFrame:
    """Adds cont: a glyph that shares place, end and font with the one before it (one glyph for several characters)."""
    w = Window.partitionBy("doc", "page").orderBy("gidx")
    same = F.lit(True)
    for k in ("px", "py", "qx", "qy", "font"):
        same = same & (F.lag(k).over(w) == F.col(k))
    return glyphs.withColumn("cont", F.coalesce(same, F.lit(False)))


def fix_overhang(glyphs: DataFrame) -> DataFrame:
    """Ends a glyph (with cont) where the next one of its line starts, if that lies inside it: boxes of slanted letters are
    wider than their advance."""
    w = Window.partitionBy("doc", "page").orderBy("gidx")
    after = lambda c: F.lead(c).over(w)
    inside = (F.col("dy") == 0) & (F.col("dx") > 0) & (after("dx") > 0) & (after("py") == F.col("py")) & (F.col("px") < after("px")) & (after("px") < F.col("qx")) & ~after("cont")
    return glyphs.withColumn("_next", F.when(inside, after("px"))).withColumn("qx", F.coalesce("_next", "qx")).drop("_next")


def carry_hint(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that are not generated, with hint: whether generated ones came since the one before.

    Of rows in one place those that are not generated come first, so the result does not hang on how rows are dealt.
    """
    w = Window.partitionBy(*keys).orderBy(*order, "generated")
    real = (~F.col("generated")).cast("int")
    own = rows.withColumn("_k", F.sum(real).over(w.rowsBetween(Window.unboundedPreceding, 0)) - real)
    hint = F.max(F.col("generated")).over(Window.partitionBy(*keys, "_k"))
    return own.withColumn("hint", hint).where("not generated").drop("_k")
