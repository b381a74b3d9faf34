"""Typed frames of characters, spans, words, lines and blocks, and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box():
    return [f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), ("x0", "y0", "x1", "y1"), strict=True)]


def ordered_text(text, order, separator: str = ""):
    """Texts of a group in order, joined. text: a column or its name; order: a column's name."""
    if isinstance(text, str):
        quoted = "".join("\\u%04X" % ord(c) for c in separator)
        return F.expr(f"coalesce(listagg({text}, '{quoted}') WITHIN GROUP (ORDER BY {order}), '')")
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def spaced(c="c"):
    """A character with the space before it, if there is a gap."""
    return F.concat(F.when(F.col("gap"), " ").otherwise(""), F.col(c))


def numbered(df: DataFrame) -> DataFrame:
    """line: the number of a page's line in its block."""
    return df.withColumn("line", (F.col("pline") - F.min("pline").over(Window.partitionBy("doc", "page", "block"))).cast("int"))


def words(chars: DataFrame, delimiters: str = "") -> DataFrame:
    """doc, page, block, line, word, x0, y0, x1, y1, text. Characters of `delimiters` separate words and are dropped."""
    if delimiters:
        w = Window.partitionBy("doc", "page").orderBy("gidx")
        cut = F.col("c").isin(*delimiters)
        starts = F.col("head") | F.col("gap") | F.coalesce(F.lag(cut).over(w), F.lit(False)) | cut
        chars = chars.withColumn("pword", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~cut)
    rows = chars.groupBy("doc", "page", "block", "pline", "pword").agg(*box(), ordered_text("c", "gidx").alias("text"))
    order = Window.partitionBy("doc", "page", "block", "pline").orderBy("pword")
    rows = rows.withColumn("word", (F.row_number().over(order) - 1).cast("int"))
    return numbered(rows).select("doc", "page", "block", "line", "word", "x0", "y0", "x1", "y1", "text")


def lines(chars: DataFrame) -> DataFrame:
    """doc, page, block, line, x0, y0, x1, y1, dir_x, dir_y, wmode, text."""
    rows = chars.withColumn("_t", spaced()).groupBy("doc", "page", "block", "pline").agg(*box(), F.min_by("dx", "gidx").alias("dir_x"), F.min_by("dy", "gidx").alias("dir_y"), ordered_text("_t", "gidx").alias("text"))
    return numbered(rows).select("doc", "page", "block", "line", "x0", "y0", "x1", "y1", "dir_x", "dir_y", F.lit(0).cast("tinyint").alias("wmode"), "text")


def blocks(chars: DataFrame, dehyphenate: bool = False) -> DataFrame:
    """doc, page, block, x0, y0, x1, y1, text: each line followed by a line feed; with dehyphenate, a hyphen after a
    letter at a line's end goes with its line feed."""
    return blocks_of_lines(lines(chars), dehyphenate)


def blocks_of_lines(rows: DataFrame, dehyphenate: bool = False) -> DataFrame:
    text = F.concat("text", F.lit("\n"))
    if dehyphenate:
        text = F.when((F.length("text") > 1) & F.col("text").rlike(r"\p{L}-$"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(text)
    return rows.withColumn("_t", text).groupBy("doc", "page", "block").agg(*box(), ordered_text("_t", "line").alias("text"))


def page_text(chars: DataFrame, dehyphenate: bool = False) -> DataFrame:
    """doc, page, text: blocks in order, a blank line between them."""
    return page_text_of_blocks(blocks(chars, dehyphenate))


def page_text_of_blocks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "page").agg(ordered_text("text", "block", "\n").alias("text"))


def doc_text(chars: DataFrame) -> DataFrame:
    """doc, text: pages joined by a form feed."""
    return page_text(chars).groupBy("doc").agg(ordered_text("text", "page", "\f").alias("text"))


def spans(chars: DataFrame) -> DataFrame:
    """Runs of one font, size, color and superscript flag in a line: doc, page, block, line, span, box, text, font, size,
    flags, color. flags: superscript 1, italic 2, serif 4, mono 8, bold 16."""
    c = chars.withColumn("_size", F.round("size", 3))
    w = Window.partitionBy("doc", "page", "pline").orderBy("gidx")
    same = F.lit(True)
    for k in ("font", "_size", "sup", "color"):  # a font's own flags go with the font
        same = same & (F.lag(k).over(w) == F.col(k))
    c = c.withColumn("span", (F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    c = c.withColumn("_t", spaced())
    rows = c.groupBy("doc", "page", "block", "pline", "span", "font", "color", "sup").agg(*box(), ordered_text("_t", "gidx").alias("text"), F.min_by("size", "gidx").alias("size"))
    rows = rows.withColumn("flags", style_flags(F.col("font")).bitwiseOR(F.col("sup").cast("int")))
    return numbered(rows).select("doc", "page", "block", "line", "span", "x0", "y0", "x1", "y1", "text", "font", "size", "flags", "color")


def char_frame(chars: DataFrame) -> DataFrame:
    """doc, page, block, line, char, box, text, font, size, color, origin_x, origin_y."""
    order = Window.partitionBy("doc", "page", "pline").orderBy("gidx")
    rows = chars.withColumn("char", (F.row_number().over(order) - 1).cast("int"))
    return numbered(rows).select("doc", "page", "block", "line", "char", "x0", "y0", "x1", "y1", F.col("c").alias("text"), "font", "size", "color", F.col("px").alias("origin_x"), F.col("py").alias("origin_y"))


def style_flags(font):
    """italic 2, serif 4, mono 8, bold 16 from a font's name, without its subset prefix."""
    name = F.lower(F.regexp_replace(font, r"^[A-Z]{6}\+", ""))
    bold = F.when(name.rlike("bold|black|heavy|demi"), 16).otherwise(0)
    italic = F.when(name.rlike("italic|oblique"), 2).otherwise(0)
    mono = name.rlike("mono|courier|consol|typewriter")
    sans = name.rlike("sans|arial|helvet|verdana|gothic")
    serif = F.when(~mono & ~sans & name.rlike("serif|roman|times|georgia|garamond"), 4).otherwise(0)
    return (bold + italic + F.when(mono, 8).otherwise(0) + serif).cast("int")


def dehyphenated_words(word_rows: DataFrame) -> DataFrame:
    """Words; one that ends a line with a letter and a hyphen takes the text of the first word of the next line of its
    block, which is dropped. Box and numbers of the first half stay. A chain goes on while its parts are whole lines."""
    w = Window.partitionBy("doc", "page", "block").orderBy("line", "word")
    opens = F.col("text").rlike(r"\p{L}-$")
    r = word_rows.withColumn("_join", (F.lag(opens).over(w)) & (F.col("word") == 0) & (F.lag("line").over(w) == F.col("line") - 1))
    r = r.withColumn("_join", F.coalesce("_join", F.lit(False))).withColumn("_group", F.sum((~F.col("_join")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_next", F.coalesce(F.lead("_join").over(w), F.lit(False)))
    part = F.when(F.col("_next"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    first = lambda c: F.min_by(c, F.struct("line", "word")).alias(c)
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "word", part.alias("t")))), lambda x: x["t"]), "")
    out = r.groupBy("doc", "page", "block", "_group").agg(*[first(c).alias(f"f_{c}") for c in ("line", "word", "x0", "y0", "x1", "y1")], pieces.alias("text"))
    return out.select("doc", "page", "block", *[F.col(f"f_{c}").alias(c) for c in ("line", "word", "x0", "y0", "x1", "y1")], "text")
