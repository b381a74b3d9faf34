"""Positioned exports of pages as strings: hOCR, ALTO, XHTML, XML, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.geometry import pixels
from papyrine.functions.text import clean, escape_html, trimmed
from papyrine.operators.frames import box, ordered_text


def _bbox(dpi: float):
    return F.concat_ws(" ", *[pixels(F.col(c), dpi).cast("string") for c in ("x0", "y0", "x1", "y1")])


def hocr(words: DataFrame, dpi: float = 72.0) -> DataFrame:
    """doc, page, hocr: ocr_line and ocrx_word spans with pixel boxes."""
    word = F.concat(F.lit('<span class="ocrx_word" title="bbox '), _bbox(dpi), F.lit('; x_wconf 100">'), escape_html(F.col("text")), F.lit("</span>"))
    lines = words.groupBy("doc", "page", "block", "line").agg(*box(), ordered_text(word, "word", " ").alias("body"))
    line = F.concat(F.lit('<span class="ocr_line" title="bbox '), _bbox(dpi), F.lit('">'), F.col("body"), F.lit("</span>"))
    areas = lines.groupBy("doc", "page", "block").agg(*box(), ordered_text(line, "line", "\n").alias("body"))
    area = F.concat(F.lit('<div class="ocr_carea" title="bbox '), _bbox(dpi), F.lit('">\n'), F.col("body"), F.lit("\n</div>"))
    return areas.groupBy("doc", "page").agg(ordered_text(area, "block", "\n").alias("hocr"))


def alto(words: DataFrame) -> DataFrame:
    """doc, page, alto: TextBlock, TextLine and String elements; positions in whole points; SP between words."""
    at = F.format_string('HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d"', *[F.bround(c).cast("int") for c in (F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))])
    word = F.concat(F.lit("<String "), at, F.lit(' CONTENT="'), escape_html(F.col("text")), F.lit('"/>'))
    lines = words.groupBy("doc", "page", "block", "line").agg(*box(), ordered_text(word, "word", "<SP/>").alias("body"))
    line = F.concat(F.lit("<TextLine "), at, F.lit(">"), F.col("body"), F.lit("</TextLine>"))
    areas = lines.groupBy("doc", "page", "block").agg(*box(), ordered_text(line, "line").alias("body"))
    area = F.concat(F.lit("<TextBlock "), at, F.lit(">"), F.col("body"), F.lit("</TextBlock>"))
    return areas.groupBy("doc", "page").agg(ordered_text(area, "block").alias("alto"))


def html(lines: DataFrame) -> DataFrame:
    """doc, page, html: a paragraph at each line's place."""
    p = F.concat(F.format_string('<p style="left:%dpt;top:%dpt">', F.floor("x0"), F.floor("y0")), escape_html(F.col("text")), F.lit("</p>"))
    rows = lines.withColumn("_o", F.struct("block", "line"))
    return rows.groupBy("doc", "page").agg(ordered_text(p, "_o", "\n").alias("html"))


def xml(spans: DataFrame) -> DataFrame:
    """doc, page, xml: lines of font runs."""
    run = F.concat(F.lit('<font name="'), F.col("font"), F.lit('">'), escape_html(F.col("text")), F.lit("</font>"))
    lines = spans.groupBy("doc", "page", "block", "line").agg(ordered_text(run, "span").alias("body"))
    rows = lines.withColumn("_o", F.struct("block", "line"))
    return rows.groupBy("doc", "page").agg(ordered_text(F.concat(F.lit("<line>"), F.col("body"), F.lit("</line>")), "_o", "\n").alias("xml"))


def page_json(words: DataFrame) -> DataFrame:
    """doc, page, json: the page's words as an array of objects."""
    rows = words.withColumn("_o", F.struct("block", "line", "word"))
    item = F.struct("x0", "y0", "x1", "y1", "text", "block", "line", "word")
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), item.alias("i")))), lambda x: x["i"])
    return rows.groupBy("doc", "page").agg(F.to_json(items).alias("json"))


def page_dict(spans: DataFrame) -> DataFrame:
    """doc, page, json: blocks of lines of spans, each with its box, as nested objects."""
    corners = lambda: F.array("x0", "y0", "x1", "y1").alias("bbox")
    listed = lambda order, item, name: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda x: x["i"]).alias(name)
    lines = spans.groupBy("doc", "page", "block", "line").agg(*box(), listed("span", F.struct(corners(), "text", "font", "size", "flags", "color"), "spans"))
    blocks = lines.groupBy("doc", "page", "block").agg(*box(), listed("line", F.struct(corners(), "spans"), "lines"))
    return blocks.groupBy("doc", "page").agg(F.to_json(listed("block", F.struct(F.lit(0).alias("type"), corners(), "lines"), "b")).alias("json"))


def overlay(layers: dict[str, DataFrame]) -> DataFrame:
    """doc, page, layer, box of frames by name, and `order` arrows from the centre of each block to the next."""
    out = None
    for name, rows in layers.items():
        own = rows.select("doc", "page", F.lit(name).alias("layer"), "x0", "y0", "x1", "y1")
        out = own if out is None else out.unionByName(own)
    if "blocks" in layers:
        w = Window.partitionBy("doc", "page").orderBy("block")
        mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        arrows = layers["blocks"].select("doc", "page", F.lit("order").alias("layer"), mx.alias("x0"), my.alias("y0"), F.lead(mx).over(w).alias("x1"), F.lead(my).over(w).alias("y1"))
        out = out.unionByName(arrows.where("x1 is not null"))
    return out


def plain_text(blocks: DataFrame) -> DataFrame:
    """doc, page, text: cleaned lines without white space at their ends, a blank line between blocks."""
    lines = F.transform(F.split(F.regexp_replace("text", "\n+$", ""), "\n"), lambda x: F.regexp_replace(clean(x), r"[ \t\n\r\f\x0B]+$", ""))
    body = F.regexp_replace(F.array_join(lines, "\n"), r"[ \t\n\r\f\x0B]+$", "")
    joined = blocks.withColumn("_t", F.concat(body, F.lit("\n\n"))).groupBy("doc", "page").agg(ordered_text("_t", "block").alias("text"))
    return joined.withColumn("text", trimmed(F.col("text")))


def scripts(spans: DataFrame) -> DataFrame:
    """Spans with script: super or sub for short, small ones off the baseline of the line's main span, else ''."""
    w = Window.partitionBy("doc", "page", "block", "line")
    text = trimmed(F.col("text"))
    weight = F.when(text != "", F.struct((F.length(text) * F.col("size")).alias("w"), "size", (-F.col("span")).alias("o"), "base"))
    rows = spans.withColumn("base", F.col("y1") - 0.2 * F.col("size")).withColumn("n", F.count(F.when(text != "", 1)).over(w)).withColumn("main", F.max(weight).over(w))
    rise, size = F.col("main.base") - F.col("base"), F.col("main.size")
    small = (text != "") & (F.col("n") >= 2) & (F.col("main.o") != -F.col("span")) & (F.length(text) <= 6) & (F.col("size") <= 0.85 * size)
    return rows.withColumn("script", F.when(small & (rise >= 0.15 * size), "super").when(small & (-rise >= 0.08 * size), "sub").otherwise("")).drop("base", "n", "main")
