"""From laid-out lines and spans to headings, lists, paragraphs and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import PAGE_NUMBER, WS, escape_html, escape_markdown, guard, list_marker, running_key, trimmed, wrap_markdown
from papyrine.operators import statistics
from papyrine.operators.frames import blocks_of_lines, ordered_text

PAGE = ["doc", "page"]
BLOCK = [*PAGE, "block"]


def block_style(spans: DataFrame) -> DataFrame:
    """doc, page, block, size, all_bold, all_mono, n: the size of most characters with its weight and pitch, the first of
    equals, and whether nine tenths of them are bold, of one pitch."""
    n = F.length(trimmed(F.col("text")))
    bold, mono = F.col("flags").bitwiseAND(16) > 0, F.col("flags").bitwiseAND(8) > 0
    rows = spans.select(*BLOCK, (F.bround(F.col("size") * 2) / 2).alias("size"), bold.alias("bold"), mono.alias("mono"), n.alias("n"), F.struct("line", "span").alias("at")).where("n > 0")
    kinds = rows.groupBy(*BLOCK, "size", "bold", "mono").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy(*BLOCK)
    total = F.sum("n").over(w)
    part = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).over(w) >= 0.9 * total
    kinds = kinds.withColumns({"all_bold": part("bold"), "all_mono": part("mono"), "total": total}).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "at")))
    return kinds.where("r = 1").select(*BLOCK, "size", "all_bold", "all_mono", F.col("total").alias("n"))


def size_levels(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, body) and (doc, level, least): the smallest size of each level of headings."""
    histogram = statistics.size_histogram(spans)
    levels = statistics.heading_levels(histogram).groupBy("doc", "level").agg(F.min("size").alias("least"))
    return statistics.body_size(histogram).select("doc", "body"), levels


def headings(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, page, block, level, source: blocks that are headings by their size or, in one bold line, by their weight."""
    body, levels = size_levels(spans)
    flat = F.regexp_replace(trimmed(F.col("text")), rf"{WS}+", " ")
    text = blocks_of_lines(lines).select(*BLOCK, flat.alias("flat"))
    count = lines.groupBy(*BLOCK).agg(F.count("*").alias("lines"), F.min(F.abs("dir_x") > 0.99).alias("horizontal"))
    rows = block_style(spans).join(text, BLOCK).join(count, BLOCK).join(body, "doc")
    top = levels.groupBy("doc").agg(F.max("level").alias("top"))
    fits = rows.select(*BLOCK, "size").join(levels, "doc").where(F.col("size") >= F.col("least") * 0.97).groupBy(*BLOCK).agg(F.min("level").alias("by_size"))
    rows = rows.join(fits, BLOCK, "left").join(top, "doc", "left")
    c = F.col
    letters = F.regexp_count("flat", F.lit(r"\p{L}")) >= 2
    short = (c("lines") <= 3) & (F.length("flat") <= 120) & ~(F.endswith("flat", F.lit(".")) & (F.length("flat") > 60))
    strong = (c("size") >= c("body") * 1.3) | c("all_bold") | ((c("lines") == 1) & ~F.endswith("flat", F.lit(".")))
    size = c("by_size").isNotNull() & strong
    marked = list_marker(c("flat"), bullets_only=True) != ""
    bold = c("all_bold") & (c("lines") == 1) & (F.length("flat") <= 60) & ~c("flat").rlike(r"[.,:;]$") & (F.abs(c("size") - c("body")) <= 0.75) & ~marked & (F.size(F.split("flat", " ")) <= 8)
    level = F.when(size, c("by_size")).when(bold, F.least(F.coalesce("top", F.lit(0)) + 1, F.lit(6)))
    rows = rows.where(c("horizontal") & letters & short).withColumn("level", level).where("level is not null")
    return rows.select(*BLOCK, c("level").cast("int").alias("level"), F.when(size, "size").otherwise("bold").alias("source"))


def list_items(lines: DataFrame) -> DataFrame:
    """doc, page, block, item, marker, level, ordered, text of blocks whose first line has a marker: an item goes on to the
    next line with one. level grows with the indent by one and a half sizes (size: of the block)."""
    w = Window.partitionBy(*BLOCK).orderBy("line")
    marker = list_marker(F.col("text"))
    rows = lines.withColumn("marker", marker).withColumn("x", F.min("x0").over(Window.partitionBy(*BLOCK)))
    rows = rows.withColumn("item", (F.sum((F.col("marker") != "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    rows = rows.withColumn("listed", F.first("marker").over(w.rowsBetween(Window.unboundedPreceding, 0)) != "").where("listed")
    own = F.when(F.col("marker") != "", F.regexp_replace(F.expr("substring(ltrim(text), length(marker) + 1)"), rf"^{WS}+", "")).otherwise(F.col("text"))
    items = rows.withColumn("t", trimmed(own)).groupBy(*BLOCK, "item").agg(
        F.max("marker").alias("marker"), F.min_by("x0", "line").alias("x0"), F.min("x").alias("x"), F.min("size").alias("size"), ordered_text("t", "line", " ").alias("text")
    )
    level = 1 + F.floor(F.greatest(F.lit(0.0), F.col("x0") - F.col("x")) / F.greatest(F.col("size") * 1.5, F.lit(6.0)))
    return items.select(*BLOCK, "item", "marker", level.cast("int").alias("level"), F.col("marker").rlike(r"[.)]$").alias("ordered"), "text")


def format_runs(spans: DataFrame) -> DataFrame:
    """doc, page, block, run, bold, italic, mono, text: spans of a block joined where their style is the same; lines join by
    a space, or without the hyphen of a broken word; blank spans go with the run before."""
    flag = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    w = Window.partitionBy(*BLOCK).orderBy("line", "span")
    first = F.col("span") == 0
    rows = spans.where("text != ''").withColumn("t", F.when(first, F.regexp_replace("text", rf"^{WS}+", "")).otherwise(F.col("text")))
    style = F.concat_ws(",", flag(16).cast("string"), flag(2).cast("string"), flag(8).cast("string"))
    blank = F.col("t").rlike(rf"^{WS}*$")
    rows = rows.withColumn("style", F.when(~blank, style))
    begun = F.last_value("style", F.lit(True)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("style", F.coalesce(begun, style))
    before = F.lag("t").over(w)
    joins = first & before.rlike(rf"\p{{L}}-{WS}*$") & F.col("t").rlike(r"^\p{Ll}")
    rows = rows.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("gap", F.when(first & before.isNotNull() & ~before.rlike(" $"), " ").otherwise(""))
    cut = F.coalesce(F.lead("joins").over(w), F.lit(False))
    piece = F.when(cut, F.regexp_replace("t", rf"-{WS}*$", "")).otherwise(F.col("t"))
    # the space between lines ends the line before it
    piece = F.concat(piece, F.coalesce(F.when(~cut, F.lead("gap").over(w)), F.lit("")))
    new = F.coalesce(F.lag("style").over(w) != F.col("style"), F.lit(True))
    rows = rows.withColumn("piece", piece).withColumn("run", (F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).withColumn("o", F.struct("line", "span"))
    return rows.groupBy(*BLOCK, "run", "style").agg(ordered_text(F.col("piece"), "o").alias("text")).select(
        *BLOCK, "run", *[(F.split("style", ",")[k] == "true").alias(c) for k, c in enumerate(("bold", "italic", "mono"))], "text"
    )


def block_markdown(spans: DataFrame) -> DataFrame:
    """doc, page, block, md: each block's runs with their styles, single spaces."""
    runs = format_runs(spans).withColumn("md", wrap_markdown(F.col("text"), F.col("bold"), F.col("italic"), F.col("mono")))
    return runs.groupBy(*BLOCK).agg(ordered_text("md", "run").alias("md")).withColumn("md", trimmed(F.regexp_replace("md", r"[ \t]+", " ")))


def running_blocks(lines: DataFrame, blocks: DataFrame, height: float, margin: float = 0.1) -> DataFrame:
    """doc, page, block in the margins that are page numbers, or of which every line runs through the document."""
    running = statistics.running_lines(lines, blocks, height, margin).select("doc", "key", "top")
    at = blocks.where((F.col("y1") <= height * margin) | (F.col("y0") >= height * (1 - margin))).select(*BLOCK, (F.col("y0") < height / 2).alias("top"), F.col("text").alias("all"))
    own = lines.join(at, BLOCK).withColumn("key", running_key(F.col("text")))
    marked = own.join(running.withColumn("runs", F.lit(True)), ["doc", "key", "top"], "left")
    by = marked.groupBy(*BLOCK).agg(F.min(F.coalesce("runs", F.lit(False))).alias("every"), F.first("all").alias("all"))
    return by.where(F.col("every") | trimmed(F.col("all")).rlike(PAGE_NUMBER)).select(*BLOCK)


def layout_elements(spans: DataFrame, lines: DataFrame, height: float) -> DataFrame:
    """doc, page, block, item, type, level, text, md: headings, list items and paragraphs of laid-out pages in content order,
    without running headers and footers."""
    blocks = blocks_of_lines(lines)
    gone = running_blocks(lines, blocks, height)
    kept = blocks.where(trimmed(F.col("text")) != "").join(gone, BLOCK, "left_anti").select(*BLOCK)
    heads = headings(spans, lines)
    sized = lines.join(block_style(spans).select(*BLOCK, "size"), BLOCK)
    items = list_items(sized).join(heads, BLOCK, "left_anti").join(kept, BLOCK, "left_semi")
    marker = F.when(F.col("ordered") & F.endswith("marker", F.lit(".")), F.col("marker")).when(F.col("ordered"), F.concat(F.regexp_replace("marker", r"^\(|\)$", ""), F.lit("."))).otherwise("-")
    listed = items.select(*BLOCK, "item", F.lit("list_item").alias("type"), "level", "text", F.concat(F.expr("repeat('  ', level - 1)"), marker, F.lit(" "), escape_markdown(F.col("text"))).alias("md"))
    flat = F.regexp_replace(trimmed(F.col("text")), rf"{WS}+", " ")
    plain = blocks.select(*BLOCK, flat.alias("text"))
    titles = heads.join(kept, BLOCK, "left_semi").join(plain, BLOCK)
    titles = titles.select(*BLOCK, F.lit(0).alias("item"), F.lit("heading").alias("type"), "level", "text", F.concat(F.expr("repeat('#', level)"), F.lit(" "), escape_markdown(F.col("text"))).alias("md"))
    rest = kept.join(heads, BLOCK, "left_anti").join(items.select(*BLOCK).distinct(), BLOCK, "left_anti")
    bodies = rest.join(plain, BLOCK).join(block_markdown(spans), BLOCK)
    bodies = bodies.select(*BLOCK, F.lit(0).alias("item"), F.lit("paragraph").alias("type"), F.lit(0).alias("level"), "text", guard(F.col("md")).alias("md"))
    return titles.unionByName(listed).unionByName(bodies)


def xhtml(els: DataFrame) -> DataFrame:
    """doc, xhtml: elements (doc, ord, type, level, text) as tags, runs of list items in a list."""
    w = Window.partitionBy("doc").orderBy("ord")
    listed = F.col("type") == "list_item"
    opens = listed & ~F.coalesce(F.lag(listed).over(w), F.lit(False))
    closes = listed & ~F.coalesce(F.lead(listed).over(w), F.lit(False))
    body = escape_html(F.col("text"))
    name = F.when(F.col("type") == "heading", F.concat(F.lit("h"), F.col("level").cast("string"))).when(listed, "li").otherwise("p")
    tag = F.concat(F.lit("<"), name, F.lit(">"), body, F.lit("</"), name, F.lit(">"))
    line = F.concat(F.when(opens, "<ul>\n").otherwise(""), tag, F.when(closes, "\n</ul>").otherwise(""))
    return els.withColumn("line", line).groupBy("doc").agg(ordered_text("line", "ord", "\n").alias("xhtml"))
