"""Statistics of documents and pages: sizes, headings, running lines, quality, coverage, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import GARBLED, WS, running_key, trimmed


def size_histogram(spans: DataFrame) -> DataFrame:
    """doc, size (to half points), n characters, first place."""
    place = F.struct("page", "block", "line", "span")
    n = F.length(trimmed(F.col("text")))
    rows = spans.select("doc", (F.bround(F.col("size") * 2) / 2).alias("size"), n.alias("n"), place.alias("place")).where("n > 0")
    return rows.groupBy("doc", "size").agg(F.sum("n").alias("n"), F.min("place").alias("place"))


def body_size(histogram: DataFrame) -> DataFrame:
    """doc, body: the size with most characters, the first to occur of equals."""
    w = Window.partitionBy("doc").orderBy(F.desc("n"), "place")
    return histogram.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc", F.col("size").alias("body"), F.col("n").cast("long").alias("n"))


def heading_levels(histogram: DataFrame, factor: float = 1.15, share: float = 0.2) -> DataFrame:
    """doc, size, level: sizes well over the body's and rare; sizes within 5 % of the next larger share a level."""
    whole = Window.partitionBy("doc")
    big = histogram.join(body_size(histogram).select("doc", "body"), "doc").withColumn("all", F.sum("n").over(whole))
    big = big.where((F.col("size") >= F.col("body") * factor) & (F.col("n") / F.col("all") < share))
    w = whole.orderBy(F.desc("size"))
    step = F.coalesce(F.col("size") < F.lag("size").over(w) * 0.95, F.lit(True)).cast("int")
    out = big.withColumn("level", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return out.where("level <= 4").select("doc", "size", "level")


def running_lines(lines: DataFrame, blocks: DataFrame, height: float, margin: float = 0.1) -> DataFrame:
    """doc, key, top, pages: lines of blocks in the margins that recur, digits apart, on 2 in 5 pages of at least 3."""
    at = blocks.where((F.col("y1") <= height * margin) | (F.col("y0") >= height * (1 - margin))).select("doc", "page", "block", (F.col("y0") < height / 2).alias("top"))
    pages = blocks.groupBy("doc").agg(F.countDistinct("page").alias("n")).where("n >= 3")
    keys = lines.join(at, ["doc", "page", "block"]).select("doc", "page", running_key(F.col("text")).alias("key"), "top").where("key != ''").distinct()
    counts = keys.groupBy("doc", "key", "top").agg(F.count("*").alias("pages"))
    return counts.join(pages, "doc").where(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n") * 0.4 + 0.5))).select("doc", "key", "top", "pages")


def repeated_headings(lines: DataFrame, document: int = 2, page: int = 1) -> DataFrame:
    """doc, text, n, most: texts that occur over `document` times in a document or over `page` times on a page."""
    per = lines.groupBy("doc", "page", "text").agg(F.count("*").alias("n"))
    return per.groupBy("doc", "text").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where((F.col("n") > document) | (F.col("most") > page))


def quality_report(chars: DataFrame, garbled_max: float = 0.1) -> DataFrame:
    """doc, page, chars, garbled_ratio, score, needs_ocr, reasons, fonts of the text layer."""
    seen = chars.where(~F.col("c").rlike(rf"^{WS}$"))
    fonts = seen.groupBy("doc", "page", "font").agg(F.count("*").alias("n"), F.count_if(F.col("c").rlike(GARBLED)).alias("bad"))
    rows = fonts.groupBy("doc", "page").agg(F.sum("n").alias("chars"), F.sum("bad").alias("bad"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "font"))), lambda x: x["font"]).alias("fonts"))
    ratio = F.col("bad") / F.col("chars")
    score = F.bround(F.greatest(F.lit(0.0), 1.0 - ratio / (garbled_max * 5)), 4)
    return rows.select("doc", "page", "chars", F.bround(ratio, 4).alias("garbled_ratio"), score.alias("score"), (ratio > garbled_max).alias("needs_ocr"), F.when(ratio > garbled_max, "garbled_text").otherwise("").alias("reasons"), F.array_join("fonts", ",").alias("fonts"))


def coverage_profile(words: DataFrame, step: float = 5.0) -> DataFrame:
    """doc, page, bin, rows: how many lines of a page cover each bin of x, each line once."""
    bins = F.sequence(F.floor(F.col("x0") / step).cast("int"), F.floor(F.col("x1") / step).cast("int"))
    spread = words.select("doc", "page", "block", "line", F.explode(bins).alias("bin")).distinct()
    return spread.groupBy("doc", "page", "bin").agg(F.count("*").alias("rows"))


def corridors(profile: DataFrame, allowed: int = 0, least: int = 2) -> DataFrame:
    """doc, page, start, stop: runs of bins inside the text that at most `allowed` lines cover, `least` bins or wider."""
    ends = profile.groupBy("doc", "page").agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    every = ends.select("doc", "page", F.explode(F.sequence("a", "b")).alias("bin")).join(profile, ["doc", "page", "bin"], "left")
    low = every.where(F.coalesce("rows", F.lit(0)) <= allowed)
    w = Window.partitionBy("doc", "page").orderBy("bin")
    low = low.withColumn("run", F.col("bin") - F.row_number().over(w))
    return low.groupBy("doc", "page", "run").agg(F.min("bin").alias("start"), F.max("bin").alias("stop"), F.count("*").alias("n")).where(F.col("n") >= least).select("doc", "page", "start", "stop")


def multiset_f1(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc, f1, recall of tokens (doc, token) found in a against those of b."""
    count = lambda df, c: df.groupBy("doc", "token").agg(F.count("*").alias(c))
    both = count(a, "n").join(count(b, "m"), ["doc", "token"], "full").na.fill(0, ["n", "m"])
    sums = both.groupBy("doc").agg(F.sum(F.least("n", "m")).alias("i"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    return sums.select("doc", (2 * F.col("i") / (F.col("n") + F.col("m"))).alias("f1"), F.when(F.col("m") > 0, F.col("i") / F.col("m")).otherwise(1.0).alias("recall"))


def page_quality(glyphs: DataFrame, images: DataFrame, pages: DataFrame, garbled_max: float = 0.1, image_min: float = 0.5, ocr_layer_ok: bool = True) -> DataFrame:
    """doc, page, chars, invisible_ratio, unicode_error_ratio, garbled_ratio, image_coverage, images, score, needs_ocr, reasons
    of pages (doc, page, width, height): whether a page's text layer can be used.

    glyphs: doc, page, c, invisible, unmapped, font; images: doc, page and a box, clipped to the page.
    """
    seen = glyphs.where(~F.col("c").isin(" ", "\t", "\n", "\r", "\u00a0"))
    bad = F.col("unmapped") | F.col("c").rlike(GARBLED)
    text = seen.groupBy("doc", "page").agg(
        F.count("*").alias("chars"), F.count_if("invisible").alias("invisible"), F.count_if("unmapped").alias("unmapped"), F.count_if(bad).alias("garbled"), F.max(F.contains(F.lower("font"), F.lit("glyphless"))).alias("glyphless")
    )
    side = lambda a, b, most: F.greatest(F.lit(0.0), F.least(F.col(b), F.col(most)) - F.greatest(F.col(a), F.lit(0.0)))
    cover = side("x0", "x1", "width") * side("y0", "y1", "height") / F.greatest(F.col("width") * F.col("height"), F.lit(1e-9))
    shown = images.join(pages, ["doc", "page"]).groupBy("doc", "page").agg(F.count("*").alias("images"), F.least(F.max(cover), F.lit(1.0)).alias("cover"))
    rows = pages.join(text, ["doc", "page"], "left").join(shown, ["doc", "page"], "left").na.fill(0, ["chars", "invisible", "unmapped", "garbled", "images"]).na.fill(0.0, ["cover"]).na.fill(False, ["glyphless"])
    c = F.col
    part = lambda name: F.when(c("chars") > 0, c(name) / c("chars")).otherwise(0.0)
    some, layer = c("chars") > 0, part("invisible") > 0.5
    little = some & (c("chars") - c("invisible") < 20) & (c("cover") >= image_min) & ~layer
    garbled, unmapped = some & (part("garbled") > garbled_max), some & (part("unmapped") > garbled_max)
    empty = ~some & (c("images") > 0)
    said = [(empty, "no_text_layer"), (~some & (c("images") == 0), "empty_page"), (some & layer, "ocr_layer"), (garbled, "garbled_text"), (unmapped, "unicode_map_errors"), (some & c("glyphless"), "glyphless_font"), (little, "scan_with_little_text")]
    said += [(c("cover") >= 0.9, "full_page_image"), ((c("cover") >= image_min) & (c("cover") < 0.9), "large_image")]
    needs = empty | garbled | unmapped | little
    if not ocr_layer_ok:
        needs = needs | (some & layer)
    score = F.when(some, F.greatest(F.lit(0.0), 1.0 - F.greatest(part("garbled"), part("unmapped")) / max(garbled_max * 5, 1e-9))).otherwise(0.0)
    score = F.when(little, F.least(score, F.lit(0.2))).otherwise(score)
    reasons = F.concat_ws(",", *[F.when(when, name) for when, name in said])
    ratio = lambda name, of: F.bround(part(of), 4).alias(name)
    return rows.select("doc", "page", "chars", ratio("invisible_ratio", "invisible"), ratio("unicode_error_ratio", "unmapped"), ratio("garbled_ratio", "garbled"), F.bround("cover", 4).alias("image_coverage"), "images", F.bround(score, 4).alias("score"), needs.alias("needs_ocr"), reasons.alias("reasons"))


def needs_ocr(quality: DataFrame) -> DataFrame:
    """doc, pages: the pages of a document that need OCR, as text."""
    return quality.where("needs_ocr").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda x: x.cast("string")), ",").alias("pages"))


def page_body(spans: DataFrame) -> DataFrame:
    """doc, page, body: the size, to a tenth, of most of a page's characters, the first of equals."""
    n = F.length(trimmed(F.col("text")))
    rows = spans.select("doc", "page", F.round("size", 1).alias("size"), n.alias("n"), F.struct("block", "line", "span").alias("at")).where("n > 0")
    sums = rows.groupBy("doc", "page", "size").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy("doc", "page").orderBy(F.desc("n"), "at")
    return sums.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc", "page", F.col("size").alias("body"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the value in the middle of each group, the upper of two."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return placed.where("_r = floor(_n / 2) + 1").select(*keys, F.col(value).alias("median"))


def clusters(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, mean, n: sorted values cut where one is over `tolerance` from the one before."""
    w = Window.partitionBy(*keys).orderBy(value)
    new = F.coalesce(F.col(value) - F.lag(value).over(w) > tolerance, F.lit(True))
    own = rows.withColumn("_k", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*keys, "_k").agg(F.avg(value).alias("mean"), F.count("*").alias("n")).drop("_k")


def concordance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, concordance: part of the pairs of a group whose two orders (a, b) agree; 1 for fewer than two rows."""
    other = rows.select(*keys, F.col("a").alias("a2"), F.col("b").alias("b2"))
    wrong = rows.join(other, keys).where("a < a2 and b > b2").groupBy(*keys).agg(F.count("*").alias("wrong"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(wrong, keys, "left")
    return n.select(*keys, F.when(F.col("n") < 2, 1.0).otherwise(1.0 - F.coalesce("wrong", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("concordance"))


def agreement(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, agreement: part of the neighbours of a group that both groupings (a, b) either join or part; 1 for one row."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = lambda c: F.lag(c).over(w) == F.col(c)
    own = rows.withColumn("_same", F.when(F.lag("a").over(w).isNotNull(), (same("a") == same("b")).cast("int")))
    return own.groupBy(*keys).agg(F.coalesce(F.avg("_same"), F.lit(1.0)).alias("agreement"))


def sampled(pages: DataFrame, most: int = 60) -> DataFrame:
    """Pages (doc, page) of long documents thinned out evenly: every n-th, so that fewer than twice `most` are left."""
    w = Window.partitionBy("doc")
    rows = pages.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("page")) - 1)
    step = F.when(F.col("_n") > most, F.floor(F.col("_n") / most)).otherwise(1)
    return rows.where(F.col("_r") % step == 0).drop("_n", "_r")
