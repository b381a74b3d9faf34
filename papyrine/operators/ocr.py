"""Runs of an OCR engine as characters and words. Engines are callables outside; their results come as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_words(runs: DataFrame, dpi: float = 72.0, min_conf: float | None = None, clip: tuple[float, float, float, float] | None = None) -> DataFrame:
    """doc, page, run, word, x0, y0, x1, y1, text, conf from runs (doc, page, run, text, conf, x0, y0, x1, y1 in pixels).

    A run's characters share its width evenly. Blank runs, runs without area and those under min_conf go; a null conf stays.
    With clip, words are kept whose centre lies in it.
    """
    scale = 72.0 / dpi
    box = {c: F.col(c) * scale for c in ("x0", "y0", "x1", "y1")}
    rows = runs.where("trim(text) != '' and x1 > x0 and y1 > y0")
    if min_conf is not None:
        rows = rows.where(F.col("conf").isNull() | (F.col("conf") >= min_conf))
    rows = rows.withColumns(box)
    chars = rows.select("doc", "page", "run", "conf", "x0", "y0", "x1", "y1", F.length("text").alias("n"), F.posexplode(F.split("text", "")).alias("i", "c")).where("c != ''")
    w = Window.partitionBy("doc", "page", "run").orderBy("i")
    chars = chars.withColumn("gap", F.col("c").rlike(r"^[ \t\n\r]$")).withColumn("word", F.sum(F.col("gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not gap")
    step = (F.col("x1") - F.col("x0")) / F.col("n")
    text = F.expr("listagg(c, '') WITHIN GROUP (ORDER BY i)")
    words = chars.groupBy("doc", "page", "run", "word").agg(F.min(F.col("x0") + step * F.col("i")).alias("x0"), F.min("y0").alias("y0"), F.max(F.col("x0") + step * (F.col("i") + 1)).alias("x1"), F.max("y1").alias("y1"), text.alias("text"), F.first("conf").alias("conf"))
    order = Window.partitionBy("doc", "page", "run").orderBy("word")
    words = words.withColumn("word", (F.row_number().over(order) - 1).cast("int"))
    if clip is not None:
        mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        words = words.where(mx.between(clip[0], clip[2]) & my.between(clip[1], clip[3]))
    return words


def page_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy("doc", "page").agg(F.bround(F.avg("conf"), 4).alias("conf"))


def engine_lines(words: DataFrame) -> DataFrame:
    """doc, page, block, line, box, text of words with an engine's own numbers of blocks and lines, left to right."""
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word", "text"))), lambda x: x["text"]), " ")
    return words.groupBy("doc", "page", "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), t.alias("text"))
