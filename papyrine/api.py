"""What users call: documents in, relations or files out. Each function takes glyphs, or files through `open`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.bidi import logical_text
from papyrine.functions.pages import select_pages
from papyrine.operators import exports, frames, order
from papyrine.plans import kernel
from papyrine.plans.layout import LayoutParams, clip, drop_overprints, group_glyphs
from papyrine.sources import pdf

KINDS = ["words", "lines", "blocks", "spans", "chars"]
FORMATS = ["hocr", "alto", "html", "xml", "json"]
MODES = ["text", "words", "blocks"]
SORTS = [None, "simple", "xycut"]


def open(spark: SparkSession, path: str, relation: str = "glyphs") -> DataFrame:  # noqa: A001
    """One relation of the PDF files at a path or glob; `path` becomes `doc`."""
    files = spark.read.format("binaryFile").load(path)
    return pdf.read_pdf(files, relation).withColumnRenamed("path", "doc")


def chars(glyphs: DataFrame, box: tuple[float, float, float, float] | None = None, params: LayoutParams = LayoutParams()) -> DataFrame:
    """Grouped characters, without overprints, of the glyphs that touch `box`."""
    glyphs = drop_overprints(glyphs, params)
    return group_glyphs(glyphs if box is None else clip(glyphs, box, params), params)


def records(glyphs: DataFrame, kind: str = "words", **options) -> DataFrame:
    """A typed frame of one of KINDS."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(KINDS)}")
    made = {"words": frames.words, "lines": frames.lines, "blocks": frames.blocks, "spans": frames.spans, "chars": frames.char_frame}
    return made[kind](chars(glyphs, **options))


def get_text(glyphs: DataFrame, mode: str = "text", sort: str | None = None, dehyphenate: bool = False, delimiters: str = "", box=None) -> DataFrame:
    """Text by page, words or blocks; blocks and text in a reading order."""
    if mode not in MODES or sort not in SORTS:
        raise ValueError(f"mode is one of {MODES}, sort one of {SORTS}")
    own = drop_overprints(glyphs)
    own = own if box is None else clip(own, box)
    if mode == "words":
        words = frames.words(group_glyphs(own), delimiters) if delimiters else kernel.words(own)
        return frames.dehyphenated_words(words) if dehyphenate else words
    lines = kernel.lines(own)
    rows = frames.blocks_of_lines(lines.withColumn("text", logical_text(F.col("text"))), dehyphenate)
    rows = {None: lambda b: b.withColumn("place", F.col("block")), "simple": order.simple, "xycut": order.xy_cut}[sort](rows)
    if mode == "blocks":
        return rows
    return rows.groupBy("doc", "page").agg(frames.ordered_text("text", "place", "\n").alias("text"))


def export(glyphs: DataFrame, fmt: str, **options) -> DataFrame:
    """doc, page and the page in one of FORMATS."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    own = chars(glyphs)
    if fmt in ("html", "xml"):
        return exports.html(frames.lines(own)) if fmt == "html" else exports.xml(frames.spans(own))
    made = {"hocr": exports.hocr, "alto": exports.alto, "json": exports.page_json}
    return made[fmt](frames.words(own), **options)


def to_parquet(glyphs: DataFrame, path: str, kind: str = "words", compression: str = "zstd") -> str:
    records(glyphs, kind).write.option("compression", compression).parquet(path)
    return path


def to_csv(glyphs: DataFrame, path: str, kind: str = "words") -> str:
    records(glyphs, kind).write.option("header", True).csv(path)
    return path


def to_jsonl(glyphs: DataFrame, path: str, kind: str = "words") -> str:
    records(glyphs, kind).write.json(path)
    return path


def to_arrow(glyphs: DataFrame, kind: str = "words") -> pa.Table:
    """A frame as one Arrow table in the driver; for documents that fit there."""
    return records(glyphs, kind).toArrow()


def to_pandas(glyphs: DataFrame, kind: str = "words") -> pd.DataFrame:
    return records(glyphs, kind).toPandas()


def words_array(glyphs: DataFrame) -> dict[str, np.ndarray]:
    """Words column by column."""
    table = to_arrow(glyphs)
    return {c: table[c].to_numpy() for c in table.column_names}


def iter_pages(glyphs: DataFrame, pages: str | None = None) -> Iterator[tuple]:
    """(doc, page, text), document by document, in page order or the order of a selection; one partition at a time comes to
    the driver."""
    text = get_text(glyphs).select("doc", "page", "text")
    if pages is None:
        return ((r.doc, r.page, r.text) for r in text.orderBy("doc", "page").toLocalIterator())
    asked = select_pages(glyphs.select("doc", "page").distinct(), pages)
    rows = asked.join(text, ["doc", "page"], "left").orderBy("doc", "sel_ord")
    return ((r.doc, r.page, r.text or "") for r in rows.toLocalIterator())


def iter_texts(glyphs: DataFrame, pages: str | None = None) -> Iterator[dict]:
    """Records as loaders of retrieval libraries take them: a page's text and where it is from."""
    for doc, page, text in iter_pages(glyphs, pages):
        yield {"page_content": text, "metadata": {"source": doc, "page": page}}


def page_count(glyphs: DataFrame) -> DataFrame:
    """doc, pages: how many pages each document has, as far as its last one with text."""
    return glyphs.groupBy("doc").agg((F.max("page") + 1).alias("pages"))
