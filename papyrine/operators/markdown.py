"""From HTML pages to elements, Markdown, heading paths and retrieval chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import WS, escape_markdown, trimmed

#: What is no text of a page, tags that begin an element, and tags that end one; all others stand inside a line.
_HIDDEN = r"(?is)<!--.*?-->|<(?:script|style|title)\b.*?</(?:script|style|title)\s*>"
_OPENS = r"(?i)<(h[1-6]|p|li)\b[^>]*>"
_ENDS = r"(?i)</?(?:h[1-6]|p|li|ul|ol|dl|div|article|section|nav|header|footer|main|aside|body|html|head|table|tr|td|th|pre|blockquote|form|hr)\b[^>]*>"
_ELEMENT = r"(?i)\x01(h[1-6]|p|li)\x02([^\x01\x03]*)"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc, ord, type, level, text, md: headings, list items and paragraphs of a page, in order, with all the text up to the
    next element's start or end; tags inside a line are dropped."""
    html = F.regexp_replace(F.regexp_replace(html_col, _HIDDEN, ""), "[\\x01-\\x03]", " ")
    html = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\b[^>]*>", "\n"), _OPENS, "\x01$1\x02")
    html = F.regexp_replace(F.regexp_replace(html, _ENDS, "\x03"), "<[^>]*>", "")
    for a, b in _ENTITIES:
        html = F.replace(html, F.lit(a), F.lit(b))
    own, pat = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("doc"), html.alias("h")), F.lit(_ELEMENT)
    found = F.arrays_zip(F.transform(F.regexp_extract_all("h", pat, F.lit(1)), F.lower).alias("tag"), F.regexp_extract_all("h", pat, F.lit(2)).alias("text"))
    rows = own.select("doc", F.posexplode(found).alias("ord", "e"))
    rows = rows.select("doc", "ord", F.col("e.tag").alias("tag"), F.regexp_replace(trimmed(F.col("e.text")), rf"{WS}+", " ").alias("text")).where("text != ''")
    level = F.when(F.startswith("tag", F.lit("h")), F.substring("tag", 2, 1).cast("int")).otherwise(0)
    kind = F.when(level > 0, "heading").when(F.col("tag") == "li", "list_item").otherwise("paragraph")
    body = escape_markdown(F.col("text"))
    md = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), body)).when(F.col("tag") == "li", F.concat(F.lit("- "), body)).otherwise(body)
    return rows.select("doc", "ord", kind.alias("type"), level.alias("level"), "text", md.alias("md"))


def to_markdown(els: DataFrame) -> DataFrame:
    """doc, markdown: items of a list on lines of their own, other elements apart by a blank line."""
    w = Window.partitionBy("doc").orderBy("ord")
    before = F.lag("type").over(w)
    gap = F.when(before.isNull(), "").when((before == "list_item") & (F.col("type") == "list_item"), "\n").otherwise("\n\n")
    rows = els.withColumn("t", F.concat(gap, F.col("md")))
    return rows.groupBy("doc").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), ""), F.lit("\n")).alias("markdown"))


def heading_paths(els: DataFrame) -> DataFrame:
    """Adds `path`: the headings that hold an element, of rising level, joined by ' > '; of a heading, those over it."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out, names = els, []
    for k in range(1, 7):  # the last heading of level k, unless a higher one came after it
        last = F.max(F.when(F.col("level") == k, F.struct("ord", "text"))).over(w)
        higher = F.max(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("ord"))).over(w)
        out = out.withColumn(f"_l{k}", last).withColumn(f"_h{k}", higher)
        own = F.when(F.col(f"_l{k}").isNotNull() & (F.coalesce(F.col(f"_h{k}"), F.lit(-1)) < F.col(f"_l{k}.ord")) & ((F.col("level") == 0) | (F.col("level") > k)), F.col(f"_l{k}.text"))
        names.append(own)
    out = out.withColumn("path", F.concat_ws(" > ", *names))
    return out.drop(*[f"_{a}{k}" for a in "lh" for k in range(1, 7)])


def split_sentences(text: str, most: int) -> list[str]:
    """Whole sentences packed into pieces of at most `most` characters; longer sentences are cut."""
    pieces: list[str] = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        cuts = [s[k : k + most] for k in range(0, len(s), most)] or [""]
        for n, c in enumerate(cuts):
            fits = pieces and n == 0 and len(cuts) == 1 and len(pieces[-1]) + 1 + len(c) <= most
            if fits:
                pieces[-1] = f"{pieces[-1]} {c}".strip()
            elif c.strip():
                pieces.append(c.strip() if len(cuts) == 1 else c)
    return pieces


def pack(rows: list[tuple], max_chars: int, min_chars: int, split_level: int, overlap: int) -> list[dict]:
    """rows: (type, level, text, md, path). Greedy chunks, cut before high headings and where they would be too long."""
    out: list[dict] = []
    held: list[tuple] = []

    def flush() -> None:
        body = ""
        for k, (kind, _, _, md, _) in enumerate(held):
            body += ("" if not k else "\n" if kind == held[k - 1][0] == "list_item" else "\n\n") + md
        kind, _, text, _, path = held[0]
        heads = [p for p in [path, text if kind == "heading" else ""] if p]
        out.append({"chunk": len(out), "headings": " > ".join(heads), "text": (path + "\n\n" if path else "") + body, "chars": len(body)})

    for kind, level, text, md, path in rows:
        parts = [(kind, level, text, md, path)]
        if kind == "paragraph" and len(md) > max_chars:
            parts = [(kind, level, s, s, path) for s in split_sentences(md, max_chars)]
        for p in parts:
            size = sum(len(x[3]) + 2 for x in held)
            section = p[0] == "heading" and p[1] <= split_level
            if held and ((section and size >= min_chars) or size + len(p[3]) > max_chars):
                flush()
                held = [(*x[:4], p[4]) for x in (held[-overlap:] if overlap else []) if x[0] != "heading"]
            held.append(p)
    if held:
        flush()
    return out


def chunks(els: DataFrame, max_chars: int = 2000, min_chars: int = 200, split_level: int = 2, overlap: int = 0) -> DataFrame:
    """doc, chunk, headings, text, chars. The running size has resets, so a document's elements are packed in pandas; they
    stream, sorted, and one document is held at a time."""
    rows = heading_paths(els).select("doc", "ord", "type", "level", "text", "md", "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, held = None, []

        def done() -> pd.DataFrame:
            got = pd.DataFrame(pack(held, max_chars, min_chars, split_level, overlap))
            return got.assign(doc=doc)[["doc", "chunk", "headings", "text", "chars"]]

        for frame in frames:
            for r in frame.itertuples(index=False):
                if held and r.doc != doc:
                    yield done()
                    held = []
                doc = r.doc
                held.append((r.type, r.level, r.text, r.md, r.path))
        if held:
            yield done()

    return rows.repartition("doc").sortWithinPartitions("doc", "ord").mapInPandas(run, "doc long, chunk int, headings string, text string, chars int")
