"""A deterministic typeset view of plain text: one row per glyph, in content order.

Each line of a text is a paragraph, set in rows of COLUMNS characters, PAGE_ROWS rows to a page. Spaces leave a gap and
no glyph. The first paragraph is a heading (larger, bold); digits in the body are raised and small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS, PAGE_ROWS = 80, 50
LEFT, TOP, LEADING, PARAGRAPH_GAP = 72.0, 72.0, 12.0, 8.0
BODY_SIZE, BODY_ADVANCE, HEAD_SIZE, HEAD_ADVANCE = 10.0, 5.0, 14.0, 7.0
RAISED_SIZE, RISE = 6.0, 3.0
ASCENT, DESCENT = 0.8, -0.2
PAGE_WIDTH, PAGE_HEIGHT = 720.0, 1200.0


def read_typeset(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, page, gidx, c, px, py (pen start), qx, qy (pen end), dx, dy (direction), size, font, color.

    Texts are dealt by their id before they are laid out: a text is some fifty times smaller than its glyphs, and every
    window and group over (doc, page) that follows keeps this partitioning. A null text has no glyphs.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(id_col, text_col).repartition(parts, id_col)
    row = lambda s, para, j: F.struct(para.alias("para"), F.substring(s, j * COLUMNS + 1, COLUMNS).alias("s"))
    rows_of = lambda s, para: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(s) - 1) / COLUMNS)).cast("int")), lambda j: row(s, para, j))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.flatten(F.transform(F.split(text_col, "\n", -1), rows_of)).alias("rows"))
    rows = rows.select("doc", "rows", F.posexplode("rows").alias("r", "row"))
    page = F.floor(F.col("r") / PAGE_ROWS).cast("int")
    rows = rows.select("doc", page.alias("page"), "r", F.col("row.para").alias("para"), F.col("row.s").alias("s"), F.element_at("rows", page * PAGE_ROWS + 1)["para"].alias("first"))
    glyphs = rows.select("doc", "page", "r", "para", "first", F.posexplode(F.split("s", "", -1)).alias("col", "c")).where("c != '' and c != ' '")
    head = F.col("para") == 0
    raised = ~head & F.col("c").between("0", "9")
    advance = F.when(head, HEAD_ADVANCE).otherwise(BODY_ADVANCE)
    px = F.lit(LEFT) + advance * F.col("col")
    py = F.lit(TOP) + F.lit(LEADING) * (F.col("r") % PAGE_ROWS) + F.lit(PARAGRAPH_GAP) * (F.col("para") - F.col("first")) - F.when(raised, RISE).otherwise(0.0)
    return glyphs.select(
        "doc",
        "page",
        (F.col("r") * COLUMNS + F.col("col")).cast("long").alias("gidx"),
        "c",
        px.alias("px"),
        py.alias("py"),
        (px + advance).alias("qx"),
        py.alias("qy"),
        F.lit(1.0).alias("dx"),
        F.lit(0.0).alias("dy"),
        F.when(head, HEAD_SIZE).when(raised, RAISED_SIZE).otherwise(BODY_SIZE).alias("size"),
        F.when(head, "Sans-Bold").otherwise("Serif").alias("font"),
        F.lit(0).cast("long").alias("color"),
    )


#: Glyphs that are set at a time, in whole pages.
GLYPHS = 100_000


def glyph_tables(batches: Iterator[pa.RecordBatch], least: int = GLYPHS) -> Iterator[pa.Table]:
    """The glyphs of `read_typeset`, in order, from batches of (id, text); each table ends where a page ends. Adds code, the
    glyph's code point. Rows of a page are strings, so a long text is never held as glyphs in whole."""
    for batch in batches:
        ids, rows, size = batch.column(0), [], 0
        for k, text in enumerate(batch.column(1).to_pylist()):
            r = first = 0
            for para, line in enumerate(text.split("\n") if text is not None else ()):
                for j in range(0, max(len(line), 1), COLUMNS):
                    if r % PAGE_ROWS == 0:
                        first = para
                        if size >= least:
                            yield _glyphs(ids, rows)
                            rows, size = [], 0
                    s = line[j : j + COLUMNS]
                    if s.strip(" "):
                        rows.append((s, k, r, para, first))
                        size += len(s)
                    r += 1
        if rows:
            yield _glyphs(ids, rows)


def _glyphs(ids: pa.Array, rows: list[tuple]) -> pa.Table:
    texts, *numbers = zip(*rows, strict=True)
    doc, r, para, first = (np.array(x, np.int64) for x in numbers)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    seen = np.flatnonzero(code != 32)
    row = np.repeat(np.arange(len(texts)), n)[seen]
    col = seen - (np.cumsum(n) - n)[row]
    code = code[seen]
    head = para == 0
    advance = np.where(head, HEAD_ADVANCE, BODY_ADVANCE)[row]
    raised = (code >= 48) & (code <= 57) & ~head[row]
    px = LEFT + advance * col
    py = (TOP + LEADING * (r % PAGE_ROWS) + PARAGRAPH_GAP * (para - first))[row] - np.where(raised, RISE, 0.0)
    data = code.astype("<u4").tobytes().decode("utf-32-le").encode()
    ends = np.append(0, np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)))
    fonts = pa.DictionaryArray.from_arrays(pa.array((~head).astype(np.int8)[row]), ["Sans-Bold", "Serif"]).cast(pa.string())
    return pa.table(
        {
            "doc": ids.take(pa.array(doc[row])),
            "page": (r // PAGE_ROWS).astype(np.int32)[row],
            "gidx": (r * COLUMNS)[row] + col,
            "c": pa.StringArray.from_buffers(len(code), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)),
            "px": px,
            "py": py,
            "qx": px + advance,
            "qy": py,
            "dx": np.ones(len(code)),
            "dy": np.zeros(len(code)),
            "size": np.where(raised, RAISED_SIZE, np.where(head, HEAD_SIZE, BODY_SIZE)[row]),
            "font": fonts,
            "color": np.zeros(len(code), np.int64),
            "code": code,
        }
    )
