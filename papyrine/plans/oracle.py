"""DuckDB SQL of the typeset relation and its grouping, as common table expressions that queries build on."""

from __future__ import annotations

GLYPHS = """
para_rows AS (
  SELECT doc_id AS doc, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS para
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
),
visual AS (
  SELECT doc, para, s, unnest(range(greatest(1, (length(s) + 79) // 80))) AS j FROM para_rows
),
numbered_rows AS (
  SELECT doc, para, substr(s, 80 * j + 1, 80) AS s, row_number() OVER (PARTITION BY doc ORDER BY para, j) - 1 AS r FROM visual
),
paged AS (
  SELECT *, r // 50 AS page, min(para) OVER (PARTITION BY doc, r // 50) AS first_para FROM numbered_rows
),
cells AS (
  SELECT doc, page, r, para, first_para, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS col
  FROM (SELECT *, string_split(s, '') AS l FROM paged WHERE s <> '')
),
glyphs AS (
  SELECT doc, CAST(page AS INTEGER) AS page, CAST(r * 80 + col AS BIGINT) AS gidx, c,
    72.0::DOUBLE + adv * col AS px,
    72.0::DOUBLE + 12.0::DOUBLE * (r % 50) + 8.0::DOUBLE * (para - first_para) - CASE WHEN raised THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS py,
    72.0::DOUBLE + adv * col + adv AS qx, adv, size, font
  FROM (
    SELECT *, CASE WHEN para = 0 THEN 7.0::DOUBLE ELSE 5.0::DOUBLE END AS adv,
      CASE WHEN para = 0 THEN 14.0::DOUBLE WHEN raised THEN 6.0::DOUBLE ELSE 10.0::DOUBLE END AS size,
      CASE WHEN para = 0 THEN 'Sans-Bold' ELSE 'Serif' END AS font
    FROM (SELECT *, para > 0 AND c BETWEEN '0' AND '9' AS raised FROM cells WHERE c <> '' AND c <> ' ')
  )
)"""


def chars(source: str = "glyphs") -> str:
    return f"""
penned AS (
  SELECT *, lag(qx) OVER w AS lqx, lag(py) OVER w AS lpy, lag(c) OVER w AS lc FROM {source} WINDOW w AS (PARTITION BY doc, page ORDER BY gidx)
),
moved AS (
  SELECT *, (px - lqx) / size AS spacing, abs(py - lpy) / size AS shift FROM penned
),
judged AS (
  SELECT *, lqx IS NULL AS first_glyph,
    coalesce(shift < 0.85 AND (abs(spacing) < 0.14 OR (spacing > -0.85 AND spacing < 0)), false) AS joined,
    coalesce(shift < 0.85 AND abs(spacing) >= 0.14 AND spacing > 0 AND spacing < 0.85, false) AS spaced,
    coalesce(shift >= 0.85 AND shift <= 1.5, false) AS near_
  FROM moved
),
heads AS (
  SELECT *, first_glyph OR NOT (joined OR spaced) AS head,
    NOT first_glyph AND spaced AND (unicode(lc) < 1792 OR unicode(lc) BETWEEN 8192 AND 8399) AS gap,
    first_glyph OR (shift >= 0.85 AND NOT near_) AS hard
  FROM judged
),
placed AS (
  SELECT *, CAST(sum(head::INT) OVER u - 1 AS INTEGER) AS pline, CAST(sum((head OR gap)::INT) OVER u - 1 AS INTEGER) AS pword,
    last_value(CASE WHEN head THEN px END IGNORE NULLS) OVER u AS start_x, last_value(CASE WHEN head THEN c END IGNORE NULLS) OVER u AS lead_c,
    last_value(CASE WHEN head THEN py END IGNORE NULLS) OVER u AS base_y
  FROM heads WINDOW u AS (PARTITION BY doc, page ORDER BY gidx ROWS UNBOUNDED PRECEDING)
),
opened AS (
  SELECT *, head AND (hard OR coalesce(near_ AND px - lag(start_x) OVER w > 4.1 AND lag(lead_c) OVER w NOT IN ('•', '◦', '▪', '–', '-', '*'), false)) AS opens
  FROM placed WINDOW w AS (PARTITION BY doc, page ORDER BY gidx)
),
chars AS (
  SELECT doc, page, gidx, c, CAST(sum(opens::INT) OVER (PARTITION BY doc, page ORDER BY gidx ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS block, pline, pword, head, gap,
    py < base_y - size * 0.21::DOUBLE AS sup, px AS x0, py - 0.8::DOUBLE * size AS y0, qx AS x1, py - (-0.2)::DOUBLE * size AS y1, px, py, size, font
  FROM opened
)"""


WORDS = """
word_rows AS (
  SELECT doc, page, block, pline, pword, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(c, '' ORDER BY gidx) AS text
  FROM chars GROUP BY ALL
),
words AS (
  SELECT doc, page, block, CAST(pline - min(pline) OVER (PARTITION BY doc, page, block) AS INTEGER) AS line,
    CAST(row_number() OVER (PARTITION BY doc, page, block, pline ORDER BY pword) - 1 AS INTEGER) AS word, x0, y0, x1, y1, text
  FROM word_rows
)"""

LINES = """
line_rows AS (
  SELECT doc, page, block, pline, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(CASE WHEN gap THEN ' ' ELSE '' END || c, '' ORDER BY gidx) AS text
  FROM chars GROUP BY ALL
),
lines AS (
  SELECT doc, page, block, CAST(pline - min(pline) OVER (PARTITION BY doc, page, block) AS INTEGER) AS line, x0, y0, x1, y1, text FROM line_rows
)"""

BLOCKS = """
blocks AS (
  SELECT doc, page, block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text || chr(10), '' ORDER BY line) AS text
  FROM lines GROUP BY ALL
)"""

SPANS = """
flagged AS (
  SELECT *, (CASE WHEN font = 'Sans-Bold' THEN 16 ELSE 4 END) | sup::INT AS flags FROM chars
),
runs AS (
  SELECT *, coalesce(lag(font) OVER w = font AND round(lag(size) OVER w, 3) = round(size, 3) AND lag(flags) OVER w = flags, false) AS same
  FROM flagged WINDOW w AS (PARTITION BY doc, page, pline ORDER BY gidx)
),
run_ids AS (
  SELECT *, CAST(sum((NOT same)::INT) OVER (PARTITION BY doc, page, pline ORDER BY gidx ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS span FROM runs
),
span_rows AS (
  SELECT doc, page, block, pline, span, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(CASE WHEN gap THEN ' ' ELSE '' END || c, '' ORDER BY gidx) AS text,
    arg_min(font, gidx) AS font, arg_min(size, gidx) AS size, CAST(arg_min(flags, gidx) AS INTEGER) AS flags
  FROM run_ids GROUP BY doc, page, block, pline, span
),
spans AS (
  SELECT doc, page, block, CAST(pline - min(pline) OVER (PARTITION BY doc, page, block) AS INTEGER) AS line, span, x0, y0, x1, y1, text, font, size, flags, CAST(0 AS BIGINT) AS color FROM span_rows
)"""


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


def on_chars(select: str, *more: str) -> str:
    return sql(select, GLYPHS, chars(), *more)
