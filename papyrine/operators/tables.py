"""Tables: rules from drawings, the grid that crossing rules span, its cells with spans and words, checks, and outputs."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How near rules have to come to meet, and the least size of a table, in points (fixed values).
TOUCH, LEAST_WIDTH, LEAST_HEIGHT = 2.5, 20.0, 8.0
#: Least length of a rule and its greatest thickness, least length of rules in a grid and in a stack (fixed values).
LEAST_RULE, THICK, GRID_RULE, STACK_RULE = 2.0, 2.5, 8.0, 40.0


def regions(rules: list[tuple]) -> list[tuple[list, list]]:
    """Groups of rules (horizontal, position, start, stop) that cross, each as (horizontal, vertical) rules."""
    up = list(range(len(rules)))

    def root(k: int) -> int:
        while up[k] != k:
            k = up[k]
        return k

    for i, (flat, y, a, b) in enumerate(rules):
        for j, (other, x, c, d) in enumerate(rules):
            if flat and not other and a - TOUCH <= x <= b + TOUCH and c - TOUCH <= y <= d + TOUCH:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    groups: dict[int, list] = {}
    for k, r in enumerate(rules):
        groups.setdefault(root(k), []).append(r)
    out = []
    for g in groups.values():
        h, v = [r for r in g if r[0]], [r for r in g if not r[0]]
        if h and v:
            out.append((h, v))
    return out


def _covered(rules: list, at: float, low: float, high: float) -> bool:
    """Whether a rule at this position covers the middle half of the stretch."""
    quarter = (high - low) / 4
    return any(abs(r[1] - at) <= TOUCH and r[2] <= low + quarter and r[3] >= high - quarter for r in rules)


def grid(h: list, v: list) -> tuple[list[float], list[float], list[tuple[int, int, int, int]]]:
    """Column and row edges, and cells (row, col, rowspan, colspan): neighbours without a rule between them are one."""
    xs, ys = ([r[1] for k, r in enumerate(sorted(rs, key=lambda r: r[1])) if not k or r[1] - sorted(rs, key=lambda r: r[1])[k - 1][1] > TOUCH] for rs in (v, h))
    rows, cols = len(ys) - 1, len(xs) - 1
    taken, cells = set(), []
    for r in range(rows):
        for c in range(cols):
            if (r, c) in taken:
                continue
            wide = 1
            while c + wide < cols and (r, c + wide) not in taken and not _covered(v, xs[c + wide], ys[r], ys[r + 1]):
                wide += 1
            high = 1
            while r + high < rows and not any(_covered(h, ys[r + high], xs[k], xs[k + 1]) for k in range(c, c + wide)):
                high += 1
            taken |= {(i, j) for i in range(r, r + high) for j in range(c, c + wide)}
            cells.append((r, c, high, wide))
    return xs, ys, cells


def large_enough(xs: list[float], ys: list[float]) -> bool:
    return len(xs) >= 2 and len(ys) >= 2 and xs[-1] - xs[0] >= LEAST_WIDTH and ys[-1] - ys[0] >= LEAST_HEIGHT


def page_tables(rules: list[tuple], words: list[tuple]) -> list[tuple]:
    """Rows (table, row, col, rowspan, colspan, x0, y0, x1, y1, text) from rules and words (x0, y0, x1, y1, text)."""
    found = []
    for h, v in regions(rules):
        xs, ys, cells = grid(h, v)
        if not large_enough(xs, ys):
            continue
        owner = {(i, j): k for k, (r, c, high, wide) in enumerate(cells) for i in range(r, r + high) for j in range(c, c + wide)}
        texts: dict[int, list] = {}
        for x0, y0, x1, y1, text in words:
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            if xs[0] - 1 <= mx <= xs[-1] + 1 and ys[0] - 1 <= my <= ys[-1] + 1:
                c = min(max(bisect_right(xs, mx) - 1, 0), len(xs) - 2)
                r = min(max(bisect_right(ys, my) - 1, 0), len(ys) - 2)
                texts.setdefault(owner[r, c], []).append((round(my), x0, text))
        if not texts:
            continue
        found.append((ys[0], xs[0], [(r, c, high, wide, xs[c], ys[r], xs[c + wide], ys[r + high], " ".join(t for *_, t in sorted(texts.get(k, [])))) for k, (r, c, high, wide) in enumerate(cells)]))
    return [(k, *cell) for k, (_, _, cells) in enumerate(sorted(found, key=lambda f: f[:2])) for cell in cells]


def find_tables(rules: DataFrame, words: DataFrame) -> DataFrame:
    """doc, page, table, row, col, rowspan, colspan, x0, y0, x1, y1, text.

    rules: doc, page, horizontal, position, start, stop (merged); words: doc, page, x0, y0, x1, y1, text. Only pages with
    rules of both kinds are looked at; the rules and words of one page make a pandas group.
    """
    both = rules.groupBy("doc", "page").agg(F.max("horizontal").alias("a"), F.min("horizontal").alias("b")).where("a and not b").select("doc", "page")
    none = lambda t: F.lit(None).cast(t)
    left = rules.select("doc", "page", "horizontal", F.col("position").alias("x0"), F.col("start").alias("y0"), F.col("stop").alias("x1"), none("double").alias("y1"), none("string").alias("text"))
    right = words.select("doc", "page", none("boolean").alias("horizontal"), "x0", "y0", "x1", "y1", "text")
    rows = left.unionByName(right).join(both, ["doc", "page"], "left_semi")

    names = ["table", "row", "col", "rowspan", "colspan", "x0", "y0", "x1", "y1", "text"]

    def page(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = list(frame.itertuples(index=False))
        lines = [(bool(r.horizontal), r.x0, r.y0, r.x1) for r in own if not isinstance(r.text, str)]
        texts = [(r.x0, r.y0, r.x1, r.y1, r.text) for r in own if isinstance(r.text, str)]
        return pd.DataFrame(page_tables(lines, texts), columns=names).assign(doc=key[0], page=key[1])[["doc", "page", *names]]

    kind = words.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, page int, table int, row int, col int, rowspan int, colspan int, x0 double, y0 double, x1 double, y1 double, text string"
    return rows.groupBy("doc", "page").applyInPandas(page, schema)


def to_markdown(cells: DataFrame) -> DataFrame:
    """doc, page, table, markdown: the first row heads; cells under a span are empty; bars and line feeds are escaped."""
    t = F.regexp_replace(F.regexp_replace("text", r"\|", r"\\|"), "\n", " ")
    spread = cells.withColumn("t", t).withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    spread = spread.withColumn("t", F.when((F.col("r") == F.col("row")) & (F.col("c") == F.col("col")), F.col("t")).otherwise(""))
    lines = spread.groupBy("doc", "page", "table", "r").agg(F.concat(F.lit("| "), F.expr("listagg(t, ' | ') WITHIN GROUP (ORDER BY c)"), F.lit(" |")).alias("line"), F.count("*").alias("n"))
    lines = lines.withColumn("line", F.when(F.col("r") == 0, F.concat("line", F.lit("\n|"), F.expr("repeat(' --- |', n)"))).otherwise(F.col("line")))
    return lines.groupBy("doc", "page", "table").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY r)").alias("markdown"))


def unique_names(header: DataFrame) -> DataFrame:
    """Adds `name` to header cells (doc, page, table, col, text): repeats get .1, .2 and so on."""
    w = Window.partitionBy("doc", "page", "table", "text").orderBy("col")
    k = F.row_number().over(w) - 1
    return header.withColumn("name", F.when(k > 0, F.concat("text", F.lit("."), k)).otherwise(F.col("text")))


def rules_of(drawings: DataFrame) -> DataFrame:
    """page, horizontal, position, start, stop of drawings (page, type, kind, x0, y0, x1, y1, fill): straight strokes, thin
    filled rectangles by their middle, and the edges of the others, but of white ones that are only filled.

    type: a text with s (stroked) and f (filled); kind: l (from x0, y0 to x1, y1) or re; fill: the least of its channels.
    """
    c = F.col
    stroked, filled = F.contains("type", F.lit("s")), F.contains("type", F.lit("f"))
    w, h = c("x1") - c("x0"), c("y1") - c("y0")
    rule = lambda flat, at, a, b: F.struct(F.lit(flat).alias("horizontal"), at.alias("position"), a.alias("start"), b.alias("stop"))
    line = F.when((F.abs(h) < 0.5) & (F.abs(w) >= LEAST_RULE) & stroked, F.array(rule(True, c("y0"), F.least("x0", "x1"), F.greatest("x0", "x1")))).when(
        (F.abs(w) < 0.5) & (F.abs(h) >= LEAST_RULE), F.array(rule(False, c("x0"), F.least("y0", "y1"), F.greatest("y0", "y1")))
    )
    white = filled & ~stroked & F.coalesce(c("fill") > 0.95, F.lit(False))
    edges = F.array(*[rule(True, c(y), c("x0"), c("x1")) for y in ("y0", "y1")], *[rule(False, c(x), c("y0"), c("y1")) for x in ("x0", "x1")])
    box = F.when(filled & (h <= THICK) & (w >= LEAST_RULE), F.array(rule(True, (c("y0") + c("y1")) / 2, c("x0"), c("x1")))).when(
        filled & (w <= THICK) & (h >= LEAST_RULE), F.array(rule(False, (c("x0") + c("x1")) / 2, c("y0"), c("y1")))
    ).when((stroked | filled) & ~white, edges)
    return drawings.select("page", F.explode(F.when(c("kind") == "l", line).when(c("kind") == "re", box)).alias("r")).select("page", "r.*")


def long_rules(rules: DataFrame, least: float = GRID_RULE) -> DataFrame:
    return rules.where(F.col("stop") - F.col("start") >= least)


def rules_in(rules: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Rules that an area touches, within a point of its edges."""
    x0, y0, x1, y1 = area
    across = F.when(F.col("horizontal"), F.col("position").between(y0 - 1, y1 + 1)).otherwise(F.col("position").between(x0 - 1, x1 + 1))
    along = F.when(F.col("horizontal"), (F.col("stop") >= x0) & (F.col("start") <= x1)).otherwise((F.col("stop") >= y0) & (F.col("start") <= y1))
    return rules.where(across & along)


def words_in(words: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Words whose centre lies in an area, within a point of its edges."""
    x0, y0, x1, y1 = area
    return words.where(((F.col("x0") + F.col("x1")) / 2).between(x0 - 1, x1 + 1) & ((F.col("y0") + F.col("y1")) / 2).between(y0 - 1, y1 + 1))


def words_outside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre no box (by value) holds, within a point."""
    b = boxes.select(*[F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")])
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return words.join(b, mx.between(F.col("b_x0") - 1, F.col("b_x1") + 1) & my.between(F.col("b_y0") - 1, F.col("b_y1") + 1), "left_anti")


def valid_tables(cells: DataFrame, min_rows: int = 2, min_cols: int = 2, max_cols: int = 20) -> DataFrame:
    """doc, page, table of cells that look like a table's: mostly filled, few of them long, two rows with two filled cells."""
    key = ["doc", "page", "table"]
    text = F.regexp_replace("text", r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    full = text != ""
    long_ = full & (F.size(F.split(text, r"[ \t\n\r\f\x0B]+")) > 20)
    rows = cells.withColumns({"full": full.cast("int"), "long": long_.cast("int")}).groupBy(*key, "row").agg(F.sum("full").alias("full"), F.sum("long").alias("long"), F.count("*").alias("n"), F.max(F.col("row") + F.col("rowspan")).alias("below"), F.max(F.col("col") + F.col("colspan")).alias("right"))
    sums = rows.groupBy(*key).agg(F.sum("full").alias("full"), F.sum("long").alias("long"), F.sum("n").alias("n"), F.max("below").alias("rows"), F.max("right").alias("cols"), F.count_if(F.col("full") >= 2).alias("multi"))
    good = (F.col("rows") >= min_rows) & F.col("cols").between(min_cols, max_cols) & (F.col("full") >= F.greatest(F.lit(3.0), F.col("n") * 0.3)) & (F.col("long") <= F.greatest(F.lit(1.0), F.col("full") * 0.1)) & (F.col("multi") >= 2)
    return sums.where(good).select(*key)


def without_titles(tables: DataFrame, spans: DataFrame, bodies: DataFrame) -> DataFrame:
    """tables (doc, page, id, box) less those that hold, within a point, three characters of text well over the body's size."""
    n = F.length(F.regexp_replace("text", r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", ""))
    big = spans.where(n >= 3).join(bodies, ["doc", "page"]).where(F.round("size", 1) > F.col("body") * 1.4)
    big = big.select("doc", "page", *[F.col(k).alias(f"s_{k}") for k in ("x0", "y0", "x1", "y1")]).alias("s")
    t = tables.alias("t")
    holds = (F.col("t.doc") == F.col("s.doc")) & (F.col("t.page") == F.col("s.page")) & (F.col("s_x0") >= F.col("x0") - 1) & (F.col("s_x1") <= F.col("x1") + 1) & (F.col("s_y0") >= F.col("y0") - 1) & (F.col("s_y1") <= F.col("y1") + 1)
    return t.join(big, holds, "left_anti")


def outer_regions(regions: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Regions (page, id, box) less those that one further up, or left at the same height, contains."""
    box = ["x0", "y0", "x1", "y1"]
    a, b = regions.alias("a"), regions.select("page", "id", *box).alias("b")
    before = F.struct("b.y0", "b.x0", "b.id") < F.struct("a.y0", "a.x0", "a.id")
    inside = (F.col("b.x0") - tolerance <= F.col("a.x0")) & (F.col("b.y0") - tolerance <= F.col("a.y0")) & (F.col("a.x1") <= F.col("b.x1") + tolerance) & (F.col("a.y1") <= F.col("b.y1") + tolerance)
    return a.join(b, (F.col("a.page") == F.col("b.page")) & before & inside, "left_anti")


def fragments(words: DataFrame, gap: float = 0.8) -> DataFrame:
    """doc, page, block, line, fragment, box, text: lines cut where words are over `gap` of a word's height apart."""
    line = ["doc", "page", "block", "line"]
    w = Window.partitionBy(*line).orderBy("word")
    far = F.coalesce(F.col("x0") - F.lag("x1").over(w) > gap * (F.col("y1") - F.col("y0")), F.lit(False))
    rows = words.withColumn("fragment", F.sum(far.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return rows.groupBy(*line, "fragment").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY word)").alias("text"))


def to_text(cells: DataFrame, separator: str = "\t") -> DataFrame:
    """doc, page, table, text: rows as lines, cells apart by a tab; line feeds in cells become spaces."""
    return _rows(cells, F.regexp_replace("text", "\n", " "), separator, "text")


def to_csv(cells: DataFrame) -> DataFrame:
    """doc, page, table, csv: cells with commas, quotes or line feeds are quoted."""
    quoted = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    return _rows(cells, F.when(F.col("text").rlike('[",\n\r]'), quoted).otherwise(F.col("text")), ",", "csv")


def _rows(cells: DataFrame, text, separator: str, name: str) -> DataFrame:
    quoted = "".join("\\u%04X" % ord(c) for c in separator)
    lines = cells.withColumn("t", text).groupBy("doc", "page", "table", "row").agg(F.expr(f"listagg(t, '{quoted}') WITHIN GROUP (ORDER BY col)").alias("line"))
    return lines.groupBy("doc", "page", "table").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY row)").alias(name))
