"""The windowed layout against a sequential one, and operators on small literal inputs."""

import random

import pytest
from pyspark.sql import functions as F

from papyrine.operators import frames, markdown, order, render, search, spatial, statistics
from papyrine.plans import layout

SCHEMA = "doc long, page int, gidx long, c string, px double, py double, qx double, qy double, dx double, dy double, size double, font string, color long"


def page(seed):
    """A random page: words, gaps, new lines, indents, bullets, raised glyphs, columns and turned text."""
    r = random.Random(seed)
    x, y, out, d = 72.0, 72.0, [], (1.0, 0.0)
    for k in range(150):
        size = r.choice([10.0, 10.0, 10.0, 6.0])
        step = r.random()
        if step < 0.12:
            x, y = r.choice([72.0, 72.0, 80.0, 400.0]), y + r.choice([12.0, 12.0, 20.0, 6.0])
        elif step < 0.3:
            x += r.choice([0.5, 2.0, 3.0, 8.0, 9.0, -2.0, -12.0])
        elif step < 0.33:
            d = r.choice([(1.0, 0.0), (0.0, -1.0)])
        rise = r.choice([0.0, 0.0, 0.0, -3.0])
        c = r.choice("abcdefgh-•א漢")
        out.append((1, seed, k, c, x, y + rise, x + 5.0 * d[0], y + rise + 5.0 * d[1], *d, size, r.choice(["Serif", "ABCDEF+Arial-BoldItalic"]), 0))
        x, y = out[-1][6], out[-1][7] - rise
    return out


def sequential(rows):
    """Line and block of each glyph and whether a space stands before it, glyph by glyph."""
    p = layout.LayoutParams()
    out, pen, block, line = [], None, -1, -1
    for _, _, _, c, px, py, qx, qy, dx, dy, size, *_ in rows:
        head, gap, opens = True, False, True
        if pen and dx * pen[2] + dy * pen[3] >= 0.999:
            along = ((px - pen[0]) * dx + (py - pen[1]) * dy) / size
            across = abs((py - pen[1]) * dx - (px - pen[0]) * dy) / size
            if across < p.baseline_tol:
                opens = False
                if abs(along) < p.word_gap or -p.column_gap < along < 0:
                    head = False
                elif 0 < along < p.column_gap:
                    head, gap = False, ord(pen[4]) < 0x700 or 0x2000 <= ord(pen[4]) <= 0x20CF
            elif across <= p.block_gap:
                opens = px - start > p.indent_pt and lead not in layout.BULLETS
        if head:
            line += 1
            start, lead = px, c
        block += opens
        out.append((block, line, gap))
        pen = (qx, qy, dx, dy, c)
    return out


def test_layout_is_the_sequential_one(spark):
    pages = [page(s) for s in range(60)]
    got = {}
    for r in layout.group_glyphs(spark.createDataFrame([g for p in pages for g in p], SCHEMA)).collect():
        got[r.page, r.gidx] = (r.block, r.pline, r.gap)
    for p in pages:
        assert [got[g[1], g[2]] for g in p] == sequential(p)
    assert len({b for b, _, _ in got.values()}) > 3


def test_layout_shuffles_once(spark):
    df = layout.group_glyphs(spark.createDataFrame(page(1), SCHEMA).repartition(3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_style_flags(spark):
    names = ["ABCDEF+Arial-BoldItalic", "Times-Roman", "Courier", "DejaVu Sans", "Georgia-Oblique"]
    df = spark.createDataFrame([(n,) for n in names], "f string").select(frames.style_flags(F.col("f")).alias("x"))
    assert [r.x for r in df.collect()] == [18, 4, 8, 0, 6]


def boxes(spark, rows):
    return spark.createDataFrame([(1, 0, k, *map(float, b)) for k, b in enumerate(rows)], "doc long, page int, block int, x0 double, y0 double, x1 double, y1 double")


def places(df):
    return [r.block for r in sorted(df.collect(), key=lambda r: r.place)]


def test_xy_cut(spark):
    # a title over two columns, read column by column; content order is row by row
    rows = [(0, 0, 200, 10), (0, 20, 90, 60), (110, 20, 200, 40), (0, 70, 90, 90), (110, 50, 200, 90)]
    assert places(order.xy_cut(boxes(spark, rows))) == [0, 1, 3, 2, 4]
    assert places(order.xy_cut(boxes(spark, rows), rtl=True)) == [0, 2, 4, 1, 3]
    assert places(order.xy_cut(boxes(spark, [(0, 0, 10, 10)] * 3))) == [0, 1, 2]
    assert places(order.simple(boxes(spark, rows))) == [0, 2, 1, 3, 4]


def test_by_rank(spark):
    b = boxes(spark, [(0, k, 1, k + 1) for k in range(5)]).withColumn("rank", F.element_at(F.array(F.lit(2), F.lit(None), F.lit(0), F.lit(1), F.lit(None)), F.col("block") + 1))
    assert places(order.by_rank(b)) == [2, 1, 3, 0, 4]


def test_table_cells(spark):
    words = spark.createDataFrame([(1, 0, 0, 10.0, 10.0, 20.0, 20.0), (1, 0, 1, 95.0, 0.0, 105.0, 10.0), (1, 0, 2, 300.0, 0.0, 310.0, 5.0), (1, 0, 3, 50.0, 5.0, 50.0, 5.0)], "doc long, page int, w int, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 30.0), (1, 100.0, 0.0, 200.0, 30.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    got = {r.w: r.box for r in spatial.assign(words, cells, ["doc", "page", "w"]).collect()}
    assert got == {0: 0, 1: 0, 3: 0}  # of equal covers the first cell; a point goes by its centre
    by_page = cells.withColumn("doc", F.lit(1)).withColumn("page", F.lit(0))
    assert {r.w: r.box for r in spatial.assign(words, by_page, ["doc", "page", "w"]).collect()} == got


def test_merge_rules(spark):
    rows = [(1, True, 10.0, 0.0, 50.0), (1, True, 11.0, 51.0, 80.0), (1, True, 12.4, 100.0, 120.0), (1, True, 30.0, 0.0, 5.0), (1, False, 10.0, 0.0, 9.0)]
    got = sorted(tuple(r) for r in spatial.merge_rules(spark.createDataFrame(rows, "page long, horizontal boolean, position double, start double, stop double")).collect())
    assert got == [(1, False, 10.0, 0.0, 9.0), (1, True, 10.0, 0.0, 80.0), (1, True, 10.0, 100.0, 120.0), (1, True, 30.0, 0.0, 5.0)]


def test_hints_of_rows_in_one_place(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 2, False), (1, 2, False), (1, 3, False), (1, 4, True)]
    for own in (rows, rows[::-1]):
        got = layout.carry_hint(spark.createDataFrame(own, "line int, place int, generated boolean").coalesce(1), ["line"], ["place"]).collect()
        assert sorted((r.place, r.hint) for r in got) == [(1, False), (2, False), (2, False), (3, True)]


def test_search_over_lines(spark):
    rows = []
    for k, c in enumerate("onetwo"):
        rows.append((1, 0, k, c, 72.0 + 5 * (k % 3), 72.0 + 12.0 * (k // 3), 77.0 + 5 * (k % 3), 72.0 + 12.0 * (k // 3), 1.0, 0.0, 10.0, "F", 0))
    c = layout.group_glyphs(spark.createDataFrame(rows, SCHEMA))
    got = search.search(c, "NE TW").collect()
    assert sorted((r.hit, r.pline, r.x0, r.x1) for r in got) == [(0, 0, 77.0, 87.0), (0, 1, 72.0, 82.0)]
    assert search.search(c, "net").count() == 0 and search.search(c, "o", 1).select("hit").distinct().count() == 1


def test_heading_paths_and_chunks(spark):
    html = "<h1>A</h1><p>x.</p><h2>B</h2><p>" + "One sentence here. " * 30 + "</p><h3>C</h3><li>i</li><li>j</li><h2>D</h2><p>y</p><h1>E</h1>"
    els = markdown.elements(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    paths = [r.path for r in markdown.heading_paths(els).orderBy("ord").collect()]
    assert paths == ["", "A", "A", "A > B", "A > B", "A > B > C", "A > B > C", "A", "A > D", ""]
    got = markdown.chunks(els, max_chars=200, min_chars=5).orderBy("chunk").collect()
    assert all(r.chars <= 200 for r in got) and [r.chunk for r in got] == list(range(len(got)))
    assert got[-1].headings == "E" and any("- i\n- j" in r.text for r in got)
    whole = markdown.chunks(els, max_chars=10_000, min_chars=10_000).collect()
    assert len(whole) == 1 and whole[0].headings == "A"


def test_split_sentences():
    assert markdown.split_sentences("One. Two! Three?", 9) == ["One. Two!", "Three?"]
    assert markdown.split_sentences("abcdefghij kl. m", 4) == ["abcd", "efgh", "ij k", "l. m"]


def test_pixel_size():
    w, h = 611.976, 791.968
    assert render.pixel_size(w, h, dpi=150) == (1275, 1650) and render.pixel_size(w, h) == (612, 792)
    assert render.pixel_size(w, h, scale=2) == (1224, 1584) and render.pixel_size(w, h, max_side=1000) == (773, 1000)
    assert render.pixel_size(w, h, size=(300, None)) == (300, 388) and render.pixel_size(w, h, size=(None, 100)) == (77, 100)
    with pytest.raises(ValueError):
        render.pixel_size(w, h, dpi=1, scale=2)


def test_f1(spark):
    rows = lambda t: spark.createDataFrame([(1, x) for x in t], "doc long, token string")
    got = statistics.multiset_f1(rows("aab"), rows("abc")).first()
    assert got.f1 == pytest.approx(2 * 2 / 6) and got.recall == pytest.approx(2 / 3)
