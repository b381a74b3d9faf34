import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.functions import bidi, geometry, pages, text
from papyrine.operators import images, ocr, order, tables

#: Prices by town and year: the second heading spans two columns.
RULES = [(True, float(y), 40.0, 340.0) for y in (10, 40, 70, 100)] + [(False, float(x), 10.0, 100.0) for x in (40, 140, 340)] + [(False, 240.0, 40.0, 100.0)]
GRID = [["Town", "Rent", None], ["Bern", "910", "955"], ["", "870", "12 %"]]
WORDS = [(50.0 + 100 * c, 18.0 + 30 * r, 80.0 + 100 * c, 30.0 + 30 * r, t) for r, row in enumerate(GRID) for c, t in enumerate(row) if t]


def drawn(pieces, right):
    """How a line looks that is read as its pieces, each a string and whether it runs right to left."""
    flip = str.maketrans("()[]<>", ")(][><")
    looks = [t.translate(flip)[::-1] if r else t for t, r in pieces]
    return "".join(reversed(looks) if right else looks)


@pytest.mark.parametrize(
    "pieces,right",
    [
        ([("גן חיות", True)], True),
        ([("רחוב ", True), ("48", False)], True),
        ([("see ", False), ("בית", True), (" often", False)], False),
        ([("(מים) ", True), ("x2", False), (" קר", True)], True),
        ([("no such letters: 7 (8)", False)], False),
        ([("", False)], False),
    ],
)
def test_bidi(pieces, right):
    assert bidi.logical(drawn(pieces, right)) == "".join(t for t, _ in pieces)


def test_bidi_column(spark):
    lines = ["קר", "abc", None, "12 קר"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, t string")
    assert [r.x for r in df.select("k", bidi.logical_text(F.col("t")).alias("x")).orderBy("k").collect()] == ["רק", "abc", None, "רק 12"]
    level, line, base = bidi.levels(["ab גד", "", "xyz ג", "5"])
    assert base.tolist() == [1, 0, 0, 0] and line.tolist() == [0] * 5 + [2] * 5 + [3]
    assert level.tolist() == [2, 2, 1, 1, 1, 0, 0, 0, 0, 1, 0]


def naive_gutters(spans, least):
    """Ends of intervals that no other interval reaches over, far enough before the next start."""
    out = set()
    for _, b in spans:
        later = [a for a, _ in spans if a >= b]
        if later and min(later) - b >= least and b > min(a for a, _ in spans) and not any(a < b < c for a, c in spans):
            out.add(b)
    return sorted(out)


def test_gutters():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 40, rng.integers(1, 9)).astype(float)
        b = a + rng.integers(1, 8, len(a))
        assert sorted(set(order.gutters(a, b, 2.0).tolist())) == naive_gutters(list(zip(a, b)), 2.0)


def test_cut():
    two = [(0, 0, 40, 10), (0, 14, 40, 24), (60, 0, 99, 10), (60, 14, 99, 24)]
    assert order.cut(np.array(two, float), 12.5, 2.0) == [0, 1, 2, 3] and order.cut(np.array(two, float), 12.5, 2.0, rtl=True) == [2, 3, 0, 1]
    headed = [(0, 0, 99, 8), *((x0, y0 + 20, x1, y1 + 20) for x0, y0, x1, y1 in two), (0, 60, 99, 70)]
    assert order.cut(np.array(headed, float), 12.5, 2.0) == list(range(6))
    near = np.array([(5, 0.2, 9, 9), (0, 0.4, 6, 9)], float)  # nothing between them: by rounded top, then left
    assert order.cut(near, 12.5, 2.0) == [1, 0] and order.cut(np.zeros((0, 4)), 1.0, 1.0) == []
    rng = np.random.default_rng(4)
    for _ in range(50):
        xy = rng.integers(0, 60, (rng.integers(1, 12), 2)).astype(float)
        got = order.cut(np.concatenate([xy, xy + rng.integers(1, 20, xy.shape)], 1), 5.0, 2.0)
        assert sorted(got) == list(range(len(xy)))


def test_page_selection():
    assert pages.select(None, 3) == [0, 1, 2] and pages.select(-1, 3) == [2] and pages.select([2, 0, 2], 3) == [2, 0, 2]
    assert pages.select("0,2-4, -1,3-", 6) == [0, 2, 3, 4, 5, 3, 4, 5]
    for bad in (3, "0-9", [-4]):
        with pytest.raises(IndexError):
            pages.select(bad, 3)


def test_ruled_table(spark):
    got = tables.page_tables(RULES, WORDS)
    assert ("Rent", 0, 1, 1, 2) in [(c[-1], *c[1:5]) for c in got]
    cells = {(c[1], c[2]): c[-1] for c in got}
    assert [[cells.get((r, c)) for c in range(3)] for r in range(3)] == GRID
    rules = spark.createDataFrame([(1, 0, *r) for r in RULES] + [(1, 1, True, 10.0, 0.0, 50.0)], "doc long, page int, horizontal boolean, position double, start double, stop double")
    words = spark.createDataFrame([(1, p, *w) for p in (0, 1) for w in WORDS], "doc long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    found = tables.find_tables(rules, words)
    assert sorted(tuple(r)[2:] for r in found.collect()) == sorted(got)
    md = tables.to_markdown(found).first().markdown.split("\n")
    assert md == ["| Town | Rent |  |", "| --- | --- | --- |", "| Bern | 910 | 955 |", "|  | 870 | 12 % |"]


def test_names(spark):
    h = spark.createDataFrame([(1, 0, 0, c, t) for c, t in enumerate(["k", "x", "k", "k"])], "doc long, page int, table int, col int, text string")
    assert [r.name for r in tables.unique_names(h).orderBy("col").collect()] == ["k", "x", "k.1", "k.2"]


def test_ocr_words(spark):
    rows = [(1, 0, 0, "hello world", 0.8, 10.0, 10.0, 110.0, 30.0), (1, 0, 1, "far", None, 300.0, 0.0, 330.0, 10.0), (1, 0, 2, "drop", 0.2, 0.0, 0.0, 5.0, 5.0), (1, 0, 3, " ", 0.9, 0.0, 0.0, 5.0, 5.0)]
    runs = spark.createDataFrame(rows, "doc long, page int, run int, text string, conf double, x0 double, y0 double, x1 double, y1 double")
    got = {r.text: r for r in ocr.run_words(runs, min_conf=0.5).collect()}
    assert set(got) == {"hello", "world", "far"} and got["hello"].x1 == pytest.approx(10 + 500 / 11) and got["world"].word == 1
    assert {r.text for r in ocr.run_words(runs, clip=(0, 0, 200, 100)).collect()} == {"hello", "world", "drop"}
    assert ocr.page_confidence(ocr.run_words(runs, min_conf=0.5)).first().conf == 0.8


def test_text_functions(spark):
    df = spark.createDataFrame([("abc� x", " 3.1  The END! ", "a*b_[c]", 'Eﬃcient <&"'), ("", "", "", "")], "a string, b string, c string, d string")
    r = df.select(text.garbled_ratio(F.col("a")).alias("g"), text.heading_key(F.col("b")).alias("h"), text.running_key(F.col("b")).alias("k"), text.escape_markdown(F.col("c")).alias("m"), text.escape_html(F.col("d")).alias("e"), text.expand_ligatures(F.col("d")).alias("l"), text.hex_color(F.lit(255)).alias("x")).collect()
    assert r[0].g == pytest.approx(2 / 6) and r[0].h == "theend" and r[0].k == "#.# the end!" and r[0].m == r"a\*b\_\[c\]" and r[0].e.endswith("&lt;&amp;&quot;") and r[0].l.startswith("Efficient") and r[0].x == "#0000ff"
    assert r[1].g == 0.0


def test_rotation(spark):
    df = spark.createDataFrame([(k, 10.0, 20.0, 30.0, 60.0) for k in (0, 90, 180, 270)], "r int, x0 double, y0 double, x1 double, y1 double")
    got = [tuple(r)[1:] for r in geometry.rotate(df, F.col("r"), 100.0, 200.0).collect()]
    assert got == [(10.0, 20.0, 30.0, 60.0), (140.0, 10.0, 180.0, 30.0), (70.0, 140.0, 90.0, 180.0), (20.0, 70.0, 60.0, 90.0)]


def test_first_use_in_one_place(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 1, 3.0), (1, 2, 3.0), (1, 3, 9.0)], "doc int, place int, value double")
    got = images.first_use(rows, ["doc"], ["value"], ["place"]).collect()
    assert sorted((r.place, r.value, r.idx) for r in got) == [(1, 3.0, 0), (1, 5.0, 0), (2, 3.0, 0), (3, 9.0, 1)]
