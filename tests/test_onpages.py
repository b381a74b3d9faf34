"""Operators on typeset texts in the workers against those on rows of characters and words."""

import pytest

from papyrine.operators import frames, order, search, spatial, statistics, tables
from papyrine.plans import kernel, layout, onpages, queries
from papyrine.sources import typeset

ODD = "Title 7 of é\U0001f600 ﬁ\nthe time is well-\n12x the t the tree\t the TALL\r\n\n" + "well-known hyphen-" * 9 + "\n" + "a tée-\U0001f600 thé tThe t " * 40 + "\n• item\n   in­dented\x00 12 34\n" + "x" * 79 + "- y\n" + "Straßen-\nbahn th e\n" + "\n" * 60 + "the the than end"
LINKS = [(3, "u", 72.0, 60.0, 130.0, 100.0), (1, "v", 100.0, 60.0, 200.0, 130.0), (2, "u", 72.0, 200.0, 320.0, 400.0)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, ODD), (1, None), (2, ""), (3, " "), (4, ODD[::-1]), (5, ODD * 3), (6, "\n\n-\n-a"), (7, "the t" * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def chars(docs):
    return layout.group_glyphs(typeset.read_typeset(docs)).cache()


def same(got, want):
    rows = lambda df: sorted((tuple(r) for r in df.select(*want.columns).collect()), key=repr)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("kind", ["words", "lines", "spans"])
def test_frames(docs, kind):
    same(kernel.text_frame(docs, kind), kernel.frame(typeset.read_typeset(docs), kind))


def test_tables_of_glyphs_end_with_pages(docs):
    rows = docs.toArrow().to_batches()
    one, many = ([t.drop(["code"]).to_pylist() for t in typeset.glyph_tables(iter(rows), n)] for n in (10**9, 50))
    assert sum(one, []) == sum(many, []) and len(many) > len(one)
    ends = [(t[-1]["doc"], t[-1]["page"]) for t in many]
    assert len(set(ends)) == len(ends)


def test_order(docs, chars):
    own = frames.blocks(chars)
    same(order.simple(frames.blocks_of_lines(kernel.text_frame(docs, "lines"))), order.simple(own))


@pytest.mark.parametrize("most", [None, 2])
def test_search(docs, chars, most):
    for needle in ("the t", "THE", "é"):
        same(onpages.search(docs, needle, most), search.search(chars, needle, most))


def test_search_after_a_character_that_lowers_to_two(spark):
    rows = onpages.search(spark.createDataFrame([(0, "h\nİ the")], "doc_id long, text string"), "THE").collect()
    assert [(r.x0, r.x1) for r in rows] == [(82.0, 97.0)]


def test_blank_texts(spark):
    blank = spark.createDataFrame([(0, " "), (1, "   \n  "), (2, "")], "doc_id long, text string").coalesce(1)
    assert kernel.text_frame(blank, "words").count() == onpages.corridors(blank).count() == onpages.search(blank, "x").count() == 0


@pytest.mark.parametrize("dehyphenate", [True, False])
def test_pattern(docs, chars, dehyphenate):
    for pattern in ("t[hi]e? [a-z]+", r"hyphenwell|-\S", "[0-9]*"):
        same(onpages.search_pattern(docs, pattern, dehyphenate=dehyphenate, hit_max=30), search.search_pattern(chars, pattern, dehyphenate=dehyphenate, hit_max=30))


def test_link_runs(spark, docs, chars):
    same(onpages.link_runs(docs, LINKS), spatial.link_runs(chars, spatial.literal(spark, LINKS, "id int, url string, x0 double, y0 double, x1 double, y1 double")))


def test_corridors(docs):
    words = kernel.text_frame(docs, "words")
    for allowed in (0, 1, 5):
        same(onpages.corridors(docs, allowed), statistics.corridors(statistics.coverage_profile(words), allowed))


def test_ruled_tables(spark, docs):
    rules = [(True, 60.0 + 90.0 * k, 72.0, 492.0) for k in range(5)] + [(False, 72.0 + 140.0 * k, 60.0, 420.0) for k in (0, 1, 3)] + [(False, 352.0, 60.0, 240.0)]
    rules += [(True, y, 500.0, 640.0) for y in (60.0, 75.0)] + [(False, x, 60.0, 75.0) for x in (500.0, 640.0)]
    words = kernel.text_frame(docs, "words")
    every = words.select("doc", "page").distinct().join(spatial.literal(spark, rules, "horizontal boolean, position double, start double, stop double"))
    same(onpages.ruled_tables(docs, rules), tables.find_tables(every, words))


@pytest.mark.parametrize("name", ["c07_search", "c07_pattern_search", "j02_link_runs", "w21_corridors", "c09_ruled_tables", "o05_sort_by_structure"])
def test_glyphs_are_no_rows(spark, docs, tmp_path, name):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "generate" not in plan
