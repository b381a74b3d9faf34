import pytest

from papyrine import api
from tests.test_pdf import sample


def test_from_file_to_frames(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sample())
    g = api.open(spark, str(tmp_path / "*.pdf"))
    assert {r.text for r in api.records(g, "words").where("page = 0").collect()} == {"Hello", "world", "(x)", "next", "line", "form"}
    text = {r.page: r.text for r in api.get_text(g, sort="xycut").collect()}
    assert text[0].split("\n")[:2] == ["Hello world (x)", "next line"]
    assert api.get_text(g.where("page = 0"), "words", box=(72, 80, 120, 96)).count() == 2
    assert api.get_text(g, "blocks", sort="simple").count() >= 2
    for f in api.FORMATS:
        assert api.export(g, f).count() == 2
    path = api.to_parquet(g, str(tmp_path / "out"), "lines")
    assert spark.read.parquet(path).columns[:4] == ["doc", "page", "block", "line"]
    assert spark.read.option("header", True).csv(api.to_csv(g, str(tmp_path / "csv"))).count() == api.records(g).count()
    assert api.to_arrow(g).num_rows == len(api.to_pandas(g)) == len(api.words_array(g)["text"])
    assert spark.read.json(api.to_jsonl(g, str(tmp_path / "jsonl"))).count() == api.records(g).count()
    assert [p for _, p, _ in api.iter_pages(g)] == [0, 1] and [r["metadata"]["page"] for r in api.iter_texts(g, "-1,0-")] == [1, 0, 1]
    assert [r.pages for r in api.page_count(g).collect()] == [2]
    for bad in (lambda: api.records(g, "no"), lambda: api.export(g, "no"), lambda: api.get_text(g, "no"), lambda: api.get_text(g, sort="no")):
        with pytest.raises(ValueError):
            bad()


def test_lines_from_right_to_left(spark):
    rows = [(1, 0, 100 * y + k, c, 10.0 + 6 * k, 20.0 + 12 * y, 16.0 + 6 * k, 20.0 + 12 * y, 1.0, 0.0, 10.0, "Serif", 0) for y, line in enumerate(("םולש", "זופת")) for k, c in enumerate(line)]
    g = spark.createDataFrame(rows, "doc long, page int, gidx long, c string, px double, py double, qx double, qy double, dx double, dy double, size double, font string, color long")
    assert api.get_text(g).first().text.split() == ["שלום", "תפוז"]
