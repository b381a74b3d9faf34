import zlib

import pytest
from pyspark.sql import functions as F

from papyrine.operators import frames
from papyrine.plans import layout
from papyrine.sources import pdf


def build(objects: list[bytes], extra: bytes = b"") -> bytes:
    """A file of the objects, numbered from 1; the first is the catalog."""
    out = b"%PDF-1.7\n"
    for k, o in enumerate(objects, 1):
        out += b"%d 0 obj\n" % k + o + b"\nendobj\n"
    return out + b"trailer\n<< /Root 1 0 R /Info 12 0 R " + extra + b">>\nstartxref\n0\n%%EOF"


def stream(data: bytes, info: bytes = b"", flate: bool = False) -> bytes:
    data = zlib.compress(data) if flate else data
    return b"<< /Length %d %s %s >>\nstream\n" % (len(data), b"/Filter /FlateDecode" * flate, info) + data + b"\nendstream"


def sample() -> bytes:
    one = rb"BT /F1 12 Tf 72 700 Td [(He) -20 (llo)] TJ ( wor\154d \(x\)) Tj 0 -14 Td (next line) Tj ET 0 0 1 RG 2 w 72 600 100 20 re S q 50 0 0 40 300 300 cm /Im1 Do Q /Fm1 Do"
    two = b"BT /F2 10 Tf 1 0 0 1 50 700 Tm <00410042> Tj 3 Tr (\x00A) Tj ET"
    cmap = b"1 beginbfchar <0041> <05D0> endbfchar 1 beginbfrange <0042> <0043> <0062> endbfrange"
    return build(
        [
            b"<< /Type /Catalog /Pages 2 0 R /Outlines 13 0 R /StructTreeRoot 15 0 R >>",
            b"<< /Type /Pages /Kids [3 0 R 4 0 R] /MediaBox [0 0 612 792] /Resources << /Font << /F1 5 0 R /F2 8 0 R >> /XObject << /Im1 10 0 R /Fm1 11 0 R >> >> >>",
            b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] /Annots [<< /Subtype /Link /Rect [72 690 130 712] /A << /URI (https://example.org/) >> >> << /Subtype /Link /Rect [0 0 9 9] /Dest [4 0 R /Fit] >> << /Subtype /Widget /Rect [1 1 2 2] /T (name) /V (Joe) >>] >>",
            b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R /Rotate 90 >>",
            b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Helvetica /FirstChar 32 /Widths [" + b"500 " * 95 + b"] >>",
            stream(one, flate=True),
            stream(two),
            b"<< /Type /Font /Subtype /Type0 /BaseFont /Deja /DescendantFonts [<< /DW 1000 /W [65 [600]] >>] /ToUnicode 9 0 R >>",
            stream(cmap, flate=True),
            stream(b"\x01\x02", b"/Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray"),
            stream(b"BT /F1 10 Tf 72 500 Td (form) Tj ET", b"/Subtype /Form /Matrix [1 0 0 1 10 0]"),
            b"<< /Title (A title) >>",
            b"<< /First 14 0 R >>",
            b"<< /Title (Second) /Dest [4 0 R /Fit] >>",
            b"<< /Type /StructTreeRoot /K << /S /H1 /Pg 3 0 R /K [0 << /S /Span /K 1 >>] >> >>",
        ]
    )


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.pdf", bytearray(sample())), ("b.pdf", bytearray(b"no pdf")), ("c.pdf", bytearray(build([b"<< /Type /Catalog >>"], b"/Encrypt << >> "))), ("d.pdf", None), ("e.pdf", bytearray(build([b"<< /Type /Catalog >>"])))]
    return spark.createDataFrame(rows, "path string, content binary")


def read(files, name):
    return pdf.read_pdf(files, name).collect()


def test_lines(files):
    g = pdf.read_pdf(files).withColumnRenamed("path", "doc")
    got = [(r.page, r.text) for r in frames.lines(layout.group_glyphs(g)).orderBy("page", "y0").collect()]
    assert got == [(0, "Hello world (x)"), (0, "next line"), (0, "form"), (1, "אbא")]
    first = g.where("page = 0 and gidx = 0").first()
    assert (first.px, first.py, first.size, first.font, first.color) == (72.0, 92.0, 12.0, "Helvetica", 0)
    assert g.where("c = 'f' and page = 0").first().px == 82.0
    assert [r.invisible for r in g.where("page = 1").orderBy("gidx").collect()] == [False, False, True]


def test_other_relations(files):
    assert [(r.page, r.width, r.height, r.rotation) for r in read(files, "pages")] == [(0, 612.0, 792.0, 0), (1, 612.0, 792.0, 90)]
    links = read(files, "links")
    assert [(r.uri, r.target, r.y0) for r in links] == [("https://example.org/", None, 80.0), (None, 1, 783.0)]
    assert [(r.field_name, r.field_value) for r in read(files, "annots") if r.type == "Widget"] == [("name", "Joe")]
    assert [(r.level, r.title, r.page) for r in read(files, "toc")] == [(1, "Second", 1)]
    assert [(r.x0, r.y0, r.x1, r.y1, r.width, r.colorspace) for r in read(files, "images")] == [(300.0, 452.0, 350.0, 492.0, 2, "DeviceGray")]
    d = read(files, "drawings")
    assert [(r.type, r.x0, r.y0, r.x1, r.y1, r.color, r.width, r["items"][0].op) for r in d] == [("s", 72.0, 172.0, 172.0, 192.0, 255, 2.0, "re")]
    assert [(r.role, r.parent, r.page, r.mcids) for r in read(files, "struct")] == [("Root", -1, -1, []), ("H1", 0, 0, [0]), ("Span", 1, 0, [1])]
    assert [(r.key, r.value) for r in read(files, "metadata")] == [("title", "A title")]
    assert {r.path for r in read(files, "errors")} == {"b.pdf", "c.pdf", "d.pdf"}
    assert pdf.read_pdf(files, "objects").where("path = 'a.pdf'").count() == 15
    with pytest.raises(ValueError):
        pdf.read_pdf(files, "nothing")


def test_lexer():
    x = pdf.Lexer(b"/A#20b <</K [1 -2.5 (a\\\n(b)\\053)]/R 3 0 R>> <4> true % no\n(\\7)").next
    assert x() == "A b"
    assert x() == {"K": [1, -2.5, b"a(b)+"], "R": pdf.Ref(3)}
    assert [x(), x(), x(), x()] == [b"@", True, b"\x07", None]


def test_object_streams_and_predictors(spark):
    inner = b"4 0 5 20 << /Type /Page >>   << /X 1 >>"
    data = b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Kids [4 0 R] >>\nendobj\n3 0 obj\n" + stream(inner, b"/Type /ObjStm /N 2 /First 9", True) + b"\nendobj\n"
    p = pdf.Pdf(data)
    assert len(p.pages()) == 1 and p.get(pdf.Ref(5)) == {"X": 1}
    assert pdf._unpredict(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])
    assert pdf._unpredict(bytes([1, 1, 2, 4, 1, 1]), {"Predictor": 15, "Columns": 2}) == bytes([1, 3, 2, 4])


def test_incremental_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(sample())
    s = spark.readStream.schema(spark.read.format("binaryFile").load(str(tmp_path / "in")).schema).format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(tmp_path / "in"))
    out = pdf.read_pdf(s, "pages").select("page", F.length("contents").alias("n"))
    q = out.writeStream.format("memory").queryName("pdf_pages").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT * FROM pdf_pages").count() == 2


def test_odd_files_are_reported(spark):
    """Wrong kinds of values where a file has something else: no other file suffers."""
    odd = {k: sample().replace(b"/Type /Page ", b"/Type /Page " + k + b" ").replace(b"/Type/Page/", b"/Type/Page" + k + b"/") for k in (b"/Annots 5", b"/Rotate [0]")}
    files = spark.createDataFrame([("good", bytearray(sample())), *((k.decode(), bytearray(v)) for k, v in odd.items()), ("none", bytearray(b"no file"))], "path string, content binary")
    words = pdf.read_pdf(files).select("path").distinct()
    assert "good" in {r.path for r in words.collect()}
    said = {r.path for r in pdf.read_pdf(files, "errors").collect()}
    assert "good" not in said and "none" in said
    for name in pdf.RELATIONS:
        pdf.read_pdf(files, name).collect()
