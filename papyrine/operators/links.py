"""Links of pages: what they lead to, those found in the text, and annotations that go with others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions.geometry import shared


def link_url():
    """Where a link (uri, kind, page from 0, file) leads: its URI, a page from 1, a file, or nothing."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    inner = (F.col("kind") == "goto") & (F.col("page") >= 0)
    return F.when(filled("uri"), F.col("uri")).when(F.coalesce(inner, F.lit(False)), F.concat(F.lit("#page="), (F.col("page") + 1).cast("string"))).when(filled("file"), F.col("file")).otherwise("")


def with_auto_links(links: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """doc, page, auto, url, box: links of the page (doc, page, url, box) and those found in its text, without those that
    a link with a URI covers by over `least`."""
    box = ["x0", "y0", "x1", "y1"]
    own = links.where("url != ''").select("doc", "page", *[F.col(c).alias(f"l_{c}") for c in box])
    rows = found.withColumns({f"f_{c}": F.col(c) for c in box})
    area = F.greatest((F.col("f_x1") - F.col("f_x0")) * (F.col("f_y1") - F.col("f_y0")), F.lit(1e-9))
    covered = (rows["doc"] == own["doc"]) & (rows["page"] == own["page"]) & (shared("f_", "l_") / area > least)
    kept = rows.join(own, covered, "left_anti")
    cols = ["doc", "page", "url", *box]
    return links.select(*cols, F.lit(False).alias("auto")).unionByName(kept.select(*cols, F.lit(True).alias("auto")))


def link_boxes(runs: DataFrame) -> DataFrame:
    """doc, page, url, box: the union of the boxes (doc, page, url, box) of each link of a page."""
    return runs.where("url != ''").groupBy("doc", "page", "url").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def without_redactions(annots: DataFrame) -> DataFrame:
    """annots (id, parent, type) less redaction marks and the popups that belong to them."""
    marks = annots.where("type = 'Redact'").select(F.col("id").alias("mark"))
    own = annots.where("type != 'Redact'")
    return own.join(marks, (own["type"] == "Popup") & (own["parent"] == marks["mark"]), "left_anti")


def of_types(annots: DataFrame, types: list[str]) -> DataFrame:
    return annots.where(F.col("type").isin(types))
