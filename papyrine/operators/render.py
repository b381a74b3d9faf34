"""Geometry and decisions around raster images; pixels themselves are not made here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codecs that are kept as they are (fixed values).
SPECIALISED = ["JBIG2Decode", "JPXDecode", "CCITTFaxDecode"]
RESAMPLE_ABOVE = 1.3


def pixel_size(width: float, height: float, dpi: float | None = None, scale: float | None = None, max_side: int | None = None, size: tuple | None = None) -> tuple[int, int]:
    """Pixels of a page of width by height points, by one of four rules."""
    given = [x is not None for x in (dpi, scale, max_side, size)]
    if sum(given) > 1:
        raise ValueError("dpi, scale, max_side and size exclude each other")
    whole = lambda v: max(1, int(v + 0.5 + 1e-9))
    if size is not None:
        w, h = size
        if w is None and h is None:
            raise ValueError("size needs a width or a height")
        if w is None:
            return whole(width * h / height), int(h)
        return int(w), int(h) if h is not None else whole(height * w / width)
    if max_side is not None:
        scale = max_side / max(width, height)
    elif scale is None:
        scale = (72.0 if dpi is None else dpi) / 72.0
    return whole(width * scale), whole(height * scale)


def tiles(pages: DataFrame, side: int) -> DataFrame:
    """A row for each tile of pages (w, h in pixels): col, row, tile_w, tile_h."""
    count = lambda c: F.sequence(F.lit(0), F.ceil(F.col(c) / side).cast("int") - 1)
    rows = pages.where("w > 0 and h > 0").withColumn("col", F.explode(count("w"))).withColumn("row", F.explode(count("h")))
    return rows.withColumn("tile_w", F.least(F.lit(side), F.col("w") - F.col("col") * side)).withColumn("tile_h", F.least(F.lit(side), F.col("h") - F.col("row") * side))


def image_decisions(images: DataFrame, target_dpi: int) -> DataFrame:
    """Adds action and reason to images (filter, bits, colorspace, dpi)."""
    special, bilevel = F.col("filter").isin(SPECIALISED), F.col("bits") == 1
    plain = F.col("colorspace").isin("DeviceRGB", "DeviceGray") & (F.col("bits") == 8)
    action = F.when(special, "kept").when(bilevel, "g4").when(~plain, "kept").when(F.col("dpi") > target_dpi * RESAMPLE_ABOVE, "resampled").otherwise("recompressed")
    reason = F.when(special, "already a specialised codec").when(bilevel, "").when(~plain, "colour space or bit depth not handled").otherwise("")
    return images.withColumn("action", action).withColumn("reason", reason)
