"""Column expressions on boxes and page coordinates (points, origin at the top left, y down)."""

from __future__ import annotations

from pyspark.sql import functions as F


def overlap(a0, a1, b0, b1):
    """Length that two intervals share, 0 at least."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def area(p: str = ""):
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def shared(a: str, b: str):
    """Area of the intersection of boxes whose columns start with prefixes a and b."""
    c = lambda p, k: F.col(f"{p}{k}")
    return overlap(c(a, "x0"), c(a, "x1"), c(b, "x0"), c(b, "x1")) * overlap(c(a, "y0"), c(a, "y1"), c(b, "y0"), c(b, "y1"))


def cover(a: str, b: str):
    """Part of box a that box b covers; a box without area is covered if its centre is."""
    c = lambda p, k: F.col(f"{p}{k}")
    mx, my = (c(a, "x0") + c(a, "x1")) / 2, (c(a, "y0") + c(a, "y1")) / 2
    inside = (mx >= c(b, "x0")) & (mx <= c(b, "x1")) & (my >= c(b, "y0")) & (my <= c(b, "y1"))
    return F.when(area(a) > 0, shared(a, b) / area(a)).otherwise(inside.cast("double"))


def iou(a: str, b: str):
    union = area(a) + area(b) - shared(a, b)
    return F.when(union > 0, shared(a, b) / union).otherwise(0.0)


def rotate(df, rotation, width: float, height: float):
    """Boxes of a page as displayed: rotation is 0, 90, 180 or 270 degrees clockwise."""
    at = lambda x, y: (
        F.when(rotation == 90, height - y).when(rotation == 180, width - x).when(rotation == 270, y).otherwise(x),
        F.when(rotation == 90, x).when(rotation == 180, height - y).when(rotation == 270, width - x).otherwise(y),
    )
    (ax, ay), (bx, by) = at(F.col("x0"), F.col("y0")), at(F.col("x1"), F.col("y1"))
    new = {"x0": F.least(ax, bx), "y0": F.least(ay, by), "x1": F.greatest(ax, bx), "y1": F.greatest(ay, by)}
    return df.withColumns(new)


def half_up(v):
    """Whole pixels: halves go up."""
    return F.floor(v + 0.5 + 1e-9).cast("int")


def pixels(v, dpi: float):
    """Whole pixels for exports: halves go to even."""
    return F.bround(v * (dpi / 72.0), 0).cast("int")


def turned(dx, dy, rotation):
    """A direction on a page as displayed."""
    return (
        F.when(rotation == 90, -dy).when(rotation == 180, -dx).when(rotation == 270, dy).otherwise(dx),
        F.when(rotation == 90, dx).when(rotation == 180, -dy).when(rotation == 270, -dx).otherwise(dy),
    )


def angle(dx, dy):
    """Of a direction (y down), counterclockwise, from 0 to a full turn."""
    return F.pmod(F.atan2(-dy, dx), F.lit(2 * 3.141592653589793))


def extents(ascent, descent):
    """(ascent, descent) of a font: defaults where both are zero or the wrong way round, under one size scaled to one."""
    odd = (ascent <= 0) & (descent >= 0)
    a, d = F.when(odd, 0.8).otherwise(ascent), F.when(odd, -0.2).otherwise(descent)
    high = a - d
    small = (high > 0) & (high < 1)
    return F.when(small, a / high).otherwise(a), F.when(small, d / high).otherwise(d)


def is_rectangle(points):
    """Whether points (an array of x, y) are the four corners of an upright rectangle, the first one repeated or not."""
    same = lambda a, b, c: F.abs(a[c] - b[c]) < 1e-6
    n = F.size(points)
    closed = (n == 5) & same(points[0], F.get(points, F.lit(4)), "x") & same(points[0], F.get(points, F.lit(4)), "y")
    own = F.when(closed, F.slice(points, 1, 4)).otherwise(points)
    upright = lambda k: same(own[k], own[(k + 1) % 4], "x") | same(own[k], own[(k + 1) % 4], "y")
    return F.when(F.size(own) == 4, upright(0) & upright(1) & upright(2) & upright(3)).otherwise(False)


def argb(r, g, b, a=None):
    """A colour of 0 to 255 a channel as one number, alpha highest."""
    channel = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c).cast("long")))
    alpha = F.lit(255).cast("long") if a is None else channel(a)
    return F.shiftleft(alpha, 24) + F.shiftleft(channel(r), 16) + F.shiftleft(channel(g), 8) + channel(b)
