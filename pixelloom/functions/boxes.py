"""Boxes of recognised text: the scale a picture is read at, boxes on the picture itself, and their margins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longer edge that text is read best at, and the most a picture is enlarged for it.
EDGE, MOST = 2000, 2.0
#: Fixed value: the margin around a word, as a share of its height.
MARGIN = 0.35


def reading_scale(width: Column, height: Column, limit: Column | int) -> Column:
    """By how much the read picture is wider than the picture: shrunk to the reader's limit, enlarged towards EDGE but at most MOST times; from the whole-number width that it gets. 1 for pictures without size."""
    longest = F.greatest(width, height)
    shrunk = F.greatest(F.lit(1), F.floor(width * (limit / longest)))
    grown = F.rint(width * F.least(F.lit(MOST), F.lit(float(EDGE)) / longest))
    return F.when((width <= 0) | (longest <= 0), 1.0).when(longest > limit, shrunk / width).when((longest < EDGE) & (grown > 0), grown / width).otherwise(1.0)


def on_picture(box: Column, scale: Column) -> Column:
    """A box (x, y, w, h) of the read picture on the picture itself; a scale of 0 or less counts as 1."""
    s = F.when(scale <= 0, 1.0).otherwise(scale)
    return F.struct(*((box[c] / s).alias(c) for c in ("x", "y", "w", "h")))


def padded(box: Column, width: Column, height: Column, margin: float = MARGIN) -> Column:
    """The box (x, y, w, h) with a margin of a share of its height, in whole pixels and within the picture; null if nothing of it is left."""
    air = box["h"] * margin

    def along(start: Column, length: Column, most: Column) -> tuple[Column, Column]:
        within = lambda v: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
        return F.floor(within(start - air)), F.ceil(within(start + length + air))

    (left, right), (top, low) = along(box["x"], box["w"], width), along(box["y"], box["h"], height)
    return F.when((right > left) & (low > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (low - top).alias("h")))
