"""Rasters in long form (image, x, y, v): gradients, blurs, spreads, histograms."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import once


def pixels(table: DataFrame, width: int, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    long = table.select(F.col(key).alias("image"), F.posexplode(F.col(values).cast("array<double>")).alias("p", "v"))
    return long.select("image", (F.col("p") % width).alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"), "v")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def box_mean(px: DataFrame, radius: int) -> DataFrame:
    """Adds `mean` over the (2 radius + 1)-sided box, clipped at the border: sums along x, then along y."""
    wx = Window.partitionBy("image", "y").orderBy("x").rangeBetween(-radius, radius)
    wy = Window.partitionBy("image", "x").orderBy("y").rangeBetween(-radius, radius)
    rows = px.withColumn("_s", F.sum("v").over(wx)).withColumn("_n", F.count("v").over(wx))
    return rows.withColumn("mean", F.sum("_s").over(wy) / F.sum("_n").over(wy)).drop("_s", "_n")


def high_pass(px: DataFrame, radius: int = 6) -> DataFrame:
    return box_mean(px, radius).withColumn("v", F.col("v") - F.col("mean")).drop("mean")


def blur(px: DataFrame) -> DataFrame:
    return box_mean(px, 1).withColumn("v", F.col("mean")).drop("mean")


def sobel(px: DataFrame) -> DataFrame:
    """(image, x, y, magnitude, orientation) of inner pixels; orientation within 0..pi."""
    wx, wy = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    smooth = lambda c, w: F.lag(c, 1).over(w) + 2 * F.col(c) + F.lead(c, 1).over(w)
    # Smooth along one axis, differ along the other.
    g = px.withColumn("sy", smooth("v", wy)).withColumn("sx", smooth("v", wx))
    g = g.withColumn("gx", F.lead("sy", 1).over(wx) - F.lag("sy", 1).over(wx)).withColumn("gy", F.lead("sx", 1).over(wy) - F.lag("sx", 1).over(wy))
    g = g.filter("gx is not null and gy is not null")
    angle = F.atan2("gy", "gx")
    return g.select("image", "x", "y", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("magnitude"), F.when(angle < 0, angle + math.pi).otherwise(angle).alias("orientation"))


def shape_descriptor(gradients: DataFrame, bins: int = 36, noise: float = 0.10) -> DataFrame:
    """(image, bin, weight): orientation histogram of unit length, each gradient split on two neighbouring bins; gradients up to `noise` of the strongest are left out."""
    top = Window.partitionBy("image")
    g = gradients.withColumn("_top", F.max("magnitude").over(top)).filter(F.col("magnitude") > F.col("_top") * noise)
    at = F.col("orientation") / (math.pi / bins)
    g = g.withColumn("b", (F.floor(at) % bins).cast("int")).withColumn("f", at - F.floor(at))
    parts = F.array(F.struct(F.col("b").alias("bin"), (F.col("magnitude") * (1 - F.col("f"))).alias("w")), F.struct(((F.col("b") + 1) % bins).alias("bin"), (F.col("magnitude") * F.col("f")).alias("w")))
    hist = g.select("image", F.explode(parts).alias("e")).groupBy("image", F.col("e.bin").alias("bin")).agg(F.sum("e.w").alias("weight"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("image")))
    return hist.withColumn("weight", F.when(norm > 1e-9, F.col("weight") / norm).otherwise(F.col("weight")))


def descriptor_array(hist: DataFrame, bins: int = 36) -> DataFrame:
    """(image, descriptor) with zeros for empty bins."""
    m = hist.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("bin", "weight"))).alias("m"))
    return m.select("image", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0))).alias("descriptor"))


def spread(px: DataFrame, scale: float = 255.0) -> DataFrame:
    return px.groupBy("image").agg((F.stddev_pop("v") / scale).alias("spread"))


def edge_density(px: DataFrame, least: float = 1.0) -> DataFrame:
    """(image, density): mean absolute difference of horizontal neighbours over the standard deviation; 0 where that is below `least`."""
    w = Window.partitionBy("image", "y").orderBy("x")
    out = px.withColumn("d", F.abs(F.col("v") - F.lag("v", 1).over(w))).groupBy("image").agg(F.avg("d").alias("d"), F.stddev_pop("v").alias("s"))
    return out.select("image", F.when(F.col("s") < least, F.lit(0.0)).otherwise(F.col("d") / F.col("s")).alias("density"))


def bands(px: DataFrame, n: int, height: int) -> DataFrame:
    """(image, band, v): mean of each horizontal band."""
    return px.groupBy("image", F.floor(F.col("y") * n / height).cast("int").alias("band")).agg(F.avg("v").alias("v"))


def histogram(px: DataFrame, levels: int, low: float, high: float) -> DataFrame:
    """(image, level, n) of values cut into equal levels."""
    level = F.least(F.greatest(F.floor((F.col("v") - low) / (high - low) * levels), F.lit(0)), F.lit(levels - 1)).cast("int")
    return px.groupBy("image", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def resampled(px: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Area average onto a smaller grid with whole-number cell bounds."""
    return px.groupBy("image", F.floor(F.col("x") * new_width / width).cast("int").alias("x"), F.floor(F.col("y") * new_height / height).cast("int").alias("y")).agg(F.avg("v").alias("v"))


# Pictures as one array of values for each image, row by row: windows are cut out of it without copying the picture for each of them.


def bilinear(values: Column, width: int, height: int, new_width: int, new_height: int) -> Column:
    """The picture on another grid whose corners are the old corners, by bilinear interpolation."""

    def along(n: int, new: int) -> Column:
        """Where the new values of a side lie: between which old ones, and how far from the first."""
        at = [i * ((n - 1) / (new - 1)) if new > 1 else 0.0 for i in range(new)]
        low = [min(int(x), n - 1) for x in at]
        return F.array(*(F.struct(F.lit(k).alias("low"), F.lit(min(k + 1, n - 1)).alias("high"), F.lit(x - k).alias("far")) for x, k in zip(at, low, strict=True)))

    def picture(v: Column) -> Column:
        def one(y: Column, x: Column) -> Column:
            def between(row: Column) -> Column:
                return F.get(v, row * width + x.low) + (F.get(v, row * width + x.high) - F.get(v, row * width + x.low)) * x.far

            return between(y.low) + (between(y.high) - between(y.low)) * y.far

        return F.flatten(F.transform(along(height, new_height), lambda y: F.transform(along(width, new_width), lambda x: one(y, x))))

    return once(values, picture)


def crop(values: Column, width: int, x: Column | int, y: Column | int, w: int, h: int) -> Column:
    """The window of w x h values whose upper left corner is (x, y)."""
    x, y = (F.lit(c) if isinstance(c, int) else c for c in (x, y))
    return F.flatten(F.transform(F.sequence(y, y + (h - 1)), lambda r: F.slice(values, (r * width + x + 1).cast("int"), F.lit(w))))


def heat_map(values: Column, width: int, height: int, score: Callable[[Column], Column], grid: int = 4, least: int = 4) -> Column:
    """Array of (row, col, score) of the grid x grid windows of a picture; null if a window has fewer than `least` values along a side."""
    w, h = width // grid, height // grid
    if w < least or h < least:
        return F.lit(None).cast("array<struct<row: int, col: int, score: double>>")
    places = F.sequence(F.lit(0), F.lit(grid * grid - 1))
    return F.transform(places, lambda i: F.struct(F.floor(i / grid).cast("int").alias("row"), (i % grid).alias("col"), score(crop(values, width, (i % grid) * w, (F.floor(i / grid) * h).cast("int"), w, h)).alias("score")))


def crop_places(width: int, height: int, share: float = 0.45, least: int = 8) -> list[tuple[int, int, int]] | None:
    """(x, y, side) of the square windows in the middle and in the four corners, `share` of the shorter side wide; None below `least`."""
    side = int(min(width, height) * share)
    if side < least:
        return None
    right, low = width - side, height - side
    return [(right // 2, low // 2, side), (0, 0, side), (right, 0, side), (0, low, side), (right, low, side)]


def crops(values: Column, width: int, height: int, share: float = 0.45, least: int = 8) -> Column:
    """Array of (area, x, y, side, values) of crop_places(), null where there are none."""
    places = crop_places(width, height, share, least)
    if places is None:
        return F.lit(None).cast("array<struct<area: int, x: int, y: int, side: int, values: array<double>>>")
    return F.array(*(F.struct(F.lit(i).alias("area"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(s).alias("side"), crop(values, width, x, y, s, s).alias("values")) for i, (x, y, s) in enumerate(places)))


def colour_bands(px: DataFrame, n: int, height: int) -> DataFrame:
    """(image, band, r, g, b): mean colour of each horizontal band, weighted by opacity; a band that is wholly clear carries on the colour of the band
    above, bands above the first colour are null, images without any colour have no rows. px: (image, y, r, g, b, a)."""
    band = F.floor((F.col("y") * n + n - 1) / height).cast("int") if height < n else F.floor(((F.col("y") + 1) * n - 1) / height).cast("int")
    mean = lambda c: F.sum(F.col(c) * F.col("a")) / F.when(F.sum("a") > 0, F.sum("a"))
    known = px.groupBy("image", band.alias("band")).agg(*(mean(c).alias(c) for c in "rgb"))
    whole = known.groupBy("image").agg(F.max("r").alias("_any")).filter("_any is not null").select("image", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("band"))
    above = Window.partitionBy("image").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    out = whole.join(known, ["image", "band"], "left")
    return out.select("image", "band", *(F.floor(F.last(c, ignorenulls=True).over(above)).cast("long").alias(c) for c in "rgb"))


def has_grey_last_row(rows: DataFrame, share: float = 0.9, grey: int = 128) -> DataFrame:
    """(image, grey): whether more than `share` of a picture's last row is exactly mid-grey, as a broken decode leaves it. rows: (image, width, height, x, y, r, g, b)."""
    exact = (F.col("r") == grey) & (F.col("g") == grey) & (F.col("b") == grey)
    return rows.filter(F.col("y") == F.col("height") - 1).groupBy("image").agg((F.count_if(exact) > F.floor(F.max("width") * share)).alias("grey"))


#: Mean and standard deviation of the channels that the networks expect.
MEANS, SPREADS = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


def network_input(channels: list[Column], width: int, height: int, side: int = 224) -> Column:
    """One array, channel after channel, of a picture given by an array of 0..255 for each channel: on a square grid, rounded to bytes, scaled and standardised."""

    def standard(mean: float, spread: float) -> Callable[[Column], Column]:
        return lambda v: (F.floor(v + 0.5) / 255.0 - mean) / spread

    return F.concat(*(F.transform(bilinear(c, width, height, side, side), standard(m, s)) for c, m, s in zip(channels, MEANS, SPREADS, strict=True)))
