"""Slices as arrays: (volume_id, z, height, width, px), px row by row. No step explodes pixels unless it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(slices: DataFrame) -> DataFrame:
    """(volume_id, z, y, x, v), one row a pixel."""
    out = slices.select("volume_id", "z", "width", F.posexplode("px").alias("i", "v"))
    return out.select("volume_id", "z", F.expr("i div width").alias("y"), (F.col("i") % F.col("width")).cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def _grid(height: Column | int, width: Column | int, at) -> Column:
    """An array of height x width values at(y, x)."""
    h, w = (F.lit(a) if isinstance(a, int) else a for a in (height, width))
    cells = F.sequence(F.lit(0).cast("long"), (h * w - 1).cast("long"))
    return F.transform(cells, lambda i: at(F.floor(i / w).cast("int"), (i % w).cast("int")))


def _pixel(y: Column, x: Column, background: float | None = None) -> Column:
    """The pixel at (y, x), the background outside."""
    inside = F.get("px", (y * F.col("width") + x).cast("int"))
    if background is None:
        return inside
    return F.when((y >= 0) & (y < F.col("height")) & (x >= 0) & (x < F.col("width")), inside).otherwise(F.lit(background).cast("double"))


def _resized(slices: DataFrame, height: Column | int, width: Column | int, at) -> DataFrame:
    new = slices.withColumn("px", _grid(height, width, at))
    cast = lambda a: (F.lit(a) if isinstance(a, int) else a).cast("int")
    return new.withColumns({"height": cast(height), "width": cast(width)})


def crop_pad_xy(slices: DataFrame, target: int, background: float) -> DataFrame:
    """Each side padded to the target (half before), then cut to it round the centre."""
    start = lambda n: F.when(n >= target, F.floor((n - target) / 2)).otherwise(-F.floor((target - n) / 2)).cast("int")
    return _resized(slices, target, target, lambda y, x: _pixel(y + start(F.col("height")), x + start(F.col("width")), background))


def recenter(slices: DataFrame, height: int, width: int, background: float) -> DataFrame:
    """Slices in the middle of another shape, padded or cut on each axis."""
    start = lambda n, t: F.when(n >= t, F.floor((n - t) / 2)).otherwise(-F.floor((t - n) / 2)).cast("int")
    return _resized(slices, height, width, lambda y, x: _pixel(y + start(F.col("height"), height), x + start(F.col("width"), width), background))


def downsample2(slices: DataFrame) -> DataFrame:
    """Even rows and columns."""
    half = lambda c: F.floor((F.col(c) + 1) / 2)
    return _resized(slices, half("height"), half("width"), lambda y, x: _pixel(2 * y, 2 * x))


def upsample2(slices: DataFrame) -> DataFrame:
    """Each pixel four times: the parent is the coordinate div 2."""
    return _resized(slices, F.col("height") * 2, F.col("width") * 2, lambda y, x: _pixel(F.floor(y / 2).cast("int"), F.floor(x / 2).cast("int")))


def transpose(slices: DataFrame) -> DataFrame:
    """A quarter turn back and a left-right flip; its own inverse."""
    return _resized(slices, F.col("width"), F.col("height"), lambda y, x: _pixel(x, y))


def mask_bbox_xy(pixels_: DataFrame, *, margin: int, height: int, width: int) -> DataFrame:
    """(volume_id, y0, y1, x0, x1): one half-open box over all z of pixels > 0, with a margin inside the image."""
    box = pixels_.filter("v > 0").groupBy("volume_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    low = lambda c: F.greatest(F.col(c) - margin, F.lit(0)).cast("long").alias(c)
    high = lambda c, n: F.least(F.col(c) + 1 + margin, F.lit(n)).cast("long").alias(c)
    return box.select("volume_id", low("y0"), high("y1", height), low("x0"), high("x1", width))


def crop_to_bbox(slices: DataFrame, boxes: DataFrame) -> DataFrame:
    """Slices cut to their volume's box; a volume without one goes to `missing` of the caller (anti-join)."""
    joined = slices.join(boxes, "volume_id")
    out = _resized(joined, (F.col("y1") - F.col("y0")).cast("int"), (F.col("x1") - F.col("x0")).cast("int"), lambda y, x: _pixel((y + F.col("y0")).cast("int"), (x + F.col("x0")).cast("int")))
    return out.drop("y0", "y1", "x0", "x1")


def trim_ends(slices: DataFrame) -> DataFrame:
    """Without the first and last z of volumes with more than two slices."""
    ends = slices.groupBy("volume_id").agg(F.min("z").alias("_a"), F.max("z").alias("_b"), F.count("*").alias("_n"))
    return slices.join(ends, "volume_id").filter("_n <= 2 OR (z > _a AND z < _b)").drop("_a", "_b", "_n")


def pseudo3d(slices: DataFrame) -> DataFrame:
    """Slices with the pixels of their neighbours in z, `below` and `above`; the ends go."""
    w = Window.partitionBy("volume_id").orderBy("z")
    return slices.select("*", F.lag("px").over(w).alias("below"), F.lead("px").over(w).alias("above")).filter("below IS NOT NULL AND above IS NOT NULL")


def stack(slices: DataFrame) -> DataFrame:
    """Slices with `position`, their place from 0 in z order with holes closed up."""
    return slices.withColumn("position", (F.row_number().over(Window.partitionBy("volume_id").orderBy("z")) - 1).cast("long"))


def align_trimmed_mask(image: DataFrame, mask: DataFrame) -> DataFrame:
    """(volume_id, z, px, mask): a mask with two slices more than its image loses its first and last one. z counts from 0 in both."""
    count = lambda df, n: df.groupBy("volume_id").agg(F.count("*").alias(n))
    sizes = count(image, "_ni").join(count(mask, "_nm"), "volume_id")
    shift = F.when(F.col("_nm") == F.col("_ni") + 2, 1).otherwise(0)
    moved = mask.join(sizes, "volume_id").select("volume_id", (F.col("z") - shift).alias("z"), F.col("px").alias("mask"))
    return image.select("volume_id", "z", "px").join(moved, ["volume_id", "z"])


def middle_slice(slices: DataFrame) -> DataFrame:
    """The slice at place n div 2 of each volume and the number of slices."""
    n = slices.groupBy("volume_id").agg(F.count("*").alias("slices"))
    return stack(slices).join(n, "volume_id").filter(F.col("position") == F.expr("slices div 2")).drop("position")


def concat_ab(a: DataFrame, b: DataFrame) -> DataFrame:
    """A and B of equal shape side by side, rows of twice the width."""
    other = b.select("volume_id", "z", F.col("px").alias("_b"), F.col("height").alias("_h"), F.col("width").alias("_w"))
    joined = a.join(other, ["volume_id", "z"]).filter("height = _h AND width = _w")
    row = lambda c, y: F.slice(c, y * F.col("width") + 1, F.col("width"))
    px = F.flatten(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.concat(row("px", y), row("_b", y))))
    return joined.withColumn("px", px).withColumn("width", F.col("width") * 2).drop("_b", "_h", "_w")


def split_ab(ab: DataFrame) -> tuple[DataFrame, DataFrame]:
    half = F.expr("width div 2").cast("int")
    side = lambda k: ab.withColumn("px", F.flatten(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.slice("px", y * F.col("width") + 1 + k * half, half)))).withColumn("width", half)
    return side(0), side(1)


def verify_ab(ab: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume_id, z, max_a, max_b): the largest difference between each half and its source."""
    left, right = split_ab(ab)
    gap = lambda half, df, n: half.select("volume_id", "z", F.col("px").alias("_p")).join(df.select("volume_id", "z", "px"), ["volume_id", "z"]).select("volume_id", "z", F.array_max(F.zip_with("_p", "px", lambda p, q: F.abs(p - q))).cast("double").alias(n))
    return gap(left, a, "max_a").join(gap(right, b, "max_b"), ["volume_id", "z"])


def voxel_spacing(affine: Column) -> Column:
    """Lengths of the first three columns of a 4 x 4 affine given as an array of rows."""
    return F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: F.sqrt(F.aggregate(F.slice(affine, 1, 3), F.lit(0.0), lambda s, r: s + F.get(r, j) * F.get(r, j))))
