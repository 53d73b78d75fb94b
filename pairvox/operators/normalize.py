"""Intensity normalisation by volume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairvox.operators.quantiles import quantiles

#: Percentiles of the landmark method.
LANDMARKS = [0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.98]


def p99_normalize(df: DataFrame, *, volume: str, v: str, q: float = 0.99) -> DataFrame:
    """df with `norm`: values by the q-quantile of the volume's positive ones, cut to [0, 1]; 0 where there are none."""
    top = quantiles(df.filter(F.col(v) > 0), [volume], v, [q]).select(volume, F.get("quantiles", F.lit(0)).alias("_q"))
    scaled = F.when(F.col("_q") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(v) / F.col("_q")))).otherwise(0.0)
    return df.join(top, volume, "left").withColumn("norm", scaled).drop("_q")


def landmarks(df: DataFrame, *, volume: str, v: str, qs: list[float] = LANDMARKS) -> DataFrame:
    """(volume, marks): quantiles of each volume, of any size."""
    return quantiles(df, [volume], v, qs).select(volume, F.col("quantiles").alias("marks"))


def fit_scale(marks: DataFrame) -> DataFrame:
    """(k, target): the mean place of each landmark once volumes are scaled to [0, 1] between their first and last."""
    unit = marks.select(F.posexplode(F.transform("marks", lambda m: (m - F.get("marks", F.lit(0))) / F.nullif(F.element_at("marks", -1) - F.get("marks", F.lit(0)), F.lit(0.0)))).alias("k", "u"))
    return unit.groupBy("k").agg(F.avg("u").alias("target"))


def piecewise(v: Column, xs: Column, ys: Column) -> Column:
    """Linear between (x, y) pairs given as arrays in order, the end pieces going on outside."""
    n = F.size(xs)
    above = F.size(F.filter(xs, lambda x: x <= v))
    k = F.greatest(F.lit(1), F.least(above, n - 1))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    return y0 + (v - x0) * (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0))


def apply_scale(df: DataFrame, marks: DataFrame, scale: DataFrame, *, volume: str, v: str) -> DataFrame:
    """df with `norm`: each volume's landmarks mapped to the scale's, cut to [0, 1]. The scale is one short array."""
    targets = scale.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "target"))), lambda s: s["target"]).alias("_ys"))
    joined = df.join(marks, volume).join(F.broadcast(targets))
    return joined.withColumn("norm", F.greatest(F.lit(0.0), F.least(F.lit(1.0), piecewise(F.col(v), F.col("marks"), F.col("_ys"))))).drop("marks", "_ys")


def peak_targets(peaks: DataFrame, train: DataFrame, *, volume: str, center: str, mask: str, peak: str, default: float) -> DataFrame:
    """(center, mask, target, mean, std, n): medians of the training volumes' peaks; the default where a pair has none."""
    seen = peaks.join(train.select(volume).distinct(), volume, "left_semi").groupBy(center, mask)
    seen = seen.agg(F.median(peak).alias("target"), F.avg(peak).alias("mean"), F.stddev_pop(peak).alias("std"), F.count(peak).alias("n"))
    every = peaks.select(center, mask).distinct()
    return every.join(seen, [center, mask], "left").withColumn("target", F.coalesce("target", F.lit(default))).withColumn("n", F.coalesce("n", F.lit(0)))


def peaks_normalize(df: DataFrame, peaks: DataFrame, *, volume: str, v: str, transform: Callable[[Column, Column, Column], Column] = piecewise) -> DataFrame:
    """df with `norm`: peaks (volume, peak, target) mapped to their targets with (0, 0) as a first point; from 0 to 1.5 times the largest target, divided by it.

    transform maps a value, given the arrays of places and of targets: `piecewise`, or an expression of a caller's.
    """
    pairs = F.array_sort(F.collect_list(F.struct("peak", "target")))
    marks = peaks.filter("peak > 0").groupBy(volume).agg(pairs.alias("_p"))
    xs = F.concat(F.array(F.lit(0.0)), F.transform("_p", lambda s: s["peak"]))
    ys = F.concat(F.array(F.lit(0.0)), F.transform("_p", lambda s: s["target"]))
    top = 1.5 * F.array_max(ys)
    mapped = transform(F.col(v), xs, ys)
    return df.join(marks, volume).withColumn("norm", F.greatest(F.lit(0.0), F.least(top, mapped)) / top).drop("_p")


def normalize_failures(df: DataFrame, peaks: DataFrame, *, volume: str) -> DataFrame:
    """(volume, reason) of volumes without a usable peak."""
    good = peaks.filter("peak > 0").select(volume).distinct()
    return df.select(volume).distinct().join(good, volume, "left_anti").withColumn("reason", F.lit("no positive peak"))


#: Contrasts whose fluid is darker than brain tissue; in the others it is brighter.
DARK_FLUID = ("t1", "t1c", "flair")


def tissue_masks(df: DataFrame, splits: DataFrame, *, volume: str, v: str, contrast: str | None = None, brain: str | None = None, eroded: str | None = None) -> DataFrame:
    """df with `tissue`: csf on the side of the split that the contrast names (t1 if none), else brain.

    With the columns `brain` and `eroded` (masks), csf is taken from the eroded mask and brain from the whole one; pixels
    that are neither go.
    """
    dark = (contrast or "t1").lower() in DARK_FLUID
    csf = F.col(v) <= F.col("split") if dark else F.col(v) >= F.col("split")
    inside = lambda m: F.col(m) if m else F.lit(True)
    tissue = F.when(csf & inside(eroded), "csf").when(~csf & inside(brain), "brain")
    return df.join(splits, volume).withColumn("tissue", tissue).drop("split").filter("tissue IS NOT NULL")
