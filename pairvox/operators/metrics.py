"""Image metrics by slice and volume, and tables of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairvox.operators.joins import numbered
from pairvox.operators.quantiles import beside, by_groups, quantiles
from pairvox.operators.splits import random_subset

#: Dynamic range of HU, constants of the similarity index.
HU_RANGE, SSIM_K = 2224.0, (0.01, 0.03)


def psnr(mse: Column, data_range: float = HU_RANGE) -> Column:
    return F.when(mse == 0, float("inf")).otherwise(10 * F.log10(data_range * data_range / mse))


def slice_metrics(px: DataFrame, *, groups: list[str], real: str, fake: str, mask: str, data_range: float = HU_RANGE) -> DataFrame:
    """Means of errors over all pixels and over the mask, and the mask's size; an empty mask counts as all pixels."""
    d = F.col(real) - F.col(fake)
    inside = lambda e: F.avg(F.when(F.col(mask), e))
    out = px.groupBy(*groups).agg(
        F.avg(F.abs(d)).alias("mae_unmasked"), F.coalesce(inside(F.abs(d)), F.avg(F.abs(d))).alias("mae_masked"),
        F.avg(d * d).alias("mse_unmasked"), F.coalesce(inside(d * d), F.avg(d * d)).alias("mse_masked"), F.count_if(mask).alias("mask_voxels"),
    )
    return out.withColumns({f"psnr_{s}": psnr(F.col(f"mse_{s}"), data_range) for s in ("unmasked", "masked")})


def array_metrics(aligned: DataFrame, *, real: str = "px", fake: str = "synthetic", mask: str = "mask", data_range: float = HU_RANGE) -> DataFrame:
    """`slice_metrics` of aligned slices, on their arrays: (volume_id, z, errors, mask_voxels). A null or empty mask counts as all pixels, its size as 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    held = F.coalesce(F.col(mask), F.transform(F.col(real), lambda x: F.lit(0.0)))
    out = aligned.select("volume_id", "z", F.zip_with(real, fake, lambda x, y: (x - y).cast("double")).alias("_d"), F.transform(held, lambda x: (x > 0).cast("double")).alias("_m"))
    out = out.withColumn("_n", total("_m"))
    for name, error in (("mae", lambda x: F.abs(x)), ("mse", lambda x: x * x)):
        out = out.withColumn("_e", F.transform("_d", error))
        mean, inside = total("_e") / F.size("_e"), total(F.zip_with("_e", "_m", lambda x, k: x * k)) / F.nullif(F.col("_n"), F.lit(0.0))
        out = out.withColumn(f"{name}_unmasked", mean).withColumn(f"{name}_masked", F.coalesce(inside, mean)).drop("_e")
    out = out.withColumn("mask_voxels", F.col("_n").cast("long")).drop("_d", "_m", "_n")
    return out.withColumns({f"psnr_{s}": psnr(F.col(f"mse_{s}"), data_range) for s in ("unmasked", "masked")})


def ssim(slices: DataFrame, *, a: str = "a", b: str = "b", mask: str | None = None, r: int = 3, data_range: float = 1.0) -> DataFrame:
    """(volume_id, z, ssim, ssim_masked) of slices with the arrays a and b: sample covariances over (2r + 1)-squares, borders mirrored.

    ssim is the mean without a border of r pixels, ssim_masked that of the whole map where the mask is above 0 (the same
    as ssim where there is no mask). Windows are differences of cumulative sums, slice by slice; nothing is shuffled.
    """
    n = (2 * r + 1) ** 2
    c1, c2 = ((x * data_range) ** 2 for x in SSIM_K)

    def mean(x: np.ndarray) -> np.ndarray:
        s = np.pad(x, r, mode="symmetric")
        for _ in (0, 1):
            s = np.cumsum(np.concatenate([np.zeros((1, s.shape[1])), s]), axis=0)
            s = (s[2 * r + 1 :] - s[: -2 * r - 1]).T
        return s / n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for v, z, h, w, x, y, m in zip(*(pdf[c] for c in ("volume_id", "z", "height", "width", "_a", "_b", "_m")), strict=True):
                x, y = np.asarray(x, float).reshape(h, w), np.asarray(y, float).reshape(h, w)
                mx, my = mean(x), mean(y)
                vx, vy, cov = (n / (n - 1) * (mean(p) - q) for p, q in ((x * x, mx * mx), (y * y, my * my), (x * y, mx * my)))
                s = (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
                inner = s[r : h - r, r : w - r]
                score = float(inner.mean()) if inner.size else None
                inside = s[np.asarray(m, float).reshape(h, w) > 0] if m is not None else np.zeros(0)
                rows.append((v, z, score, float(inside.mean()) if len(inside) else score))
            yield pd.DataFrame(rows, columns=["volume_id", "z", "ssim", "ssim_masked"])

    kind = slices.schema["volume_id"].dataType.simpleString()
    masked = F.col(mask).cast("array<double>") if mask else F.lit(None).cast("array<double>")
    slim = slices.select("volume_id", F.col("z").cast("long").alias("z"), "height", "width", F.col(a).alias("_a"), F.col(b).alias("_b"), masked.alias("_m"))
    return slim.mapInPandas(run, f"volume_id {kind}, z long, ssim double, ssim_masked double")


def drop_zero_mask(df: DataFrame, mask: str = "mask_voxels") -> DataFrame:
    """Rows whose mask isn't 0; a null one stays."""
    return df.filter(~F.col(mask).eqNullSafe(0))


def zero_mask_report(df: DataFrame, by: list[str], mask: str = "mask_voxels") -> DataFrame:
    """(by, rows, removed, kept): what `drop_zero_mask` takes away, without doing so."""
    gone = F.count_if(F.col(mask).eqNullSafe(0))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), gone.alias("removed"), (F.count("*") - gone).alias("kept"))


def significant(x: Column, digits: int = 6) -> Column:
    """A number as text with so many significant digits: no trailing zeros, an exponent below 1e-4 and from 10^digits on; n/a for null and NaN."""
    e = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.regexp_extract(e, "e([+-][0-9]+)$", 1).try_cast("int")
    number = F.replace(F.regexp_extract(e, "^-?([0-9.]+)e", 1), F.lit("."), F.lit(""))  # its digits
    tidy = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    whole = F.concat(F.substr(number, F.lit(1), exponent + 1), F.lit("."), F.substr(number, exponent + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), number)
    plain = tidy(F.when(exponent >= 0, whole).otherwise(small))
    power = F.concat(tidy(F.regexp_extract(e, "^-?([0-9.]+)e", 1)), F.regexp_extract(e, "(e[+-][0-9]+)$", 1))
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.when((exponent < -4) | (exponent >= digits), power).otherwise(plain))
    return F.when(x.isNull() | F.isnan(x), "n/a").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(text)


def mean_std_text(df: DataFrame, metrics: list[str], groups: list[str], digits: int = 6) -> DataFrame:
    """(groups, a text `mean +- std` for each metric); n/a where a number is not defined."""
    stats = mean_std(df, metrics, groups)
    return stats.select(*groups, *(F.concat(significant(F.col(f"{m}_mean"), digits), F.lit(" +- "), significant(F.col(f"{m}_std"), digits)).alias(m) for m in metrics))


def epoch_of(name: Column) -> Column:
    """The number in a file name like 40_net_G.pth; null for others, such as latest_net_G.pth."""
    return F.regexp_extract(name, r"(?:^|/)([0-9]+)_net_[^/]*\.pth", 1).try_cast("int")


def epoch_subset_metrics(df: DataFrame, *, file: str, item: str, metrics: list[str], n: int, seed: int) -> DataFrame:
    """(epoch, items, mean and std of each metric) over the same n items in every epoch (0: all), epochs taken from file names; other files go."""
    rows = df.withColumn("epoch", epoch_of(F.col(file))).filter("epoch IS NOT NULL")
    items = rows.select(item).distinct()
    if n:
        rows = rows.join(random_subset(items, key=item, n=n, seed=seed), item, "left_semi")
    stats = (f(m).alias(f"{m}_{k}") for m in metrics for f, k in ((F.avg, "mean"), (F.stddev_samp, "std")))
    return rows.groupBy("epoch").agg(F.count_distinct(item).alias("items"), *stats)


def mean_std(df: DataFrame, metrics: list[str], groups: list[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def volume_metrics(df: DataFrame, *, volume: str, unmasked: list[str], masked: list[str], weight: str) -> DataFrame:
    """Plain means, means weighted by mask size over finite values with weight, the mask's total and the slice count."""
    w = F.col(weight)
    fine = lambda m: F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(F.col(m)) < float("inf")) & (w > 0)
    weighted = lambda m: F.sum(F.when(fine(m), F.col(m) * w)) / F.sum(F.when(fine(m), w))
    return df.groupBy(volume).agg(*(F.avg(m).alias(m) for m in unmasked), *(weighted(m).alias(f"{m}_weighted") for m in masked), F.sum(weight).alias("mask_voxels"), F.count("*").alias("slice_count"))


def slice_influence(df: DataFrame, *, volume: str, weight: str) -> DataFrame:
    """df with weight_pct, the slice's share of its volume's mask."""
    return df.withColumn("weight_pct", 100 * F.col(weight) / F.sum(weight).over(Window.partitionBy(volume)))


def volume_influence(df: DataFrame, *, volume: str, metrics: dict[str, tuple[str, str]], weight: str) -> DataFrame:
    """(volume, metric, slices, total_mask, unmasked_mean, masked_weighted_mean) for each volume and metric, a pair of columns (unmasked, masked).

    The unmasked mean leaves out nulls and NaN. Masked values are weighted by their share of the volume's whole mask, a
    null weight being 0; null and NaN values add nothing, and their share isn't dealt to others. Null where the mask is empty.
    """
    w = F.coalesce(F.col(weight), F.lit(0)).cast("double")
    fine = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    aggs = (a for m, (u, k) in metrics.items() for a in (F.avg(fine(u)).alias(f"_u {m}"), F.coalesce(F.sum(fine(k) * w), F.lit(0.0)).alias(f"_m {m}")))
    wide = df.groupBy(volume).agg(F.count("*").alias("slices"), F.sum(w).alias("total_mask"), *aggs)
    share = lambda m: F.col(f"`_m {m}`") / F.nullif("total_mask", F.lit(0.0))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"`_u {m}`").alias("u"), share(m).alias("m")) for m in metrics))
    return wide.select(volume, "slices", "total_mask", F.explode(rows).alias("_r")).select(volume, "_r.metric", "slices", "total_mask", F.col("_r.u").alias("unmasked_mean"), F.col("_r.m").alias("masked_weighted_mean"))


def volume_at(df: DataFrame, volume: str, index: int) -> DataFrame:
    """The rows of the volume at a place among the sorted ids, from 0. IndexError where there is none."""
    ids = df.select(volume).filter(F.col(volume).isNotNull()).distinct()
    found = numbered(ids, volume).filter(F.col("number") == index).select(volume)
    if index < 0 or found.isEmpty():
        raise IndexError(f"no volume {index} among the sorted ids")
    return df.join(found, volume, "left_semi")


def metrics_table(df: DataFrame, *, groups: list[str], metrics: dict[str, int]) -> DataFrame:
    """Text cells `mean ± std` with so many decimals, blank where the deviation is undefined, and ' between thousands."""
    cell = lambda c, d: F.replace(F.format_number(c, d), F.lit(","), F.lit("'"))
    stats = mean_std(df, list(metrics), groups)
    return stats.select(*groups, *(F.when(F.col(f"{m}_std").isNull(), "").otherwise(F.concat(cell(f"{m}_mean", d), F.lit(" ± "), cell(f"{m}_std", d))).alias(m) for m, d in metrics.items()))


def split_masked(df: DataFrame, shared: list[str]) -> tuple[DataFrame, DataFrame]:
    """Columns by suffix, the suffix taken off, shared columns in both."""
    side = lambda s: df.select(*shared, *(F.col(c).alias(c.removesuffix(s)) for c in df.columns if c.endswith(s)))
    return side("_unmasked"), side("_masked")


def box_summary(df: DataFrame, *, facet: str, group: str, v: str) -> DataFrame:
    """Quartiles and 1.5 IQR fences by group, in each facet and in Total."""
    both = df.select(F.explode(F.array(F.col(facet).cast("string"), F.lit("Total"))).alias("facet"), F.col(group), F.col(v).alias("_v"))
    q = both.groupBy("facet", group).agg(F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("_v").alias("n"))
    a, m, b = (F.get("q", F.lit(i)) for i in range(3))
    return q.select("facet", group, "n", a.alias("q1"), m.alias("median"), b.alias("q3"), (a - 1.5 * (b - a)).alias("low_fence"), (b + 1.5 * (b - a)).alias("high_fence"))


def box_whiskers(df: DataFrame, *, facet: str, group: str, v: str, factors: list[str] = ()) -> DataFrame:
    """(facet, group, n, q1, median, q3, low, high, outliers) in each facet and in Total: whiskers end at the outermost values within 1.5 IQR of the box.

    ValueError if any of the other `factors` has several values within a group of a facet, as its box would mix them.
    Quartiles are exact for groups of any size; rows are not copied for Total.
    """
    rows = df.select(F.col(facet).cast("string").alias("facet"), group, F.col(v).cast("double").alias("_v"), *factors)
    if factors:
        kinds = rows.groupBy("facet", group).agg(*(F.count_distinct(F.coalesce(F.to_json(F.struct(f)), F.lit(""))).alias(f"_{i}") for i, f in enumerate(factors)))
        mixed = kinds.agg(*(F.max(f"_{i}") for i in range(len(factors)))).first()
        if found := [f for f, k in zip(factors, mixed, strict=True) if (k or 0) > 1]:
            raise ValueError(f"groups mix values of {', '.join(found)}")
    out = None
    for keys in (["facet", group], [group]):
        q = quantiles(rows, keys, "_v", [0.25, 0.5, 0.75]).select(*keys, *(F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))), "n")
        both = beside(rows, q, keys).drop("n").filter("_v IS NOT NULL")
        reach = 1.5 * (F.col("q3") - F.col("q1"))
        inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
        ends = both.groupBy(*keys, "q1", "median", "q3").agg(F.count("*").alias("n"), F.min(F.when(inside, F.col("_v"))).alias("low"), F.max(F.when(inside, F.col("_v"))).alias("high"), F.count_if(~inside).alias("outliers"))
        part = ends.select(F.col("facet") if len(keys) == 2 else F.lit("Total").alias("facet"), group, "n", "q1", "median", "q3", "low", "high", "outliers")
        out = part if out is None else out.union(part)
    return out


def describe_by(df: DataFrame, *, groups: list[str], v: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of groups of any size."""
    q = quantiles(df, groups, v, [0.25, 0.5, 0.75]).select(*groups, *(F.get("quantiles", F.lit(i)).alias(f"q{25 * i + 25}") for i in range(3)))
    stats = df.groupBy(*groups).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return by_groups(stats, q, groups, "left").select(*groups, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def confusion_matrix(df: DataFrame, *, label: str, pred: str, n: int) -> DataFrame:
    ok = (F.col(label) >= 0) & (F.col(label) < n)
    return df.filter(ok).groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("count"))


def segmentation_scores(cm: DataFrame) -> DataFrame:
    """(label, accuracy, iou, pixel_accuracy) of a confusion matrix of classes."""
    rows = cm.groupBy("label").agg(F.sum("count").alias("r"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("count")).otherwise(0)).alias("hit"))
    cols = cm.groupBy(F.col("pred").alias("label")).agg(F.sum("count").alias("c"))
    total = Window.partitionBy(F.lit(1))
    out = rows.join(cols, "label", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return out.select("label", (F.col("hit") / F.col("r")).alias("accuracy"), (F.col("hit") / (F.col("r") + F.col("c") - F.col("hit") + 1e-12)).alias("iou"), (F.sum("hit").over(total) / F.sum("r").over(total)).alias("pixel_accuracy"))


def segmentation_means(cm: DataFrame) -> DataFrame:
    """One row (classes, pixel_accuracy, mean_accuracy, mean_iou): means over the classes that have labels."""
    return segmentation_scores(cm).agg(F.count("*").alias("classes"), F.max("pixel_accuracy").alias("pixel_accuracy"), F.avg("accuracy").alias("mean_accuracy"), F.avg("iou").alias("mean_iou"))


def slice_bbox(px: DataFrame) -> DataFrame:
    """(volume_id, z, y0, y1, x0, x1, height, width, area) of pixels > 0, ends included."""
    box = px.filter("v > 0").groupBy("volume_id", "z").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("area"))
    return box.withColumn("height", F.col("y1") - F.col("y0") + 1).withColumn("width", F.col("x1") - F.col("x0") + 1)


def bbox_by_volume(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("volume_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("height", "width", "area") for f, n in ((F.median, "median"), (F.max, "max"))))


def cropping_loss(boxes: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, share) of slices whose longer side reaches the size."""
    return boxes.select(F.explode(F.array(*map(F.lit, sizes))).alias("size"), F.greatest("height", "width").alias("_s")).groupBy("size").agg(F.avg((F.col("_s") >= F.col("size")).cast("double")).alias("share"))


def hist2d(df: DataFrame, *, x: str, y: str, x_max: float, y_max: float, bins: int) -> DataFrame:
    k = lambda c, top: F.least(F.floor(F.col(c) / (top / bins)), F.lit(bins - 1)).cast("long")
    return df.filter(F.col(x).between(0, x_max) & F.col(y).between(0, y_max)).groupBy(k(x, x_max).alias("bin_x"), k(y, y_max).alias("bin_y")).agg(F.count("*").alias("count"))


def largest_planes(px: DataFrame) -> DataFrame:
    """(volume_id, axis, plane, area): on each axis the plane with most pixels > 0, the first of equal ones."""
    on = px.filter("v > 0").select("volume_id", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("long").alias("plane")) for a in ("z", "y", "x")])).alias("p")).select("volume_id", "p.*")
    area = on.groupBy("volume_id", "axis", "plane").agg(F.count("*").alias("area"))
    return area.groupBy("volume_id", "axis").agg(F.max_by("plane", F.struct("area", -F.col("plane"))).alias("plane"), F.max("area").alias("area"))


def plane_pixels(px: DataFrame, planes: DataFrame) -> DataFrame:
    """(volume_id, axis, plane, and px's other columns): the pixels of each volume's chosen planes (volume_id, axis, plane), one an axis. A pixel on two planes has two rows."""
    wide = planes.groupBy("volume_id").agg(*(F.max(F.when(F.col("axis") == a, F.col("plane"))).alias(f"_{a}") for a in ("z", "y", "x")))
    on = F.array_compact(F.array(*(F.when(F.col(a) == F.col(f"_{a}"), F.struct(F.lit(a).alias("axis"), F.col(f"_{a}").alias("plane"))) for a in ("z", "y", "x"))))
    cut = px.join(wide, "volume_id").select(*px.columns, F.explode(on).alias("_p"))
    return cut.select("volume_id", "_p.axis", "_p.plane", *(c for c in px.columns if c != "volume_id"))


def peak_regions(df: DataFrame, bounds: DataFrame, *, volume: str, v: str, lic: str) -> DataFrame:
    """(volume, region, homogeneous, count): values strictly inside their volume's peak bounds, and local change strictly below its threshold."""
    inside = (F.col(v) > F.col("left")) & (F.col(v) < F.col("right"))
    joined = df.join(bounds, volume)
    return joined.groupBy(volume, F.when(inside, "peak").otherwise("rest").alias("region"), (F.col(lic) < F.col("threshold")).alias("homogeneous")).agg(F.count("*").alias("count"))


def geometry_catalog(slices: DataFrame, *, case: str, modality: str) -> DataFrame:
    """(case, modality, z, y, x, spacing_x, spacing_y, spacing_z): one row a case and modality, from slices with their spacing."""
    return slices.groupBy(case, modality).agg(
        F.count("*").alias("z"), F.first("height").cast("long").alias("y"), F.first("width").cast("long").alias("x"),
        *(F.first(c).cast("double").alias(f"spacing_{c[1]}") for c in ("sx", "sy", "sz")),
    )
