"""Dose tables by region of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairvox.operators.quantiles import by_groups, quantiles


def roi_dose_stats(df: DataFrame, *, keys: list[str], dose: str) -> DataFrame:
    """Mean, deviation, extremes and D_x, the dose that the hottest x percent reach; regions of any size."""
    shares = (2, 5, 95, 98)
    reached = quantiles(df, keys, dose, [1 - x / 100 for x in shares]).select(*keys, *(F.get("quantiles", F.lit(i)).alias(f"D_{x}") for i, x in enumerate(shares)))
    stats = df.groupBy(*keys).agg(F.avg(dose).alias("mean"), F.stddev_samp(dose).alias("std"), F.max(dose).alias("max"), F.min(dose).alias("min"))
    return by_groups(stats, reached, keys, "left")


def roi_delta(ref: DataFrame, synth: DataFrame, *, keys: list[str], metrics: list[str]) -> DataFrame:
    """Synthetic less reference for each metric, joined by name."""
    other = synth.select(*keys, *(F.col(m).alias(f"_{m}") for m in metrics))
    return ref.join(other, keys).select(*keys, *((F.col(f"_{m}") - F.col(m)).alias(m) for m in metrics))


def three_way(ct: DataFrame, sct: DataFrame, *, keys: list[str], metrics: list[str]) -> DataFrame:
    """Both sides, their difference and its percentage of the first, null where that is 0."""
    side = lambda df, p: df.select(*keys, *(F.col(m).alias(f"{p}_{m}") for m in metrics))
    both = side(ct, "ct").join(side(sct, "sct"), keys)
    gap = lambda m: F.col(f"sct_{m}") - F.col(f"ct_{m}")
    return both.select("*", *(gap(m).alias(f"delta_{m}") for m in metrics), *((100 * gap(m) / F.nullif(F.col(f"ct_{m}"), F.lit(0.0))).alias(f"pct_{m}") for m in metrics))


def pct_difference(real: Column, fake: Column) -> Column:
    return 100 * (fake - real) / F.nullif(real, F.lit(0.0))


def to_long(df: DataFrame, *, ids: list[str], metrics: list[str], role: str, keep: dict[str, list[str]]) -> DataFrame:
    """(ids, indicator, value): metrics as rows, the indicator without _, only those kept for the row's role."""
    long = df.unpivot([*ids, role], metrics, "indicator", "value")
    wanted = F.lit(False)
    for r, names in keep.items():
        wanted = wanted | ((F.col(role) == r) & F.col("indicator").isin(*names))
    return long.filter(wanted).withColumn("indicator", F.replace("indicator", F.lit("_"), F.lit("")))


def mean_difference(df: DataFrame, *, label: str, model: str, v: str, labels: list[str], absolute: bool = False) -> DataFrame:
    """One row a model with the mean of each label, rounded to 2 digits."""
    value = F.abs(v) if absolute else F.col(v)
    return df.groupBy(model).pivot(label, labels).agg(F.round(F.avg(value), 2))


def patient_range(df: DataFrame, *, model: str, label: str, patient: str, v: str, order: list[str]) -> DataFrame:
    """(model, label, low, high, mean) over patients. Of a patient's repeated rows the first by `order` counts, a null value there giving way to the next."""
    each = df.filter(F.col(v).isNotNull()).groupBy(model, label, patient).agg(F.min_by(v, F.struct(*order)).alias("_v"))
    return each.groupBy(model, label).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean"))


def outlier_counts(df: DataFrame, *, keys: list[str], v: str, t: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col(v) > t).alias("above"), F.count_if(F.col(v) < -t).alias("below"))


def outlier_rows(df: DataFrame, *, v: str, t: float) -> DataFrame:
    return df.filter(F.abs(v) > t)


def iqr_outliers(df: DataFrame, *, group: str, v: str, k: float = 3.0) -> DataFrame:
    """Rows outside k interquartile ranges of their group's quartiles."""
    q = df.groupBy(group).agg(F.percentile(v, 0.25).alias("_a"), F.percentile(v, 0.75).alias("_b"))
    return df.join(q, group).filter((F.col(v) < F.col("_a") - k * (F.col("_b") - F.col("_a"))) | (F.col(v) > F.col("_b") + k * (F.col("_b") - F.col("_a")))).drop("_a", "_b")


def summaries(df: DataFrame, *, by: list[list[str]], metrics: list[str]) -> DataFrame:
    """Means over several groupings in one pass; columns that a grouping lacks are null, `grouping` says which it is."""
    columns = list(dict.fromkeys(c for g in by for c in g))
    out = df.groupingSets([[F.col(c) for c in g] for g in by], *columns).agg(F.grouping_id().alias("grouping"), *(F.avg(m).alias(m) for m in metrics))
    return out


def rank_rois(df: DataFrame, *, roi: str, v: str) -> DataFrame:
    """(roi, mean, rank) by falling mean; a few rows, one a region."""
    means = df.groupBy(roi).agg(F.avg(v).alias("mean"))
    return means.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("mean"))).cast("long"))


def differential_dvh(df: DataFrame, *, keys: list[str], dose: str, vol: str) -> DataFrame:
    """df with `density`, -dV/dD: second-order centred differences on an uneven grid, one-sided at the ends, 0 for a single point."""
    w = Window.partitionBy(*keys).orderBy(dose)
    d, v = F.col(dose), F.col(vol)
    d0, d1, v0, v1 = F.lag(d).over(w), F.lead(d).over(w), F.lag(v).over(w), F.lead(v).over(w)
    left, right = (v - v0) / F.nullif(d - d0, F.lit(0.0)), (v1 - v) / F.nullif(d1 - d, F.lit(0.0))
    centred = (left * (d1 - d) + right * (d - d0)) / F.nullif(d1 - d0, F.lit(0.0))
    return df.withColumn("density", -F.coalesce(centred, right, left, F.lit(0.0)))


def common_rois(ref: DataFrame, synth: DataFrame, *, name: str, targets: list[str], exclude: list[str], n: int = 8) -> DataFrame:
    """(name, role): names in both tables; targets, and the first n others but for the excluded ones."""
    both = ref.select(name).intersect(synth.select(name))
    rest = both.filter(~F.col(name).isin(*targets, *exclude)).orderBy(name).limit(n).withColumn("role", F.lit("OAR"))
    return both.filter(F.col(name).isin(*targets)).withColumn("role", F.lit("PTV")).union(rest)
