"""Reproducible splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairvox.functions.ids import extract_token, parse_case_id


def stratified_split(df: DataFrame, *, key: str, stratum: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42, per: int = 100_000) -> DataFrame:
    """df with `split` (train, val, test). In a stratum of n rows, in the order of md5(seed:key), the first round(n * test) are test, then round(n * val) val.

    Ranks come from counts by ranges of the hash, about `per` rows each, and places inside a range, so no task sees a
    whole stratum.
    """
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.withColumn("_hash", order).withColumn("_bucket", F.shiftright(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * max(1, df.count() // per), 32))
    counts = rows.groupBy(stratum, "_bucket").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(stratum)
    counts = counts.select(F.col(stratum).alias("_s"), "_bucket", (F.sum("_c").over(whole.orderBy("_bucket")) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_n"))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy(stratum, "_bucket").orderBy("_hash", key)))
    ranked = ranked.join(counts.withColumnRenamed("_bucket", "_b"), F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn("_k", F.col("_before") + F.col("_in"))
    n_test, n_val = (F.floor(F.col("_n") * r + 0.5) for r in (ratios[2], ratios[1]))
    out = ranked.withColumn("split", F.when(F.col("_k") <= n_test, "test").when(F.col("_k") <= n_test + n_val, "val").otherwise("train"))
    return out.drop("_n", "_k", "_s", "_b", "_bucket", "_before", "_in", "_hash")


def split_counts(df: DataFrame, *, groups: list[str], key: str) -> DataFrame:
    """Distinct keys of each split as columns, their total and the share of train in percent."""
    counts = [F.count_distinct(F.when(F.col("split") == s, F.col(key))).alias(s) for s in ("train", "val", "test")]
    out = df.groupBy(*groups).agg(*counts, F.count_distinct(key).alias("total"))
    return out.withColumn("train_pct", F.when(F.col("total") > 0, F.round(100 * F.col("train") / F.col("total"), 2)).otherwise(0.0))


def random_subset(df: DataFrame, *, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the least md5(seed:key), the same each time; n of 0 or less means all."""
    return df if n <= 0 else df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def head_n(df: DataFrame, *, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def split_patients(manifest: DataFrame, *, path: str, split: str) -> DataFrame:
    """Distinct last path parts of a split."""
    return manifest.filter(F.col("split") == split).select(F.substring_index(path, "/", -1).alias("patient")).distinct()


def manifest(cases: DataFrame, *, case: str, root: str) -> DataFrame:
    """(patient_token, case_id, body, center, year, label, example_path) of cases whose id can be parsed; others go."""
    parsed = cases.select(F.col(case).alias("case_id"), parse_case_id(F.col(case)).alias("_p")).filter("_p IS NOT NULL")
    return parsed.select(
        F.col("_p.token").alias("patient_token"), "case_id", "_p.body", "_p.center", F.col("_p.year").cast("string").alias("year"),
        F.concat_ws("_", "_p.body", "_p.center").alias("label"), F.concat(F.lit(f"{root.rstrip('/')}/"), F.col("case_id")).alias("example_path"),
    )


def stage_groups(cases: DataFrame, manifest_: DataFrame, *, case: str, region: str | None = None) -> DataFrame:
    """cases with `token` and `stage`: `fit` for training tokens, `apply` for those of val or test. A token of both is in both; other cases go.

    The token is cut out of the case id, or is the id itself. region keeps ids that begin with it and an underscore.
    """
    own = cases.withColumn("token", F.coalesce(extract_token(F.col(case)), F.col(case)))
    if region:
        own = own.filter(F.startswith(F.col(case), F.lit(f"{region}_")))
    kind = F.lower(F.trim("split"))
    listed = manifest_.select(F.trim("patient_token").alias("token"), F.when(kind == "train", "fit").when(kind.isin("val", "test"), "apply").alias("stage"))
    return own.join(listed.filter("stage IS NOT NULL AND token <> ''").distinct(), "token")
