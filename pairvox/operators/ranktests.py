"""Rank tests as aggregations; only result rows meet Python, for the tails of the distributions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairvox.operators.joins import range_of


def average_rank(groups: list[str], v: str | Column) -> Column:
    """Rank with the mean of tied places."""
    w = Window.partitionBy(*groups)
    return F.rank().over(w.orderBy(v)) + (F.count("*").over(Window.partitionBy(*groups, v)) - 1) / 2


def value_ranks(values: DataFrame, *, groups: list[str], v: str, n: str, per: int = 100_000) -> DataFrame:
    """values (groups, v, n rows of that value) with `_r`, the average rank of each value in its group.

    Values are added up by range and ranked inside theirs, so no task sees a whole group, and a value that many rows have is one row.
    """
    rows = values.withColumn("_range", range_of(values, v, per=per))
    counts = rows.groupBy(*groups, "_range").agg(F.sum(n).alias("_all"))
    before = counts.select(*groups, "_range", (F.sum("_all").over(Window.partitionBy(*groups).orderBy("_range")) - F.col("_all")).alias("_before"))
    own = F.sum(n).over(Window.partitionBy(*groups, "_range").orderBy(v)) - (F.col(n) - 1) / 2
    return rows.withColumn("_own", own).join(before, [*groups, "_range"]).withColumn("_r", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def wilcoxon(df: DataFrame, *, groups: list[str], d: str, per: int = 100_000) -> DataFrame:
    """(groups, t, n, effect, z): signed ranks of differences; zeros are ranked and then left out (Pratt), nulls go. t is the smaller sum, effect the rank-biserial correlation.

    Differences are counted by size before anything is ranked, and nothing is joined to the rows again.
    """
    size = F.abs(d).alias("_abs")
    values = df.filter(F.col(d).isNotNull()).groupBy(*groups, size).agg(F.count("*").alias("_c"), F.count_if(F.col(d) > 0).alias("_p"), F.count_if(F.col(d) < 0).alias("_m"))
    ranked = value_ranks(values, groups=groups, v="_abs", n="_c", per=per)
    tied, zero = F.pow("_c", F.lit(3.0)) - F.col("_c"), F.col("_abs") == 0
    sums = ranked.groupBy(*groups).agg(
        F.sum(F.col("_p") * F.col("_r")).alias("_up"), F.sum(F.col("_m") * F.col("_r")).alias("_down"), F.sum(F.col("_p") + F.col("_m")).alias("n"), F.sum("_c").alias("_all"),
        F.sum(F.when(zero, 0.0).otherwise(tied)).alias("_ties"), F.sum(F.when(zero, F.col("_c")).otherwise(0)).alias("_zeros"),
    )
    n, z = F.col("_all").cast("double"), F.col("_zeros").cast("double")
    mean = (n * (n + 1) - z * (z + 1)) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1)) / 24 - F.col("_ties") / 48
    t = F.least("_up", "_down")
    return sums.select(*groups, t.alias("t"), "n", ((F.col("_up") - F.col("_down")) / F.nullif(F.col("_up") + F.col("_down"), F.lit(0.0))).alias("effect"), ((t - mean) / F.nullif(F.sqrt(var), F.lit(0.0))).alias("z"))


def paired_difference(df: DataFrame, *, groups: list[str], subject: str, condition: str, v: str, a: str, b: str) -> DataFrame:
    """(groups, subject, d): mean under a less mean under b, for subjects with both."""
    side = lambda c: F.avg(F.when(F.col(condition) == c, F.col(v)))
    return df.groupBy(*groups, subject).agg((side(a) - side(b)).alias("d")).filter("d IS NOT NULL")


def wilcoxon_vs_baseline(df: DataFrame, *, model: str, subject: str, condition: str, v: str, baseline: str) -> DataFrame:
    """Wilcoxon of each condition against the baseline in each model, over complete pairs, in one plan."""
    means = df.groupBy(model, condition, subject).agg(F.avg(v).alias("_v"))
    base = means.filter(F.col(condition) == baseline).select(model, subject, F.col("_v").alias("_b"))
    d = means.filter(F.col(condition) != baseline).join(base, [model, subject]).withColumn("d", F.col("_b") - F.col("_v"))
    return wilcoxon(d, groups=[model, condition], d="d")


def friedman(df: DataFrame, *, groups: list[str], subject: str, within: str, v: str) -> DataFrame:
    """(groups, q, df, w): Friedman's statistic with tie correction and Kendall's W, over subjects seen under all conditions."""
    cells = df.groupBy(*groups, subject, within).agg(F.avg(v).alias("_v"))
    k = cells.groupBy(*groups).agg(F.count_distinct(within).alias("_k"))
    full = cells.groupBy(*groups, subject).agg(F.count("*").alias("_n")).join(k, groups).filter("_n = _k").drop("_n")
    ranked = cells.join(full, [*groups, subject]).withColumn("_r", average_rank([*groups, subject], "_v"))
    ties = ranked.groupBy(*groups, subject, "_v").agg(F.count("*").alias("_c")).groupBy(*groups).agg(F.sum(F.pow("_c", F.lit(3.0)) - F.col("_c")).alias("_ties"))
    per = ranked.groupBy(*groups, within, "_k").agg(F.sum("_r").alias("_s"), F.count("*").alias("_n"))
    total = per.groupBy(*groups).agg(F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.max("_n").cast("double").alias("_n"), F.max("_k").cast("double").alias("_k")).join(ties, groups)
    n, kk = F.col("_n"), F.col("_k")
    q = (12 / (kk * n * (kk + 1)) * F.col("_ss") - 3 * n * (kk + 1)) / (1 - F.col("_ties") / (n * kk * (kk * kk - 1)))
    return total.select(*groups, q.alias("q"), (kk - 1).cast("long").alias("df"), (q / (n * (kk - 1))).alias("w"))


def chi2_tail(x: float, k: int) -> float:
    """P(X > x) for k degrees of freedom."""
    if x <= 0:
        return 1.0
    term = total = 1 / math.gamma(k / 2 + 1)
    for i in range(1, 2000):
        term *= x / 2 / (k / 2 + i)
        total += term
    return max(0.0, 1 - (x / 2) ** (k / 2) * math.exp(-x / 2) * total)


def with_p(df: DataFrame, *, statistic: str) -> DataFrame:
    """df with p: two-sided normal for z, chi-squared for q."""

    @F.pandas_udf("double")
    def p(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if a != a or a is None else (math.erfc(abs(a) / math.sqrt(2)) if statistic == "z" else chi2_tail(a, int(b))) for a, b in zip(x, k, strict=True)])

    return df.withColumn("p", p(F.col(statistic), F.lit(1) if statistic == "z" else F.col("df")))


def test_for(group: Column) -> Column:
    """An aggregate: friedman for more than two groups, wilcoxon for two, none for fewer."""
    n = F.count_distinct(group)
    return F.when(n > 2, "friedman").when(n == 2, "wilcoxon").otherwise("none")


def choose_test(df: DataFrame, *, group: str) -> str:
    """The name of the test for all of df: the driver sees one row."""
    return df.agg(test_for(F.col(group))).first()[0]


def difference_histogram(d: DataFrame, *, group: str, v: str, lo: float, hi: float, bins: int) -> DataFrame:
    k = F.least(F.floor((F.col(v) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")
    return d.filter(F.col(v).between(lo, hi)).groupBy(group, k.alias("bin")).agg(F.count("*").alias("count"))
