"""Joins of points with a table of intervals, without comparing every point with every interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The size of intervals without an end on some side, whose one bin holds all points of a key; points of a bin from which on it is split.
OPEN, HOT_POINTS = 10_000, 1_000_000


def interval_join(points: DataFrame, intervals: DataFrame, *, keys: list[str], at: str, lo: str, hi: str, half_open: bool = False, how: str = "inner", hot_points: int = HOT_POINTS) -> DataFrame:
    """points with the other columns of every interval of the same keys that holds `at`: lo <= at <= hi, or at < hi if half_open.

    An interval is dealt to bins as wide as the power of two next to its length, so to three of them at most, however
    long it is. A point is looked for in one bin of each width that occurs; there are as many as magnitudes of lengths.
    So it is an equi-join on keys, width and bin, and the ends are compared for what meets there. A bin that hot_points
    points or more fall in is split: its points are dealt over shares, its intervals go to all of them.

    A null end is open: no bound on that side. An interval with hi < lo, a point that is null or NaN, and null keys meet
    nothing. Numbers, dates and timestamps will do, of one kind on both sides. With how="left" points without an interval
    stay, with nulls. Repeated points and intervals are rows of their own. Columns of intervals but keys may not be named
    as those of points.
    """
    timed = points.schema[at].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    number = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) if timed else F.col(c)).cast("double")
    inside = (F.col(at) >= F.col(lo)) | F.col(lo).isNull()
    inside &= (F.col(at) < F.col(hi) if half_open else F.col(at) <= F.col(hi)) | F.col(hi).isNull()
    length = number(hi) - number(lo)
    sized = intervals.filter(F.col(lo).isNull() | F.col(hi).isNull() | (F.col(hi) >= F.col(lo)))
    size = F.when(length > 0, F.least(F.lit(1023), F.greatest(F.lit(-1000), F.ceil(F.log2(length)).cast("int")))).when(length == 0, -1000).otherwise(OPEN)
    sized = sized.withColumn("_size", F.when(F.isnan(length) | (length == float("inf")), OPEN).otherwise(size))
    sizes = [r[0] for r in sized.select("_size").distinct().collect()]  # 2,025 at most, some dozens in practice
    sized = sized.withColumn("_bin", F.explode(F.when(F.col("_size") == OPEN, F.array(F.lit(0).cast("double"))).otherwise(_bins(number(lo), number(hi), F.col("_size")))))
    fine = points.filter(F.col(at).isNotNull() & ~F.isnan(number(at)))
    placed = fine.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn("_bin", _bin(number(at), F.col("_size")))
    at_bin = [*keys, "_size", "_bin"]
    hot = placed.groupBy(*at_bin).agg(F.count("*").alias("_n")).filter(F.col("_n") >= hot_points)
    if not hot.isEmpty():
        shares = hot.select(*at_bin, F.ceil(F.col("_n") / hot_points).cast("int").alias("_shares"))
        count = F.coalesce("_shares", F.lit(1))
        placed = placed.join(shares, at_bin, "left").withColumn("_share", F.pmod(F.xxhash64(*points.columns), count).cast("int")).drop("_shares")
        sized = sized.join(shares, at_bin, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), count - 1))).drop("_shares")
        at_bin = [*at_bin, "_share"]
    met = placed.join(sized, at_bin).filter(inside).drop("_size", "_bin", "_share")
    if how == "inner":
        return met
    others = [c for c in intervals.columns if c not in keys]
    alone = points.join(met.select(*keys, at).distinct(), [*keys, at], "left_anti").select(*points.columns)
    return met.unionByName(alone.withColumns({c: F.lit(None).cast(intervals.schema[c].dataType) for c in others}))


def _bin(x: Column, size: Column) -> Column:
    """The bin of a number among those of width 2^size, itself for intervals of one value. It never falls as x grows, so an interval's points lie between its ends' bins."""
    return F.when(size == OPEN, F.lit(0.0)).when(size == -1000, x).otherwise(_floor(x / F.pow(F.lit(2.0), size.cast("double"))))


def _floor(x: Column) -> Column:
    """floor as a double: whole numbers beyond 2^53 are their own."""
    return F.when(F.abs(x) < 2.0**53, F.floor(F.when(F.abs(x) < 2.0**53, x).otherwise(0.0)).cast("double")).otherwise(x)


def _bins(lo: Column, hi: Column, size: Column) -> Column:
    first, last = _bin(lo, size), _bin(hi, size)
    return F.array_distinct(F.array(first, F.least(first + 1, last), last))
