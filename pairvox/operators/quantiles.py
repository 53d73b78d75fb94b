"""Exact quantiles of groups of any size, by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairvox.operators.spread import cut

#: Values of a group up to which one aggregate buffer holds them; parts of a range in a round; values of a range from which on it is no longer divided.
DIRECT, PARTS, GATHER = 1_000_000, 1024, 100_000

#: Rows of groups up to which they are sent to every task, so that the rows beside them aren't dealt by group.
SENT = 100_000


def quantiles(df: DataFrame, groups: list[str], v: str, qs: list[float], *, direct: int = DIRECT, parts: int = PARTS, gather: int = GATHER) -> DataFrame:
    """(groups, quantiles, n): linearly interpolated quantiles of v, one array in the order of qs, and how many values are not null.

    The values are those of Spark's `percentile`, NaN counting as the largest. A group of `direct` values or fewer goes
    through that aggregate, whose buffer holds a group's distinct values. The ranks wanted of a larger group lie in
    ranges of values, at first one from its least to its greatest. Each round counts the values of every range in
    `parts` of equal width or ratio, added up in the tasks before they are shuffled, and goes on with the parts in which wanted
    ranks lie, as they are in fact filled. A range of one value is done; once no other holds more than `gather` values,
    these are counted each. So no task sees a whole group; a round is one pass over the rows, and a thousand times
    fewer values are left after it. Groups without values have no row.
    """
    rows = df.select(*groups, F.col(v).cast("double").alias("_v")).filter("_v IS NOT NULL")
    sizes = cut(rows.groupBy(*groups).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    large = sizes.filter(F.col("n") > direct)
    small = by_groups(rows, few(large.select(*groups)), groups, "left_anti")
    if large.isEmpty():
        return _direct(rows, groups, qs)
    wants = cut(_wants(large, groups, qs))
    found, depth, held = [], 1e-9, None
    while True:
        found.append(wants.filter("lo = hi").select(*groups, "k", F.col("lo").alias("value")))
        wants = wants.filter("lo <> hi")
        most, left = wants.select(*groups, "lo", "hi", "held").distinct().agg(F.max("held"), F.sum("held")).first()
        if most is None:
            break
        if held is None or left * 8 <= held:  # an eighth of the rows is worth a copy, which later rounds read instead
            rows = rows if held is None else cut(_in_ranges(rows, wants, groups).select(*groups, "_v"))
            held = left
        if most <= gather:
            found.append(_picked(_in_ranges(rows, wants, groups), wants, groups))
            break
        wants = cut(_refined(_in_ranges(rows, wants, groups, depth), wants, groups, parts))
        depth = max(depth**4, 1e-300)
    values = found[0]
    for f in found[1:]:
        values = values.union(f)
    out = _interpolated(values, large, groups, qs)
    return out if not groups else out.union(_direct(small, groups, qs))


def few(df: DataFrame) -> DataFrame:
    """df, a table that is there already, with a hint to send it to every task if it has SENT rows or fewer. A large group then stays spread as it was read."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def beside(rows: DataFrame, each: DataFrame, groups: list[str], direct: int = DIRECT) -> DataFrame:
    """rows with the columns of each, one row a group with its number of rows `n`: as by_groups, but no task gets all rows of a group larger than `direct`."""
    each = cut(each)
    if not groups or each.limit(SENT + 1).count() <= SENT:
        return by_groups(rows, F.broadcast(each) if groups else each, groups)
    large = F.broadcast(each.filter(F.col("n") > direct))  # the rows hold one such group in `direct` at most
    return by_groups(rows, large, groups).union(by_groups(by_groups(rows, large.select(*groups), groups, "left_anti"), each.filter(F.col("n") <= direct), groups))


def by_groups(left: DataFrame, right: DataFrame, groups: list[str], how: str = "inner") -> DataFrame:
    """A join on group columns that keeps the group of nulls; the columns of the right follow without them. Without groups the right has one row, or none."""
    if not groups:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left
    named = right.select(*(F.col(g).alias(f"_right_{i}") for i, g in enumerate(groups)), *(c for c in right.columns if c not in groups))
    on = [F.col(g).eqNullSafe(F.col(f"_right_{i}")) for i, g in enumerate(groups)]
    out = left.join(named, on, how)
    return out.drop(*(f"_right_{i}" for i in range(len(groups))))


def _direct(rows: DataFrame, groups: list[str], qs: list[float]) -> DataFrame:
    found = rows.groupBy(*groups).agg(F.percentile("_v", F.array(*map(F.lit, qs))).alias("quantiles"), F.count("*").alias("n"))
    return found.filter("n > 0").select(*groups, "quantiles", "n")


def _ranks(qs: list[float], n: Column) -> list[tuple[Column, Column, Column]]:
    """For each quantile its place, and the ranks on both sides of it."""
    places = [F.lit(float(q)) * (n - 1) for q in qs]
    return [(p, F.floor(p), F.ceil(p)) for p in places]


def _wants(large: DataFrame, groups: list[str], qs: list[float]) -> DataFrame:
    """(groups, k, lo, hi, below, held): a wanted rank, the range it lies in, and how many values are below and in it."""
    ranks = F.array_distinct(F.array(*(r for _, a, b in _ranks(qs, F.col("n")) for r in (a, b))))
    return large.select(*groups, F.explode(ranks).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"))


def _in_ranges(rows: DataFrame, wants: DataFrame, groups: list[str], depth: float | None = None) -> DataFrame:
    """Rows that lie in a range that is still wanted, with its ends, and with its scale where `depth` is given. A group has two ranges a quantile at most, and they don't overlap."""
    ranges = wants.select(*groups, "lo", "hi").distinct()
    if depth is not None:
        ranges = _scaled(ranges, depth)
    own = [c for c in ranges.columns if c not in groups]
    return by_groups(rows, few(ranges), groups).filter("lo <= _v AND _v <= hi").select(*groups, "_v", *own)


def _refined(inside: DataFrame, wants: DataFrame, groups: list[str], parts: int) -> DataFrame:
    """wants with the part of its range that each rank lies in. The ends of a range have parts of their own, so every round divides it."""
    at = _place(F.col("_v")) * (parts - 2)
    inner = F.floor(F.greatest(F.lit(0.0), F.least(F.coalesce(F.nanvl(at, F.lit(0.0)), F.lit(0.0)), F.lit(float(parts))))).cast("int") + 1
    part = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), parts).otherwise(F.least(F.lit(parts - 1), inner))
    key = [*groups, "lo", "hi"]
    counts = inside.groupBy(*key, part.alias("_part")).agg(F.count("*").alias("_held"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = F.sum("_held").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_held")
    met = by_groups(wants, counts.withColumn("_before", before), key).withColumn("_k", F.col("k") - F.col("below"))
    met = met.filter((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_held")))
    return met.select(*groups, "k", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("below") + F.col("_before")).alias("below"), F.col("_held").alias("held"))


def _curve(v: Column) -> Column:
    """What is divided evenly in a range: logarithms where it spans magnitudes, else the value itself."""
    near = F.signum(v) * F.log1p(F.abs(v) / F.col("_scale"))
    return F.when(F.col("_kind") == 0, F.ln(v)).when(F.col("_kind") == 1, -F.ln(-v)).when(F.col("_kind") == 2, near).otherwise(v / 2)


def _scaled(ranges: DataFrame, depth: float) -> DataFrame:
    """ranges with what `_place` needs of them, so that each row computes one curve once. Around zero logarithms reach down to `depth` of the larger end."""
    lo, hi = F.col("lo"), F.col("hi")
    kind = F.when((lo > 0) & (hi / lo > 1000), 0).when((hi < 0) & (lo / hi > 1000), 1).when((lo <= 0) & (hi >= 0), 2).otherwise(3)
    named = ranges.select("*", kind.alias("_kind"), (F.greatest(F.abs(lo), F.abs(hi)) * depth + 1e-307).alias("_scale"))
    return named.select("*", _curve(lo).alias("_first"), F.nullif(_curve(hi) - _curve(lo), F.lit(0.0)).alias("_span"))


def _place(v: Column) -> Column:
    """Where v lies between lo and hi, from 0 to 1, never falling with v: by logarithms where the range spans magnitudes, so that any spread of values takes few rounds."""
    return (_curve(v) - F.col("_first")) / F.col("_span")


def _picked(inside: DataFrame, wants: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, k, value) by counting every value of ranges that hold few."""
    key = [*groups, "lo", "hi"]
    counts = inside.groupBy(*key, "_v").agg(F.count("*").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(*key).orderBy("_v")) - F.col("_held")
    met = by_groups(wants, counts.withColumn("_before", before), key).withColumn("_k", F.col("k") - F.col("below"))
    return met.filter((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_held"))).select(*groups, "k", F.col("_v").alias("value"))


def _interpolated(values: DataFrame, large: DataFrame, groups: list[str], qs: list[float]) -> DataFrame:
    at = values.groupBy(*groups).agg(F.map_from_entries(F.collect_set(F.struct("k", "value"))).alias("_at"))
    both = by_groups(large, at, groups)
    value = lambda r: F.element_at("_at", r)
    each = [F.when(value(a) == value(b), value(a)).otherwise((b - p) * value(a) + (p - a) * value(b)) for p, a, b in _ranks(qs, F.col("n"))]
    return both.select(*groups, F.array(*each).alias("quantiles"), "n")
