"""Distributions of values by volume: cumulative tables, histograms, densities, peaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairvox.operators.filters import footprint, local_change_slabs
from pairvox.operators.quantiles import quantiles


def global_min_max(df: DataFrame, v: str) -> DataFrame:
    return df.agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"))


def masked_min_max(slices: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((min_value, max_value) over the masks' pixels, (volume_id, reason) of volumes that are skipped): SHAPE if a slice or a shape differs, EMPTY if the mask has no pixel."""
    both = slices.select("volume_id", "z", "height", "width", "px").join(masks.select("volume_id", "z", F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("px").alias("_m")), ["volume_id", "z"], "full")
    values = F.transform(F.filter(F.arrays_zip("px", "_m"), lambda s: s["_m"] > 0), lambda s: s["px"])
    fits = F.coalesce((F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w")), F.lit(False))
    found = both.withColumn("_v", F.when(fits, values)).groupBy("volume_id").agg(F.min(fits).alias("fits"), F.min(F.array_min("_v")).alias("lo"), F.max(F.array_max("_v")).alias("hi"))
    reason = F.when(~F.col("fits"), "SHAPE").when(F.col("lo").isNull(), "EMPTY")
    good = found.filter(reason.isNull())
    return good.agg(F.min("lo").alias("min_value"), F.max("hi").alias("max_value")), found.select("volume_id", reason.alias("reason")).filter("reason IS NOT NULL")


def npeaks_find(
    slices: DataFrame, masks: DataFrame, *, strategies: dict[str, str | Callable[[np.ndarray, np.ndarray], float | None]],
    change: Callable[[DataFrame], DataFrame] | None = None, threshold: Column | dict[str, Column] | None = None,
    curve: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None,
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), radius: float = 3.0, quantile: float | dict[str, float] = 0.5,
    n_levels: int = 1024, grid: int = 10_000, bandwidth: float | None = None, fraction: float = 0.1, span: tuple[float, float] | None = None, flat: bool = True,
) -> DataFrame:
    """(volume_id, mask, threshold, voxels, bandwidth, peak) for every volume and mask (volume_id, mask, z, px of 0 and 1).

    The local change of the whole volume, its quantile inside the mask, the mask's pixels up to that threshold, their
    level counts and density, its peaks (see `find_peaks`), and the one that strategies[mask] picks (`most` for others); null without a
    peak. The bandwidth is the improved Sheather-Jones one unless given. The grid goes over `span`, or over the values and
    three bandwidths or a twentieth of their range beyond. Pixels meet as arrays by slice; levels (n_levels a mask at
    most) are all that a task for one volume and mask sees.

    Each stage can be a caller's:
    change      from slices to (volume_id, z, lic), such as expressions on `px` or `filters.change_slabs`;
    threshold   an aggregate of `lic` inside the mask, for all masks or by mask (masks that it doesn't name use the quantile);
    curve       from the values and weights of levels to places and heights, in the task of a mask; no bandwidth then (null);
    strategies  a function from the places and heights of a curve to the peak or None. A change of null or NaN lies in no region.
    """
    lic = change(slices) if change else local_change_slabs(slices, footprint(radius * 1.001, spacing))
    meet = slices.select("volume_id", "z", "px").join(lic.select("volume_id", "z", "lic"), ["volume_id", "z"]).join(masks.select("volume_id", "mask", "z", F.col("px").alias("m")), ["volume_id", "z"])
    inside = meet.select("volume_id", "mask", F.explode(F.filter(F.arrays_zip("px", "lic", "m"), lambda s: (s["m"] > 0) & ~F.isnan(s["lic"]))).alias("s")).select("volume_id", "mask", F.col("s.px").alias("v"), F.col("s.lic").alias("lic"))
    fine = inside.join(_thresholds(inside, threshold, quantile), ["volume_id", "mask"]).filter("lic <= threshold")
    ranges = fine.groupBy("volume_id", "mask").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("threshold").alias("threshold"))
    step = (F.col("hi") - F.col("lo")) / (n_levels - 1)
    level = F.coalesce(F.least(F.ceil((F.col("v") - F.col("lo")) / F.nullif(step, F.lit(0.0))), F.lit(n_levels - 1)), F.lit(0)).cast("long")
    counts = fine.drop("threshold").join(ranges, ["volume_id", "mask"]).groupBy("volume_id", "mask", "lo", "hi", "threshold", level.alias("level")).agg(F.count("*").alias("weight"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("level")
        lo, hi = float(pdf["lo"].iloc[0]), float(pdf["hi"].iloc[0])
        level_, weight = pdf["level"].to_numpy(float), pdf["weight"].to_numpy(float)
        value = lo + level_ * (hi - lo) / (n_levels - 1)
        pick, width, peak = strategies.get(pdf["mask"].iloc[0], "most"), None, None
        if curve:
            x, y = curve(value, weight)
        else:
            width = bandwidth or (_fixed_point(value, level_, weight, n_levels)[0] if hi > lo else 0.0)
            peak = lo if hi == lo and not bandwidth else None
            beyond = max(3 * width, 0.05 * (hi - lo))
            a, b = span or (lo - beyond, hi + beyond)
            x = a + np.arange(grid) * ((b - a) / (grid - 1))
            y = np.round(_densities(value, weight, width, a, (b - a) / (grid - 1), grid), 12) if width > 0 else None
        if y is not None and callable(pick):
            peak = pick(x, y)
        elif y is not None:
            found = _peaks_of(y, fraction, flat)
            rank = {"highest": lambda p: (-y[p[0]], p[0]), "left": lambda p: p[0], "right": lambda p: -p[0]}.get(pick, lambda p: (-y[p[2] : p[3] + 1].sum(), p[0]))
            peak = float(x[min(found, key=rank)[0]]) if found else None
        return pd.DataFrame({"volume_id": [pdf["volume_id"].iloc[0]], "mask": [pdf["mask"].iloc[0]], "threshold": [pdf["threshold"].iloc[0]], "voxels": [int(weight.sum())], "bandwidth": pd.array([width], "Float64"), "peak": pd.array([peak], "Float64")})

    kind = slices.schema["volume_id"].dataType.simpleString()
    return counts.groupBy("volume_id", "mask").applyInPandas(run, f"volume_id {kind}, mask string, threshold double, voxels long, bandwidth double, peak double")


def _thresholds(inside: DataFrame, threshold: Column | dict[str, Column] | None, quantile: float | dict[str, float]) -> DataFrame:
    """(volume_id, mask, threshold): a caller's aggregate of `lic`, or its quantile."""
    own = threshold if isinstance(threshold, dict) else {}
    mask, parts = F.col("mask"), []
    if threshold is not None and not isinstance(threshold, dict):
        return inside.groupBy("volume_id", "mask").agg(threshold.cast("double").alias("threshold"))
    for name, expr in own.items():
        parts.append(inside.filter(mask == name).groupBy("volume_id", "mask").agg(expr.cast("double").alias("threshold")))
    rest = inside.filter(~mask.isin(list(own))) if own else inside
    by_mask = quantile if isinstance(quantile, dict) else {}
    qs = sorted({*by_mask.values(), 0.5 if by_mask else quantile})
    at = F.lit(qs.index(0.5 if by_mask else quantile))
    for name, q in by_mask.items():
        at = F.when(mask == name, qs.index(q)).otherwise(at)
    parts.append(quantiles(rest, ["volume_id", "mask"], "lic", qs).select("volume_id", "mask", F.get("quantiles", at).alias("threshold")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def cdf_table(df: DataFrame, *, volume: str, v: str, lo: float, hi: float, n: int) -> DataFrame:
    """(volume, bin, threshold, cdf, n_voxels): the share of values up to each of n equally spaced thresholds. Values are counted by bin first; windows see n rows a volume."""
    step = (hi - lo) / (n - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col(v) - lo) / step)).cast("long")
    counts = df.filter(F.col(v).isNotNull()).groupBy(volume, first.alias("bin")).agg(F.count("*").alias("c"))
    totals = counts.groupBy(volume).agg(F.sum("c").alias("n_voxels"))
    dense = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))).join(counts, [volume, "bin"], "left")
    below = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy(volume).orderBy("bin"))
    return dense.select(volume, "bin", (F.lit(lo) + F.col("bin") * step).alias("threshold"), (below / F.col("n_voxels")).alias("cdf"), "n_voxels")


def histogram_from_cdf(cdf: DataFrame, *, group: list[str] | None = None) -> DataFrame:
    """(group, bin, count): the voxel-weighted mean of the cumulative tables, differences (the first threshold's mass goes), scaled to all voxels."""
    group = group or []
    mean = cdf.groupBy(*group, "bin").agg((F.sum(F.col("cdf") * F.col("n_voxels")) / F.sum("n_voxels")).alias("m"), F.sum("n_voxels").alias("total"))
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    steps = mean.withColumn("d", F.greatest(F.col("m") - F.lag("m").over(by.orderBy("bin")), F.lit(0.0))).filter("d IS NOT NULL")
    return steps.select(*group, "bin", (F.col("d") / F.nullif(F.sum("d").over(by), F.lit(0.0)) * F.col("total")).alias("count"))


def percentiles_from_histogram(h: DataFrame, ps: list[float], *, group: str, lo: float, width: float) -> DataFrame:
    """(group, p, value): linear between bin centres; below the first bin's mass its lower edge."""
    w = Window.partitionBy(group).orderBy("bin")
    run = h.withColumn("acc", F.sum("count").over(w)).withColumn("total", F.sum("count").over(Window.partitionBy(group)))
    run = run.withColumn("q", F.col("acc") / F.col("total")).withColumn("q0", F.coalesce(F.lag("q").over(w), F.lit(0.0)))
    at = run.withColumn("p", F.explode(F.array(*map(F.lit, ps)))).filter((F.col("q") >= F.col("p")) & ((F.col("q0") < F.col("p"))))
    centre = F.lit(lo) + (F.col("bin") + 0.5) * width
    value = centre - width + width * (F.col("p") - F.col("q0")) / (F.col("q") - F.col("q0"))
    return at.select(group, "p", F.greatest(value, F.lit(lo)).alias("value"))


def density(h: DataFrame, *, group: str, width: float, remove_mode: bool = False) -> DataFrame:
    """(group, bin, density); the fullest bin may be left out, the lowest of equal ones."""
    if remove_mode:
        top = h.groupBy(group).agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("bin"))
        h = h.join(top, [group, "bin"], "left_anti")
    return h.select(group, "bin", (F.col("count") / (F.sum("count").over(Window.partitionBy(group)) * width)).alias("density"))


def zero_share(cdf: DataFrame) -> DataFrame:
    """(zeros, tissue): voxels at the first threshold and the rest."""
    first = cdf.filter("bin = 0")
    return first.agg(F.sum(F.col("n_voxels") * F.col("cdf")).alias("zeros"), F.sum(F.col("n_voxels") * (1 - F.col("cdf"))).alias("tissue"))


def range_check(df: DataFrame, *, volume: str, v: str, tolerance: float = 1e-6) -> DataFrame:
    c = F.col(v)
    out = df.groupBy(volume).agg(
        F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
        F.bool_or(F.isnan(c)).alias("has_nan"), F.bool_or(F.abs(c) == float("inf")).alias("has_inf"),
    )
    return out.withColumn("ok", (F.col("min_value") >= -tolerance) & (F.col("max_value") <= 1 + tolerance) & ~F.col("has_nan") & ~F.col("has_inf"))


def nonzero_histogram(df: DataFrame, *, volume: str, v: str, bins: int) -> DataFrame:
    """(volume, bin, count) of finite values other than 0, over each volume's own range; the largest value belongs to the last bin."""
    fine = df.filter((F.col(v) != 0) & ~F.isnan(v) & (F.abs(F.col(v)) < float("inf")))
    ranges = fine.groupBy(volume).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    step = F.nullif((F.col("_b") - F.col("_a")) / bins, F.lit(0.0))
    k = F.coalesce(F.least(F.floor((F.col(v) - F.col("_a")) / step), F.lit(bins - 1)), F.lit(0)).cast("long")
    return fine.join(ranges, volume).groupBy(volume, k.alias("bin")).agg(F.count("*").alias("count"))


def levels(df: DataFrame, *, volume: str, v: str, lo: float, hi: float, n: int) -> DataFrame:
    """(volume, level, value, weight): values rounded up to n levels, and how many there are."""
    step = (hi - lo) / (n - 1)
    level = F.least(F.greatest(F.ceil((F.col(v) - lo) / step), F.lit(0)), F.lit(n - 1)).cast("long")
    return df.groupBy(volume, level.alias("level")).agg(F.count("*").alias("weight")).select(volume, "level", (F.lit(lo) + F.col("level") * step).alias("value"), "weight")


def _direct(value: np.ndarray, weight: np.ndarray, bandwidth: float, x: np.ndarray) -> np.ndarray:
    """Gaussian densities at x, term by term, in pieces of the grid."""
    share = weight / (weight.sum() * bandwidth * np.sqrt(2 * np.pi))
    return np.concatenate([np.exp(-0.5 * ((p[:, None] - value) / bandwidth) ** 2) @ share for p in np.array_split(x, max(1, len(x) * len(value) >> 20))])


def _chirp(c: np.ndarray, angle: float, m: int) -> np.ndarray:
    """sum over j of c[j] * exp(-1j * angle * j * k) for k from 0 to m - 1, as one convolution (Bluestein), whatever the angle."""
    n, turns = len(c), np.longdouble(angle) / (4 * np.longdouble(np.pi))
    half = lambda k: np.exp(-2j * np.pi * np.mod(turns * k.astype(np.longdouble) ** 2, 1).astype(float))  # many turns, so in more digits
    size = 1 << (n + m - 2).bit_length()
    kernel = np.zeros(size, complex)
    kernel[:m] = half(np.arange(m)).conj()
    kernel[size - n + 1 :] = half(np.arange(n - 1, 0, -1)).conj()
    whole = np.fft.ifft(np.fft.fft(c * half(np.arange(n)), size) * np.fft.fft(kernel))
    return whole[:m] * half(np.arange(m))


#: The longest lattice of values and the most frequencies that transforms are worth; beyond, densities are summed term by term.
LATTICE, FREQUENCIES = 1 << 18, 1 << 18


def _lattice(value: np.ndarray, off: float) -> tuple[float, float, np.ndarray] | None:
    """(first, step, places) if the values lie on equal steps, or off them by `off` at most, else None."""
    own = np.unique(value)
    if len(own) < 2:
        return float(own[0]), 1.0, np.zeros(len(value), np.int64)
    step = float(np.diff(own).min())
    places = (value - own[0]) / step
    last = round(float(places.max()))
    if not 0 < last < LATTICE:
        return None
    step = (own[-1] - own[0]) / last
    places = np.rint((value - own[0]) / step).astype(np.int64)
    return (float(own[0]), float(step), places) if np.abs(own[0] + places * step - value).max() <= off else None


def _densities(value: np.ndarray, weight: np.ndarray, bandwidth: float, a: float, step: float, n: int) -> np.ndarray:
    """Gaussian densities at a + i * step for i below n, from values on a lattice (levels) by two fast transforms.

    The sum of Gaussians is a Fourier integral of the weights' transform, damped by exp(-(w * bandwidth)^2 / 2). Both ends are
    lattices, so it is a chirp transform from the levels to frequencies and one back to the grid. Frequencies go as far
    as the damping is above 1e-18, as dense as images of the curve stay ten bandwidths away; so it equals
    the direct sum to 1e-9 of the highest density. Values without a lattice, very small bandwidths and few terms are summed one by one.
    """
    found = _lattice(value, 1e-10 * bandwidth)
    low, high = min(value.min(), a), max(value.max(), a + (n - 1) * step)
    dw = 2 * np.pi / (high - low + 20 * bandwidth)
    m = int(np.ceil(9.2 / bandwidth / dw)) + 1
    if not found or m > FREQUENCIES or (m + n) * 40 > len(value) * n:
        return _direct(value, weight, bandwidth, a + np.arange(n) * step)
    first, gap, places = found
    counts = np.bincount(places, weights=weight)
    w = np.arange(m) * dw
    spectrum = _chirp(counts.astype(complex), gap * dw, m) * np.exp(-0.5 * (w * bandwidth) ** 2) * np.exp(1j * w * (a - first))
    spectrum[0] /= 2
    y = _chirp(spectrum.conj(), step * dw, n).real * dw / (np.pi * weight.sum())
    return np.where(y > 1e-14 * y.max(), y, 0.0)


def kde(levels_: DataFrame, *, volume: str, bandwidth: Column, lo: float, hi: float, grid: int, scaled: bool = False) -> DataFrame:
    """(volume, i, x, pdf): Gaussian densities on a grid from level counts (levels, or weighted values); scaled: they add up to the weights, not to 1.

    A volume has a bounded number of levels, so its densities are two fast transforms in one task; nothing but levels is
    shuffled. A wide range of values needs no rescaling here: frequencies follow the bandwidth.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        step = (hi - lo) / (grid - 1)
        x = lo + np.arange(grid) * step
        y = _densities(pdf["value"].to_numpy(float), pdf["weight"].to_numpy(float), float(pdf["_bandwidth"].iloc[0]), lo, step, grid)
        return pd.DataFrame({volume: pdf[volume].iloc[0], "i": np.arange(grid), "x": x, "pdf": y * pdf["weight"].sum() if scaled else y})

    kind = levels_.schema[volume].dataType.simpleString()
    return levels_.withColumn("_bandwidth", bandwidth).groupBy(volume).applyInPandas(run, f"{volume} {kind}, i long, x double, pdf double")


def silverman(df: DataFrame, *, volume: str, v: str) -> DataFrame:
    """(volume, bandwidth) by the rule of thumb from the standard deviation and the quartiles."""
    s = df.groupBy(volume).agg(F.stddev_samp(v).alias("s"), (F.percentile(v, 0.75) - F.percentile(v, 0.25)).alias("iqr"), F.count(v).alias("n"))
    return s.select(volume, (0.9 * F.least(F.col("s"), F.col("iqr") / 1.34) * F.pow("n", F.lit(-0.2))).alias("bandwidth"))


#: Numbers that a step of the bandwidths' search holds at once.
SEARCHED = 1 << 20


def _fixed_points(p: np.ndarray, size: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bandwidths, whether their fixed points were found): the improved Sheather-Jones ones of many curves at once. p: shares of levels, a row a curve."""
    n = p.shape[1]
    some = max(1, SEARCHED // (400 * n))
    parts = [_roots(p[k : k + some], size[k : k + some]) for k in range(0, len(p), some)]
    t, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.sqrt(t) * step * n, found


def _roots(p: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = p.shape[1]
    k = np.arange(n)
    a = 2 * (np.exp(-0.5j * np.pi * k / n) * np.fft.fft(p, 2 * n)[:, :n]).real  # the cosine transform
    a2, k2 = (a[:, 1:] / 2) ** 2, k[1:].astype(float) ** 2
    terms = {s: (2 * np.pi ** (2 * s) * k2**s * a2)[:, :, None] for s in range(2, 8)}
    functional = lambda s, t: (np.exp(t[:, :, None] * (-np.pi**2 * k2)) @ terms[s])[:, :, 0]

    def gap(t: np.ndarray) -> np.ndarray:
        f = functional(7, t)
        for s in range(6, 1, -1):
            c = (1 + 0.5 ** (s + 0.5)) / 3 * np.prod(np.arange(1, 2 * s, 2)) / np.sqrt(np.pi / 2)
            f = functional(s, (2 * c / size[:, None] / f) ** (2 / (3 + 2 * s)))
        return t - (2 * size[:, None] * np.sqrt(np.pi) * f) ** -0.4

    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        grid = np.logspace(-9, -1, 400)
        g = gap(np.broadcast_to(grid, (len(p), 400)))
        flips = (g[:, :-1] < 0) & (g[:, 1:] >= 0)
        found, first = flips.any(1), flips.argmax(1)
        lo, hi = grid[first], grid[first + 1]
        for _ in range(60):
            t = (lo + hi) / 2
            low = gap(t[:, None])[:, 0] < 0
            lo, hi = np.where(low, t, lo), np.where(low, hi, t)
    return np.where(found, t, 0.28 * size**-0.4), found


def _fixed_point(value: np.ndarray, level: np.ndarray, weight: np.ndarray, n: int) -> tuple[float, bool]:
    """The improved Sheather-Jones bandwidth of n level counts, and whether the fixed point was found."""
    p, size = np.zeros((1, n)), weight.sum()
    p[0, level.astype(int)] = weight / size
    step = (value.max() - value.min()) / max(level.max() - level.min(), 1)
    width, found = _fixed_points(p, np.array([size]), np.array([step]))
    return float(width[0]), bool(found[0])


def improved_bandwidth(levels_: DataFrame, *, volume: str, n: int) -> DataFrame:
    """(volume, bandwidth, converged) by the improved Sheather-Jones fixed point on the cosine transform of the level counts (n rows a volume at most).

    A volume's counts are one row of n numbers at most; a task searches the fixed points of many volumes together.
    """
    span = lambda c: F.max(c) - F.min(c)
    packed = levels_.groupBy(volume).agg(F.collect_list(F.col("level").cast("int")).alias("_level"), F.collect_list(F.col("weight").cast("double")).alias("_weight"), (span("value") / F.greatest(span("level"), F.lit(1))).alias("_step"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                p = np.zeros((len(part), n))
                size = np.array([w.sum() for w in part["_weight"]])
                for row, level, weight, total in zip(p, part["_level"], part["_weight"], size, strict=True):
                    row[level] = weight / total
                width, found = _fixed_points(p, size, part["_step"].to_numpy(float))
                yield pd.DataFrame({volume: part[volume], "bandwidth": width, "converged": found})

    return packed.mapInPandas(run, f"{volume} {levels_.schema[volume].dataType.simpleString()}, bandwidth double, converged boolean")


def _walls(y: np.ndarray) -> np.ndarray:
    """For each point the nearest higher one before it, or -1, by a stack of falling heights."""
    out, stack = np.full(len(y), -1), []
    for k, h in enumerate(y.tolist()):
        while stack and y[stack[-1]] <= h:
            stack.pop()
        if stack:
            out[k] = stack[-1]
        stack.append(k)
    return out


def _peaks_of(y: np.ndarray, fraction: float, flat: bool = True) -> list[tuple[int, float, int, int]]:
    """(place, prominence, left, right) of the peaks of one curve; without `flat` a plateau is none."""
    change = np.flatnonzero(np.diff(y) != 0)
    begin, end = np.append(0, change + 1), np.append(change, len(y) - 1)
    level = y[begin]
    tops = [(int(begin[k] + end[k]) // 2) for k in range(1, len(level) - 1) if level[k - 1] < level[k] > level[k + 1] and (flat or begin[k] == end[k])]
    before, after = _walls(y), len(y) - 1 - _walls(y[::-1])[::-1]
    peaks = []
    for i in tops:
        a, b = max(int(before[i]), 0), min(int(after[i]), len(y) - 1)
        low = i - int(np.argmin(y[a : i + 1][::-1]))
        high = i + int(np.argmin(y[i : b + 1]))
        peaks.append((i, float(y[i] - max(y[low], y[high])), low, high))
    best = max((p[1] for p in peaks), default=0.0)
    kept = [p for p in peaks if p[1] >= fraction * best]
    return [(i, p, max([a, *(o[3] for o in kept if o[3] < i)]), min([b, *(o[2] for o in kept if o[2] > i)])) for i, p, a, b in kept]


def find_peaks(h: DataFrame, *, volume: str, i: str, y: str, fraction: float = 0.1, flat: bool = True) -> DataFrame:
    """(volume, i, y, prominence, left, right): local maxima of at least `fraction` of the greatest prominence, with bounds shared out between neighbours.

    A plateau counts at its middle; without `flat` only points above both neighbours count.

    h has a few thousand points a volume at most, so a volume is one pass in one task. Prominence: height above the
    higher of the lowest points on the way to a higher point on either side.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(i)
        at, height = pdf[i].to_numpy(np.int64), pdf[y].to_numpy(float)
        rows = [(pdf[volume].iloc[0], int(at[k]), float(height[k]), p, int(at[a]), int(at[b])) for k, p, a, b in _peaks_of(height, fraction, flat)]
        return pd.DataFrame(rows, columns=[volume, "i", "y", "prominence", "left", "right"])

    kind = h.schema[volume].dataType.simpleString()
    return h.select(volume, i, y).groupBy(volume).applyInPandas(run, f"{volume} {kind}, i long, y double, prominence double, left long, right long")


def select_peak(peaks: DataFrame, h: DataFrame, *, volume: str, i: str, y: str, strategy: str = "most") -> DataFrame:
    """One peak a volume: highest, left, right, or most (the largest sum between its bounds; also for an unknown strategy)."""
    order = {"highest": [F.desc("y"), "i"], "left": ["i"], "right": [F.desc("i")]}.get(strategy)
    if order is None:
        area = peaks.join(h.select(volume, F.col(i).alias("_j"), F.col(y).alias("_h")), volume).filter("_j >= left AND _j <= right").groupBy(volume, "i").agg(F.sum("_h").alias("_area"))
        peaks, order = peaks.join(area, [volume, "i"]), [F.desc("_area"), "i"]
    return peaks.withColumn("_k", F.row_number().over(Window.partitionBy(volume).orderBy(*order))).filter("_k = 1").drop("_k", "_area")


def split_intensity(h: DataFrame, lic: DataFrame, *, volume: str, contrast: str, digits: int | None = None) -> DataFrame:
    """(volume, i): where lic's density is highest against h's, on the side of the median that the contrast names, tails of 1 % cut. Both: (volume, i, y).

    Of equal shares the least i; shares that `digits` decimals don't tell apart are equal.
    """
    w = Window.partitionBy(volume)
    q = F.sum("y").over(w.orderBy("i")) / F.sum("y").over(w)
    side = h.withColumn("q", q).filter((F.col("q") > 0.01) & (F.col("q") < 0.99)).filter(F.col("q") <= 0.5 if contrast in ("t1", "t1c", "flair") else F.col("q") > 0.5)
    both = side.join(lic.select(volume, "i", F.col("y").alias("_l")), [volume, "i"]).filter("y > 0")
    share = F.col("_l") / F.col("y")
    return both.groupBy(volume).agg(F.max_by("i", F.struct(share if digits is None else F.round(share, digits), -F.col("i"))).alias("i"))
