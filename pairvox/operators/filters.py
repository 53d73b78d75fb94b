"""Windowed filters and morphology on slices as arrays (volume_id, z, height, width, px)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairvox.operators.quantiles import quantiles
from pairvox.operators.spread import cut, smallest_label


def footprint(radius: float, spacing: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """Offsets (dz, dy, dx) of a ball in physical units; spacing is (z, y, x)."""
    reach = [math.floor(radius / s) for s in spacing]
    grid = np.stack(np.meshgrid(*(np.arange(-r, r + 1) for r in reach), indexing="ij"), -1).reshape(-1, 3)
    near = ((grid * np.array(spacing)) ** 2).sum(1) <= radius**2
    return [tuple(map(int, g)) for g in grid[near]]


def _by_slabs(slices: DataFrame, reach: int, depth: int, change: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """(volume_id, z, name) of every slice: slabs of `depth` slices with a halo of `reach` on both sides; missing slices are NaN."""
    slab = F.explode(F.expr(f"sequence(cast(floor((z - {reach}) / {depth}) AS long), cast(floor((z + {reach}) / {depth}) AS long))"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z")
        h, w, low, own = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0]), int(pdf["z"].min()), int(pdf["slab"].iloc[0])
        cube = np.full((int(pdf["z"].max()) - low + 1, h, w), np.nan)
        for z, p in zip(pdf["z"], pdf["px"], strict=True):
            cube[z - low] = np.asarray(p, float).reshape(h, w)
        new = change(cube)
        rows = [(pdf["volume_id"].iloc[0], int(z), new[z - low].ravel().astype(float)) for z in pdf["z"] if z // depth == own]
        return pd.DataFrame(rows, columns=["volume_id", "z", name])

    kind = slices.schema["volume_id"].dataType.simpleString()
    return slices.withColumn("slab", slab).groupBy("volume_id", "slab").applyInPandas(run, f"volume_id {kind}, z long, {name} array<double>")


def _shifted(shape: tuple, o: tuple[int, int, int]) -> tuple[tuple, tuple]:
    """Where the values at an offset go to, and where they come from."""
    to = tuple(slice(max(0, -d), max(0, n - max(0, d))) for d, n in zip(o, shape, strict=True))
    frm = tuple(slice(max(0, d), max(0, n - max(0, -d))) for d, n in zip(o, shape, strict=True))
    return to, frm


def chords(offsets: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(dz, dy, first dx, length) of the runs along x that a footprint consists of."""
    out: list[tuple[int, int, int, int]] = []
    for dz, dy, dx in sorted(set(offsets)):
        if out and out[-1][:2] == (dz, dy) and out[-1][2] + out[-1][3] == dx:
            out[-1] = (*out[-1][:3], out[-1][3] + 1)
        else:
            out.append((dz, dy, dx, 1))
    return out


def running(a: np.ndarray, n: int, pick: np.ufunc, rest: float) -> np.ndarray:
    """pick over each window of n cells of the last axis, by van Herk and Gil-Werman; cells outside hold `rest`.

    Cell i holds the window that begins at i - n + 1, so there are n - 1 cells more than in a. In blocks of n cells, a window
    is the end of one block and the beginning of the next, and running extrema of both are known: three steps a cell for any n.
    """
    if n == 1:
        return a
    width = a.shape[-1] + n - 1
    blocks = -(-(width + n - 1) // n)
    padded = np.full((*a.shape[:-1], blocks * n), rest)
    padded[..., n - 1 : n - 1 + a.shape[-1]] = a
    tiles = padded.reshape(*a.shape[:-1], blocks, n)
    ahead = pick.accumulate(tiles, axis=-1).reshape(padded.shape)
    back = pick.accumulate(tiles[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return pick(back[..., :width], ahead[..., n - 1 : n - 1 + width])


def extreme(cube: np.ndarray, runs: list[tuple[int, int, int, int]], pick: np.ufunc, rest: float) -> np.ndarray:
    """pick (np.maximum or np.minimum) under a footprint given as chords, round each cell; cells outside and NaN hold `rest`.

    Chords of equal length share one pass along the rows, so the cost is the number of chords, not of offsets.
    """
    cube = np.where(np.isnan(cube), rest, cube)
    out = np.full(cube.shape, rest)
    for n in sorted({run[3] for run in runs}):
        along = running(cube, n, pick, rest)
        for dz, dy, dx, length in runs:
            if length != n:
                continue
            to, frm = _shifted((*cube.shape[:2], 1), (dz, dy, 0))
            first = dx + n - 1  # the cell of `along` that holds the window of cell 0
            low, high = max(0, -first), min(cube.shape[2], along.shape[2] - first)
            if low < high:
                here, there = (*to[:2], slice(low, high)), (*frm[:2], slice(low + first, high + first))
                out[here] = pick(out[here], along[there])
    return out


def change_slabs(slices: DataFrame, change: Callable[[np.ndarray], np.ndarray], *, reach: int, depth: int = 16) -> DataFrame:
    """(volume_id, z, lic): any change of a caller's, from a cube of slices (missing ones are NaN) to one of equal shape that sees `reach` slices up and down."""
    return _by_slabs(slices, reach, depth, change, "lic")


def local_change_slabs(slices: DataFrame, offsets: list[tuple[int, int, int]], *, depth: int = 16) -> DataFrame:
    """(volume_id, z, lic) from slices as arrays: largest less smallest value under the footprint round each pixel.

    Cells outside the volume and NaN count for nothing; null where no value is seen. Slabs of `depth` slices with a halo,
    running extrema along the footprint's chords.
    """
    runs = chords(offsets)

    def change(cube: np.ndarray) -> np.ndarray:
        big, small = extreme(cube, runs, np.maximum, -np.inf), extreme(cube, runs, np.minimum, np.inf)
        return np.where(small <= big, big - np.where(small <= big, small, 0), np.nan)

    return change_slabs(slices, change, reach=max(abs(dz) for dz, _, _ in offsets), depth=depth)


def homogeneous(lic: DataFrame, q: float) -> DataFrame:
    """Pixels whose local change is at most its q-quantile in the volume (linear interpolation)."""
    t = quantiles(lic.filter(~F.isnan("lic")), ["volume_id"], "lic", [q]).select("volume_id", F.get("quantiles", F.lit(0)).alias("threshold"))
    return lic.join(t, "volume_id").filter("lic <= threshold")


def _planes(slices: DataFrame, columns: list[str], new: list[str], change: Callable[..., list[np.ndarray]]) -> DataFrame:
    """slices with new arrays, which change makes from a slice's planes; nothing is shuffled. A null pixel comes as NaN, and NaN goes back as null."""
    order = [c for c in slices.columns if c not in new]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [change(*(np.asarray(p, float).reshape(h, w) for p in ps)) for h, w, *ps in zip(*(pdf[c] for c in ("height", "width", *columns)), strict=True)]
            yield pdf[order].assign(**{c: [r[k].ravel() for r in rows] for k, c in enumerate(new)})

    kept = [f for f in slices.schema.fields if f.name in order]
    return slices.mapInPandas(run, T.StructType(kept + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in new]))


def box_extrema(slices: DataFrame, r: int) -> DataFrame:
    """slices with arrays `low` and `high` over the (2r + 1)-square in the slice, by running extrema along both axes; cells outside and NaN count for nothing, null where all are such."""

    def square(plane: np.ndarray, pick: np.ufunc, rest: float) -> np.ndarray:
        out = np.where(np.isnan(plane), rest, plane)
        for _ in (0, 1):
            out = running(out, 2 * r + 1, pick, rest)[:, r : r + out.shape[1]].T
        return np.where(out == rest, np.nan, out)

    return _planes(slices, ["px"], ["low", "high"], lambda p: [square(p, np.minimum, np.inf), square(p, np.maximum, -np.inf)])


def box_mean(slices: DataFrame, r: int, columns: list[str]) -> DataFrame:
    """slices with an array mean_{column} of each array column: means over the (2r + 1)-square by cumulative sums; null where it doesn't lie inside the slice wholly or holds a pixel that is not finite."""
    n = 2 * r + 1

    def mean(plane: np.ndarray) -> np.ndarray:
        fine = np.isfinite(plane)
        middle = plane[fine].mean() if fine.any() else 0.0  # taken off, so that sums keep their digits
        out = np.full(plane.shape, np.nan)
        if min(plane.shape) >= n:
            good = _window_sum(fine.astype(float), r) == n * n
            good[:r], good[len(good) - r :], good[:, :r], good[:, good.shape[1] - r :] = False, False, False, False
            out[good] = _window_sum(np.where(fine, plane - middle, 0.0), r)[good] / (n * n) + middle
        return out

    return _planes(slices, columns, [f"mean_{c}" for c in columns], lambda *planes: [mean(p) for p in planes])


CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _repeated(mask: DataFrame, offsets: list[tuple[int, int, int]], iterations: int, depth: int, grow: bool) -> DataFrame:
    def change(cube: np.ndarray) -> np.ndarray:
        here = np.nan_to_num(cube) > 0
        for _ in range(iterations):
            new = np.full(here.shape, not grow)
            for o in offsets:
                to, frm = _shifted(here.shape, o if not grow else tuple(-d for d in o))
                moved = np.zeros(here.shape, bool)
                moved[to] = here[frm]
                new = new | moved if grow else new & moved
            here = new
        return here

    out = _by_slabs(mask, iterations * max(abs(dz) for dz, _, _ in offsets), depth, change, "_px")
    return _with_pixels(mask, out)


def _with_pixels(slices: DataFrame, new: DataFrame) -> DataFrame:
    sizes = slices.select(*(c for c in slices.columns if c != "px"))
    return sizes.join(new, ["volume_id", "z"]).select(*(F.col("_px").alias("px") if c == "px" else F.col(c) for c in slices.columns))


def erode(mask: DataFrame, offsets: list[tuple[int, int, int]] = CROSS, *, iterations: int = 1, depth: int = 16) -> DataFrame:
    """Pixels whose whole footprint lies in the mask, `iterations` times; the default footprint is the six neighbours in 3-D. Outside the volume counts as none."""
    return _repeated(mask, offsets, iterations, depth, grow=False)


def dilate(mask: DataFrame, offsets: list[tuple[int, int, int]] = CROSS, *, iterations: int = 1, depth: int = 16) -> DataFrame:
    """Pixels of the volume that the footprint reaches from the mask, `iterations` times."""
    return _repeated(mask, offsets, iterations, depth, grow=True)


def erode_by_distance(mask: DataFrame, mm: float, spacing: tuple[float, float, float]) -> DataFrame:
    """Erosion by a distance, in steps of a ball with the coarsest spacing as its radius."""
    step = max(spacing)
    return erode(mask, footprint(step, spacing), iterations=math.ceil(mm / step))


def _each_slice(slices: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Slices with new pixels, plane by plane; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            planes = [np.asarray(p, float).reshape(h, w) for p, h, w in zip(pdf["px"], pdf["height"], pdf["width"], strict=True)]
            yield pdf.assign(px=[change(p).ravel().astype(float) for p in planes])

    return slices.mapInPandas(run, slices.schema)


def _window_sum(plane: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r + 1)-squares with zeros outside, by cumulative sums along each axis."""
    for axis in (0, 1):
        padded = np.concatenate([np.zeros((1, plane.shape[1])), np.cumsum(plane, axis=0)])
        at = np.arange(len(plane))
        plane = (padded[np.minimum(at + r + 1, len(plane))] - padded[np.maximum(at - r, 0)]).T
    return plane


def closing(mask: DataFrame, r: int) -> DataFrame:
    """Dilation, then erosion, with a (2r + 1)-square in the slice; outside counts as none."""
    full = (2 * r + 1) ** 2
    return _each_slice(mask, lambda p: _window_sum((_window_sum((p > 0).astype(float), r) > 0).astype(float), r) == full)


def _runs(plane: np.ndarray) -> np.ndarray:
    """Rows (y, a, b) of runs of true pixels, ends included, in order."""
    padded = np.pad(plane.astype(np.int8), ((0, 0), (1, 1)))
    change = np.diff(padded, axis=1)
    y, a = np.nonzero(change == 1)
    return np.stack([y, a, np.nonzero(change == -1)[1] - 1], axis=1)


def _parts(runs: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each run of one plane the number of the first run of its part; runs of neighbouring rows touch by an edge, or by a corner if diagonal."""
    root = list(range(len(runs)))
    reach, begin = int(diagonal), np.searchsorted(runs[:, 0], np.arange(runs[-1, 0] + 2)) if len(runs) else []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for y in range(1, len(begin) - 1):
        i, j = int(begin[y - 1]), int(begin[y])
        while i < begin[y] and j < begin[y + 1]:
            if runs[i, 1] <= runs[j, 2] + reach and runs[j, 1] <= runs[i, 2] + reach:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            if runs[i, 2] < runs[j, 2]:
                i += 1
            else:
                j += 1
    return np.array([find(i) for i in range(len(runs))], np.int64)


def components(mask: DataFrame, *, volume: bool = False, diagonal: bool = False) -> DataFrame:
    """(volume_id, z, y, a, b, component): runs of the mask and the part they belong to, named by its first run.

    Parts are 4-connected in a slice (8-connected if diagonal); with `volume` they go on into neighbouring slices through
    pixels at the same place. A slice is labelled where it lies; only parts of slices and their links are shuffled, and
    labels spread along the links until none changes, each round checkpointed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for v, z, h, w, p in pdf[["volume_id", "z", "height", "width", "px"]].itertuples(index=False):
                runs = _runs(np.asarray(p, float).reshape(h, w) > 0)
                if len(runs):
                    part = _parts(runs, diagonal)
                    yield pd.DataFrame({"volume_id": v, "z": z, "y": runs[:, 0], "a": runs[:, 1], "b": runs[:, 2], "part": [f"{v}:{z:08d}:{runs[k, 0]:06d}:{runs[k, 1]:06d}" for k in part]})

    kind = mask.schema["volume_id"].dataType.simpleString()
    runs = mask.select("volume_id", F.col("z").cast("long").alias("z"), "height", "width", "px").mapInPandas(run, f"volume_id {kind}, z long, y long, a long, b long, part string")
    if not volume:
        return runs.withColumnRenamed("part", "component")
    runs = cut(runs)
    below = runs.select("volume_id", (F.col("z") + 1).alias("z"), "y", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("part").alias("other"))
    links = runs.join(below, ["volume_id", "z", "y"]).filter("a <= _b AND _a <= b").select(F.col("part").alias("node"), "other").distinct()
    labels = smallest_label(runs.select(F.col("part").alias("node")).distinct(), links)
    return runs.join(labels, runs["part"] == labels["node"]).select("volume_id", "z", "y", "a", "b", F.col("label").alias("component"))


def _filled(part: np.ndarray) -> np.ndarray:
    """A plane's part with its holes: what the rest, by edges, doesn't reach from outside."""
    rest = _runs(~np.pad(part, 1))
    of = _parts(rest, diagonal=False)
    out = np.ones((part.shape[0] + 2, part.shape[1] + 2), bool)
    for y, a, b in rest[of == 0]:
        out[y, a : b + 1] = False
    return out[1:-1, 1:-1]


def _contour_area(part: np.ndarray) -> float:
    """The area inside the line through the centres of a filled part's outer pixels: squares of four pixels count 1, of three a half."""
    n = part[:-1, :-1].astype(int) + part[1:, :-1] + part[:-1, 1:] + part[1:, 1:]
    return float((n == 4).sum() + 0.5 * (n == 3).sum())


def _largest(plane: np.ndarray) -> np.ndarray:
    runs = _runs(plane > 0)
    if not len(runs):
        return np.zeros(plane.shape, bool)
    of, best, kept = _parts(runs, diagonal=True), -1.0, None
    for k in np.unique(of):
        own = runs[of == k]
        y, x, h, w = own[:, 0].min(), own[:, 1].min(), np.ptp(own[:, 0]) + 1, own[:, 2].max() - own[:, 1].min() + 1
        if (h - 1) * (w - 1) <= best:
            continue
        part = np.zeros((h, w), bool)
        for r, a, b in own:
            part[r - y, a - x : b - x + 1] = True
        part = _filled(part)
        if (area := _contour_area(part)) > best:
            best, kept = area, (y, x, part)
    out = np.zeros(plane.shape, bool)
    y, x, part = kept
    out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


def largest_component(mask: DataFrame) -> DataFrame:
    """In each slice the 8-connected part with the largest contour area, its holes filled; of equal ones the first. Empty slices stay."""
    return _each_slice(mask, _largest)


def fill_holes(mask: DataFrame) -> DataFrame:
    """The mask and the parts of its complement, 6-connected in the volume, that touch no side of it; the first and last slice are sides.

    Only complement parts that touch no border of their slice are candidates; they and the runs above and below them
    are joined, and a part is open once any of its slices' parts is.
    """
    rest = components(_each_slice(mask, lambda p: p <= 0))
    sizes = mask.groupBy("volume_id").agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.max("height").alias("h"), F.max("width").alias("w"))
    outside = (F.col("z") == F.col("z0")) | (F.col("z") == F.col("z1")) | (F.col("y") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("a") == 0) | (F.col("b") == F.col("w") - 1)
    parts = rest.join(sizes, "volume_id").withColumn("edge", outside).drop("z0", "z1", "h", "w")
    edge = parts.groupBy("component").agg(F.max("edge").alias("open"))
    parts = cut(parts.drop("edge").join(edge, "component"))
    inner = parts.filter("NOT open")
    near = parts.select("volume_id", "y", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("component").alias("other"), F.col("open").alias("leak"), F.explode(F.array(F.col("z") - 1, F.col("z") + 1)).alias("z"))
    links = cut(inner.join(near, ["volume_id", "z", "y"]).filter("a <= _b AND _a <= b").groupBy("component", "other").agg(F.max("leak").alias("leak")))
    labels = smallest_label(inner.select(F.col("component").alias("node")).distinct(), links.filter("NOT leak").select(F.col("component").alias("node"), "other"))
    leaks = links.groupBy(F.col("component").alias("node")).agg(F.max("leak").alias("leak"))
    closed = labels.join(leaks, "node", "left").groupBy("label").agg(F.max(F.coalesce("leak", F.lit(False))).alias("leak")).filter("NOT leak").select("label")
    holes = inner.join(labels.join(closed, "label").select(F.col("node").alias("component")), "component")
    spans = holes.groupBy("volume_id", "z").agg(F.flatten(F.collect_list(F.array("y", "a", "b"))).alias("_holes"))  # runs of one slice
    schema = mask.schema

    def paint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            planes = []
            for p, w, own in zip(pdf["px"], pdf["width"], pdf["_holes"], strict=True):
                plane = np.array(p, float)
                for y, a, b in np.asarray(own if own is not None else [], np.int64).reshape(-1, 3):
                    plane[y * w + a : y * w + b + 1] = 1
                planes.append(plane)
            yield pdf.assign(px=planes)[schema.names]

    return mask.join(spans, ["volume_id", "z"], "left").select(*mask.columns, "_holes").mapInPandas(paint, schema)


def body_mask(slices: DataFrame, *, t: float = -400.0, erosion: int = 2, dilation: int = 5, close: int = 15) -> DataFrame:
    """Slices of 0 and 1: threshold, erosion in 3-D, the largest filled part of each slice, dilation in 3-D, closing in the slice, holes filled in 3-D."""
    body = slices.withColumn("px", F.transform("px", lambda v: (v > t).cast("double")))
    body = largest_component(erode(body, iterations=erosion))
    return fill_holes(closing(dilate(body, iterations=dilation), close))
