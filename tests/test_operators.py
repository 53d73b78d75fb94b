"""Operators against numpy and by their properties, on small hand-made slices."""

import gzip
import struct
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairvox.functions import ids, pixels
from pairvox.operators import dose, filters, geometry, joins, metrics, ranktests, splits, stats
from pairvox.sources import tables
from pairvox.streaming import streams

RNG = np.random.default_rng(2)


def as_slices(spark, cubes):
    rows = [(k, z, p.shape[0], p.shape[1], p.ravel().tolist()) for k, c in cubes.items() for z, p in enumerate(c)]
    return spark.createDataFrame(rows, "volume_id string, z long, height int, width int, px array<double>")


def as_cubes(df):
    out = {}
    for r in df.orderBy("volume_id", "z").collect():
        out.setdefault(r.volume_id, []).append(np.array(r.px).reshape(r.height, r.width))
    return {k: np.stack(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def cube():
    return np.arange(3 * 4 * 5, dtype=float).reshape(3, 4, 5)


def test_geometry(spark, cube):
    s = as_slices(spark, {"a": cube})
    assert (as_cubes(geometry.crop_pad_xy(s, 7, -1.0))["a"] == np.pad(cube, ((0, 0), (1, 2), (1, 1)), constant_values=-1)).all()
    assert (as_cubes(geometry.crop_pad_xy(s, 2, -1.0))["a"] == cube[:, 1:3, 1:3]).all()
    assert (as_cubes(geometry.recenter(geometry.recenter(s, 8, 9, -5.0), 4, 5, -5.0))["a"] == cube).all()
    assert (as_cubes(geometry.downsample2(s))["a"] == cube[:, ::2, ::2]).all()
    assert (as_cubes(geometry.upsample2(s))["a"] == cube.repeat(2, 1).repeat(2, 2)).all()
    assert (as_cubes(geometry.downsample2(geometry.upsample2(s)))["a"] == cube).all()
    assert (as_cubes(geometry.transpose(s))["a"] == cube.transpose(0, 2, 1)).all()
    assert (as_cubes(geometry.transpose(geometry.transpose(s)))["a"] == cube).all()
    other = as_slices(spark, {"a": -cube})
    both = geometry.concat_ab(s, other)
    assert (as_cubes(both)["a"] == np.concatenate([cube, -cube], axis=2)).all()
    assert [(r.max_a, r.max_b) for r in geometry.verify_ab(both, s, other).collect()] == [(0.0, 0.0)] * 3
    narrow = other.withColumn("width", F.lit(4))
    assert geometry.concat_ab(s, narrow).count() == 0
    box = geometry.mask_bbox_xy(geometry.pixels(s).withColumn("v", F.col("v") - 57), margin=1, height=4, width=5)
    assert [tuple(r) for r in box.collect()] == [("a", 2, 4, 2, 5)]
    assert (as_cubes(geometry.crop_to_bbox(s, box))["a"] == cube[:, 2:4, 2:5]).all()
    assert as_cubes(geometry.trim_ends(s))["a"].shape == (1, 4, 5)
    assert geometry.middle_slice(s).first().z == 1 and geometry.pseudo3d(s).count() == 1


def test_pixel_scalars(spark):
    v = spark.createDataFrame([(-2000.0,), (-1024.0,), (88.0,), (1200.0,), (5000.0,)], "v double")
    got = v.select(pixels.window_scale(F.col("v")).alias("w"), pixels.max_scale(F.col("v")).alias("m"), pixels.unit_to_hu(pixels.window_scale(F.col("v"))).alias("h"), pixels.quantize_u8(pixels.window_scale(F.col("v")), rounded=True).alias("q")).collect()
    assert [r.w for r in got] == [0, 0, 0.5, 1, 1] and [r.h for r in got] == [-1024, -1024, 88, 1200, 1200] and [r.q for r in got] == [0, 0, 128, 255, 255]
    assert v.select(pixels.unit_to_hu(F.lit(0.0), signed=True).alias("h")).first().h == 88
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "v double")
    assert [r.f for r in odd.select(pixels.finite(F.col("v")).alias("f")).collect()] == [None, None, 1.0, None]


def test_ids(spark):
    names = ["AB_1ABA005", "TH_1THA001", "1HND012", "B_1BA001", "1PC045", "xyz", "", "AB-12.nii", None, "AB_1A005", "1A005", "HN_1D012", "B_1A005", "1PA005x"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(ids.parse_case_id(F.col("n")).alias("s")).collect()]
    assert [tuple(g) if g else None for g in got] == [("1ABA005", "AB", "A", 2025), ("1THA001", "TH", "A", 2025), ("1HND012", "HN", "D", 2025), ("1BA001", "B", "A", 2023), ("1PC045", "P", "C", 2023), None, None, None, None, ("1A005", "AB", "A", 2025), ("1A005", "UNK", "A", 2025), ("1D012", "HN", "D", 2025), ("1A005", "UNK", "A", 2025), ("1PA005", "P", "A", 2023)]
    rows = spark.createDataFrame([("AB_1ABA005-36.nii",), ("AB_1ABA009_38.nii",), ("nope",), (None,)], "n string")
    assert [tuple(r) for r in rows.select(ids.slice_patient(F.col("n")), ids.slice_number(F.col("n"))).collect()] == [("AB_1ABA005", 36), ("AB_1ABA009", 38), (None, None), (None, None)]
    assert spark.range(1).select(ids.add_suffix(F.lit("a.nii.gz")).alias("a"), ids.drop_suffix(ids.add_suffix(F.lit("a.nii.gz"))).alias("b"), ids.add_suffix(F.lit("a")).alias("c")).first()[:] == ("a_cp256.nii.gz", "a.nii.gz", "a_cp256")


def np_parts(mask, corners=False):
    """Labels from 1 on of the parts of an array of any dimension, by flooding."""
    steps = [o for o in np.ndindex(*[3] * mask.ndim) if any(x != 1 for x in o) and (corners or sum(x != 1 for x in o) == 1)]
    label, n = np.zeros(mask.shape, int), 0
    for start in np.argwhere(mask):
        if not label[tuple(start)]:
            n += 1
            todo = deque([tuple(start)])
            label[tuple(start)] = n
            while todo:
                p = todo.popleft()
                for o in steps:
                    q = tuple(a + b - 1 for a, b in zip(p, o, strict=True))
                    if all(0 <= a < k for a, k in zip(q, mask.shape, strict=True)) and mask[q] and not label[q]:
                        label[q] = n
                        todo.append(q)
    return label


def np_fill(mask):
    label = np_parts(~mask)
    edge = {k for axis in range(mask.ndim) for side in (0, -1) for k in np.unique(np.take(label, side, axis=axis))}
    return mask | ((label > 0) & ~np.isin(label, list(edge)))


def np_steps(mask, n, grow):
    """n steps with the six neighbours, one voxel at a time."""
    for _ in range(n):
        new = mask.copy()
        for p in np.ndindex(mask.shape):
            around = [tuple(a + b for a, b in zip(p, o, strict=True)) for o in filters.CROSS]
            values = [mask[q] if all(0 <= a < k for a, k in zip(q, mask.shape, strict=True)) else False for q in around]
            new[p] = any(values) if grow else all(values)
        mask = new
    return mask


def polygon_area(part):
    """The area of the polygon through the outer pixels' centres of a filled part: walk round it clockwise, then the shoelace formula."""
    own = {tuple(p) for p in np.argwhere(part)}
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    start = min(own)

    def after(here, back):
        for k in range(1, 9):
            dy, dx = around[(back + k) % 8]
            if (here[0] + dy, here[1] + dx) in own:
                empty = around[(back + k - 1) % 8]
                return (here[0] + dy, here[1] + dx), around.index((empty[0] - dy, empty[1] - dx))
        return None

    state = after(start, 0)  # the pixel to the left of the first one is empty
    if state is None:
        return 0.0
    walk, seen = [], set()
    while state not in seen:
        seen.add(state)
        walk.append(state[0])
        state = after(*state)
    y, x = np.array(walk, float).T
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def np_largest(plane):
    label, best, out = np_parts(plane, corners=True), -1.0, np.zeros(plane.shape, bool)
    for k in range(1, label.max() + 1):
        part = np_fill(np.pad(label == k, 1))[1:-1, 1:-1]
        if (area := polygon_area(part)) > best:
            best, out = area, part
    return out


def np_body(cube, t, erosion, dilation, close):
    m = np.stack([np_largest(p) for p in np_steps(cube > t, erosion, False)])
    m = np_steps(m, dilation, True)
    wide = [[p[max(0, y - close) : y + close + 1, max(0, x - close) : x + close + 1].any() for y, x in np.ndindex(p.shape)] for p in m]
    wide = np.array(wide).reshape(m.shape)
    n = (2 * close + 1) ** 2
    shut = [[p[max(0, y - close) : y + close + 1, max(0, x - close) : x + close + 1].sum() == n for y, x in np.ndindex(p.shape)] for p in wide]
    return np_fill(np.array(shut).reshape(m.shape))


def test_body_mask(spark):
    cubes = {"a": RNG.standard_normal((5, 12, 12)).cumsum(1).cumsum(2) / 4, "b": np.full((2, 12, 12), -9.0)}
    cubes["a"][1:4, 3:9, 3:9] = 5
    cubes["a"][2, 5, 5] = -5  # a hole in the volume
    cubes["c"] = np.full((4, 12, 12), 5.0)
    cubes["c"][1:, 6, 6] = -5  # a hole in each slice that is open at the last one
    for close, iterations in ((0, 0), (1, 1), (2, 2)):
        got = as_cubes(filters.body_mask(as_slices(spark, cubes), t=0.0, erosion=iterations, dilation=iterations, close=close))
        for k, c in cubes.items():
            assert (got[k] == np_body(c, 0.0, iterations, iterations, close)).all(), (k, close)
    open_hole = as_cubes(filters.fill_holes(as_slices(spark, {"c": (cubes["c"] > 0).astype(float)})))["c"]
    assert (open_hole == (cubes["c"] > 0)).all()


def test_morphology_and_parts(spark):
    cubes = {k: (RNG.random((7, 9, 8)) < p).astype(float) for k, p in (("a", 0.8), ("b", 0.5), ("c", 0.2), ("d", 0.0))}
    s = as_slices(spark, cubes)
    for grow, op in ((True, filters.dilate), (False, filters.erode)):
        got = as_cubes(op(s, iterations=2, depth=3))
        assert all((got[k] == np_steps(c > 0, 2, grow)).all() for k, c in cubes.items())
    got = as_cubes(filters.largest_component(s))
    assert all((got[k] == np.stack([np_largest(p) for p in c > 0])).all() for k, c in cubes.items())
    got = as_cubes(filters.fill_holes(s))
    assert all((got[k] == np_fill(c > 0)).all() for k, c in cubes.items())
    for options, dimensions, corners in (({}, 2, False), ({"diagonal": True}, 2, True), ({"volume": True}, 3, False)):
        rows = filters.components(s, **options).collect()
        for k, c in cubes.items():
            names = np.full(c.shape, "", object)
            for r in rows:
                if r.volume_id == k:
                    names[r.z, r.y, r.a : r.b + 1] = r.component
            want = np_parts(c > 0) if dimensions == 3 else np.stack([np_parts(p, corners) for p in c > 0])
            for z in [slice(None)] if dimensions == 3 else range(len(c)):
                pairs = set(zip(names[z].ravel(), want[z].ravel(), strict=True))
                assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    far = as_cubes(filters.erode_by_distance(s, 3.0, (1.5, 1.0, 1.0)))["a"]
    ball = [o for o in np.ndindex(3, 3, 3) if (1.5 * (o[0] - 1)) ** 2 + (o[1] - 1) ** 2 + (o[2] - 1) ** 2 <= 2.25]
    m = cubes["a"] > 0
    for _ in range(2):
        wide = np.pad(m, 1)
        m = np.array([all(wide[z + o[0], y + o[1], x + o[2]] for o in ball) for z, y, x in np.ndindex(m.shape)]).reshape(m.shape)
    assert (far == m).all()


def around(p, offsets, shape):
    seen = (tuple(a + b for a, b in zip(p, o, strict=True)) for o in offsets)
    return [q for q in seen if all(0 <= a < n for a, n in zip(q, shape, strict=True))]


def test_running_extrema():
    """Footprints of any form, cells of NaN, rows shorter than a chord; a ball costs its chords."""
    for k in range(60):
        cube = RNG.standard_normal(tuple(RNG.integers(1, 8, 3)))
        cube[RNG.random(cube.shape) < 0.1] = np.nan
        odd = [tuple(map(int, o)) for o in RNG.integers(-4, 5, (int(RNG.integers(1, 20)), 3))]
        offsets = filters.footprint(RNG.uniform(0.5, 6), tuple(RNG.uniform(0.7, 2, 3))) if k % 2 else odd
        runs = filters.chords(offsets)
        assert sorted((z, y, x + i) for z, y, x, n in runs for i in range(n)) == sorted(set(offsets))
        got = filters.extreme(cube, runs, np.maximum, -np.inf)
        for p in np.ndindex(cube.shape):
            assert got[p] == max([cube[q] for q in around(p, offsets, cube.shape) if cube[q] == cube[q]], default=-np.inf)
    ball = filters.footprint(8.0, (3.0, 1.0, 1.0))
    assert len(filters.chords(ball)) == len({o[:2] for o in ball}) < len(ball) / 10


def test_change_without_values(spark):
    """A pixel that sees NaN alone has no change, and `homogeneous` leaves it out."""
    cube = np.full((1, 3, 7), np.nan)
    cube[0, 1, :2] = 4.0, 7.0
    lic = filters.local_change_slabs(as_slices(spark, {"a": cube}), [(0, 0, 0), (0, 0, 1)])
    got = lic.first().lic
    assert got[7:9] == [3, 0] and got.count(None) == 19
    rows = geometry.pixels(lic.select("volume_id", "z", F.lit(7).alias("width"), F.col("lic").alias("px"))).withColumnRenamed("v", "lic")
    assert [r.x for r in filters.homogeneous(rows, 0.0).collect()] == [1]
    assert filters.local_change_slabs(as_slices(spark, {"a": cube}).limit(0), [(0, 0, 0)]).count() == 0


def test_boxes_in_slices(spark):
    """Squares against direct means and extrema; NaN, slices smaller than the square, other columns."""
    cube = RNG.normal(1e6, 1, (2, 7, 9))
    cube[0, 3, 3], cube[1, :4, :4] = np.nan, np.nan
    s = as_slices(spark, {"a": cube, "b": RNG.normal(0, 1, (1, 2, 3))}).withColumn("low", F.lit("x")).withColumn("more", F.col("px"))
    boxes = {(r.volume_id, r.z): r for r in filters.box_extrema(s, 1).collect()}
    means = {(r.volume_id, r.z): r for r in filters.box_mean(s, 2, ["px", "more"]).collect()}
    for z in (0, 1):
        for k, (y, x) in enumerate(np.ndindex(7, 9)):
            near = cube[z, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
            near = near[~np.isnan(near)]
            assert (boxes["a", z].low[k], boxes["a", z].high[k]) == ((near.min(), near.max()) if len(near) else (None, None))
            wide = cube[z, y - 2 : y + 3, x - 2 : x + 3]
            if 2 <= y < 5 and 2 <= x < 7 and not np.isnan(wide).any():
                assert abs(means["a", z].mean_px[k] - wide.mean()) < 1e-8
            else:
                assert means["a", z].mean_px[k] is None
    assert means["b", 0].mean_more == [None] * 6 and boxes["b", 0].more == boxes["b", 0].px and filters.box_mean(s.limit(0), 1, ["px"]).count() == 0


def test_change_in_a_ball(spark):
    offsets = filters.footprint(2.0, (1.5, 1.0, 1.0))
    assert sorted(offsets) == sorted((z, y, x) for z in (-1, 0, 1) for y in range(-2, 3) for x in range(-2, 3) if (1.5 * z) ** 2 + y * y + x * x <= 4)
    cube = RNG.standard_normal((7, 5, 6))
    one = {p: float(np.ptp([cube[q] for q in around(p, offsets, cube.shape)])) for p in np.ndindex(cube.shape)}
    slabs = filters.local_change_slabs(as_slices(spark, {"a": cube}), offsets, depth=3)
    two = {(r.z, i // 6, i % 6): v for r in slabs.collect() for i, v in enumerate(r.lic)}
    assert one == two and len(one) == 7 * 5 * 6


def test_ssim_and_psnr(spark):
    whole = as_slices(spark, {"a": RNG.standard_normal((2, 9, 9))}).withColumn("a", F.col("px")).withColumn("b", F.col("px"))
    assert [(round(r.ssim, 9), round(r.ssim_masked, 9)) for r in metrics.ssim(whole).collect()] == [(1.0, 1.0)] * 2
    same = geometry.pixels(whole).withColumn("a", F.col("v")).withColumn("b", F.col("v"))
    out = metrics.slice_metrics(same.withColumn("m", F.lit(False)), groups=["z"], real="a", fake="b", mask="m").first()
    assert out.psnr_unmasked == float("inf") and out.mae_masked == 0 and out.mask_voxels == 0
    rows = spark.createDataFrame([("v", 1.0, 5.0, 10), ("v", 3.0, float("inf"), 30), ("v", 5.0, 1.0, 0), ("w", 1.0, 1.0, 0)], "id string, a double, b double, n long")
    got = {r.id: r for r in metrics.volume_metrics(rows, volume="id", unmasked=["a"], masked=["b"], weight="n").collect()}
    assert (got["v"].a, got["v"].b_weighted, got["v"].mask_voxels, got["v"].slice_count) == (3.0, 5.0, 40, 3) and got["w"].b_weighted is None


def np_peaks(y, fraction):
    tops, i = [], 0
    while i < len(y):
        j = i
        while j + 1 < len(y) and y[j + 1] == y[i]:
            j += 1
        if 0 < i and j < len(y) - 1 and y[i - 1] < y[i] > y[j + 1]:
            tops.append((i + j) // 2)
        i = j + 1
    out = []
    for p in tops:
        a = max((k for k in range(p) if y[k] > y[p]), default=0)
        b = min((k for k in range(p + 1, len(y)) if y[k] > y[p]), default=len(y) - 1)
        left, right = y[a : p + 1], y[p : b + 1]
        out.append([p, y[p] - max(left.min(), right.min()), a + len(left) - 1 - int(np.argmin(left[::-1])), p + int(np.argmin(right))])
    best = max((o[1] for o in out), default=0)
    out = [o for o in out if o[1] >= fraction * best]
    return [(p, q, max([a] + [o[3] for o in out if o[3] < p]), min([b] + [o[2] for o in out if o[2] > p])) for p, q, a, b in out]


def test_peaks(spark):
    rows, want = [], []
    for k in range(12):
        y = np.round(RNG.random(40) + np.exp(-(((np.arange(40) - 12) / 4) ** 2)) * 3, 1)
        y[5:8] = y[5]
        rows += [(k, i, float(v)) for i, v in enumerate(y)]
        want += [(k, *p) for p in np_peaks(y, 0.1)]
    h = spark.createDataFrame(rows, "v long, i long, y double")
    found = stats.find_peaks(h, volume="v", i="i", y="y")
    got = sorted((r.v, r.i, r.prominence, r.left, r.right) for r in found.collect())
    assert got == sorted(want)
    for strategy, key in (("highest", lambda p, y: (-y[p[0]], p[0])), ("left", lambda p, y: p[0]), ("right", lambda p, y: -p[0]), ("most", lambda p, y: (-round(float(y[p[2] : p[3] + 1].sum()), 9), p[0]))):
        for r in stats.select_peak(found, h, volume="v", i="i", y="y", strategy=strategy).collect():
            y = np.array([x[2] for x in rows if x[0] == r.v])
            best = min((p[1:] for p in want if p[0] == r.v), key=lambda p: key(p, y))
            assert r.i == best[0], strategy


def test_densities_by_transforms():
    """Within 1e-9 of the direct sum on levels; equal to it on values without a lattice and on a single level."""
    for _ in range(40):
        n, span = int(RNG.integers(2, 1024)), 10.0 ** RNG.uniform(-3, 5)
        value = RNG.normal() * span + np.unique(RNG.integers(0, n, int(RNG.integers(1, n + 1)))) * span / (n - 1)
        weight, h = RNG.integers(1, 1000, len(value)).astype(float), span * 10.0 ** RNG.uniform(-4, 0.5)
        a, b = value.min() - 3 * h, value.max() + 3 * h
        step = (b - a) / 1999
        want = stats._direct(value, weight, h, a + np.arange(2000) * step)
        assert np.abs(stats._densities(value, weight, h, a, step, 2000) - want).max() <= 1e-9 * want.max()
    loose = RNG.random(200)
    x = np.arange(3000) / 2999
    assert (stats._densities(loose, np.ones(200), 0.05, 0.0, 1 / 2999, 3000) == stats._direct(loose, np.ones(200), 0.05, np.arange(3000) * (1 / 2999))).all() and len(x) == 3000
    levels = np.arange(300.0)
    assert stats._lattice(levels, 1e-9) and not stats._lattice(loose, 1e-9)


def test_stages_of_a_caller(spark):
    """Every stage replaced, by mask or for all; null where a caller's pick finds nothing; NaN changes are in no region."""
    cube = RNG.integers(0, 9, (3, 4, 4)).astype(float)
    s = as_slices(spark, {"a": cube})
    mask = lambda name, v: s.select("volume_id", F.lit(name).alias("mask"), "z", F.transform("px", lambda x: F.lit(v)).alias("px"))
    masks = mask("one", 1.0).union(mask("two", 1.0)).union(mask("none", 0.0))
    half = lambda d: d.select("volume_id", "z", F.transform("px", lambda v: F.when(v > 6, float("nan")).otherwise(v)).alias("lic"), F.lit(1).alias("px"))
    pick = {"one": lambda x, y: float(x[np.argmax(y)]), "two": lambda x, y: None}
    got = {r.mask: r for r in stats.npeaks_find(s, masks, strategies=pick, change=half, threshold={"one": F.max("lic")}, quantile={"two": 0.0}, curve=lambda v, w: (v, w), n_levels=9).collect()}
    inside = cube[cube <= 6]
    assert set(got) == {"one", "two"} and got["one"].bandwidth is None
    assert (got["one"].threshold, got["one"].voxels) == (6.0, len(inside)) and got["one"].peak is not None
    assert (got["two"].threshold, got["two"].voxels, got["two"].peak) == (inside.min(), int((inside == inside.min()).sum()), None)
    both = stats.npeaks_find(s, masks, strategies={}, change=half, threshold=F.min("lic") + 1, curve=lambda v, w: (v, w), n_levels=9).collect()
    assert {r.threshold for r in both} == {inside.min() + 1}


def test_influence_of_slices(spark):
    nan = float("nan")
    rows = [("v", 1.0, 2.0, 3), ("v", None, nan, 1), ("v", nan, 4.0, None), ("w", 5.0, 1.0, 0), (None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "id string, `a.u` double, m double, n int").withColumnRenamed("a.u", "u")
    got = {r.id: (r.slices, r.total_mask, r.unmasked_mean, r.masked_weighted_mean) for r in metrics.volume_influence(df, volume="id", metrics={"mae": ("u", "m")}, weight="n").collect()}
    assert got == {"v": (3, 4.0, 1.0, 1.5), "w": (1, 0.0, 5.0, None), None: (1, 1.0, 1.0, 1.0)}
    assert metrics.volume_influence(df.limit(0), volume="id", metrics={"mae": ("u", "m")}, weight="n").count() == 0
    assert [r.id for r in metrics.volume_at(df, "id", 1).collect()] == ["w"] and metrics.volume_at(df, "id", 0).count() == 3
    for k in (-1, 2):
        with pytest.raises(IndexError):
            metrics.volume_at(df, "id", k)


def test_masks_by_place(spark):
    files = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "f string, k int")
    masks = spark.createDataFrame([("z",), ("y",)], "m string")
    got = sorted((r.case_name, r.f, r.m) for r in joins.case_numbers(files, file="f", prefix="P", masks=masks, mask="m").collect())
    assert got == [("P_001", "a", "y"), ("P_002", "b", "z"), ("P_003", "c", None)]
    many = joins.case_numbers(spark.range(1001).select(F.format_string("%05d", "id").alias("f")), file="f", prefix="Q")
    assert many.filter("f = '01000'").first().case_name == "Q_1001" and many.columns == ["f", "case_name"]


def test_pixels_of_planes(spark):
    cube = np.zeros((3, 4, 5))
    cube[1, 2, 1:4] = 1
    px = geometry.pixels(as_slices(spark, {"a": cube, "b": np.zeros((1, 2, 2))}))
    got = metrics.plane_pixels(px, metrics.largest_planes(px)).collect()
    assert {(r.axis, r.plane) for r in got} == {("z", 1), ("y", 2), ("x", 1)} and len(got) == 20 + 15 + 12 and {r.volume_id for r in got} == {"a"}
    assert sum(r.v for r in got if r.axis == "x") == 1 and sum(r.v for r in got if r.axis == "z") == 3


def test_bandwidth_of_a_normal_sample(spark):
    df = spark.createDataFrame([("a", float(x)) for x in RNG.standard_normal(4000)], "v string, x double")
    lv = stats.levels(df, volume="v", v="x", lo=-5.0, hi=5.0, n=512)
    got = stats.improved_bandwidth(lv, volume="v", n=512).first()
    assert got.converged and 0.1 < got.bandwidth < 0.35
    density = stats.kde(lv, volume="v", bandwidth=F.lit(got.bandwidth), lo=-6.0, hi=6.0, grid=241)
    assert abs(density.agg(F.sum("pdf")).first()[0] * 12 / 240 - 1) < 1e-3


def test_cdf_counts_all_voxels(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(4)] + [("b", float(x) / 4) for x in range(12)], "v string, x double")
    cdf = stats.cdf_table(df, volume="v", v="x", lo=0.0, hi=3.0, n=7)
    for k, xs in (("a", [0, 1, 2, 3]), ("b", [x / 4 for x in range(12)])):
        assert [r.cdf for r in cdf.filter(F.col("v") == k).orderBy("bin").collect()] == [sum(x <= 0.5 * i for x in xs) / len(xs) for i in range(7)]
    assert abs(stats.histogram_from_cdf(cdf).agg(F.sum("count")).first()[0] - 16) < 1e-9
    assert stats.zero_share(cdf).first()[:] == (2.0, 14.0)


def test_splits(spark):
    df = spark.createDataFrame([(i, "s" if i < 1 else "t" if i < 3 else "u") for i in range(103)], "k long, s string")
    got = splits.stratified_split(df, key="k", stratum="s")
    counts = {(r.s, r.split): r["count"] for r in got.groupBy("s", "split").count().collect()}
    assert counts[("u", "test")] == 15 and counts[("u", "val")] == 15 and counts[("u", "train")] == 70 and got.count() == 103
    again = splits.stratified_split(df.repartition(3), key="k", stratum="s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError):
        splits.stratified_split(df, key="k", stratum="s", ratios=(0.5, 0.1, 0.1))


def test_rank_tests(spark):
    d = [3.0, -1.0, 0.0, 2.0, 2.0, -5.0, 0.0, 4.0]
    got = ranktests.wilcoxon(spark.createDataFrame([("m", x) for x in d], "m string, d double"), groups=["m"], d="d").first()
    # zeros take ranks 1 and 2 (1.5 each) and go; then 1 -> 3, 2, 2 -> 4.5, 3 -> 6, 4 -> 7, 5 -> 8
    assert (got.t, got.n, round(got.effect, 9)) == (11.0, 6, round((22 - 11) / 33, 9))
    many = spark.createDataFrame([("ab"[i % 2], float(x)) for i, x in enumerate(RNG.integers(-9, 10, 200))], "m string, d double")
    one, several = (sorted(map(tuple, ranktests.wilcoxon(many, groups=["m"], d="d", per=per).collect())) for per in (1000, 10))
    assert one == several and len(one) == 2
    tied = spark.createDataFrame([("m", x) for x in [0.0, -0.0] * 40 + [1.0, -1.0, 2.0, None] * 5], "m string, d double")
    most = ranktests.wilcoxon(tied, groups=["m"], d="d").first()
    assert (most.t, most.n, most.effect) == (5 * 85.5, 15, 5 * 93 / (10 * 85.5 + 5 * 93)) and ranktests.wilcoxon(tied.limit(0), groups=["m"], d="d").count() == 0
    assert abs(ranktests.chi2_tail(5.991, 2) - 0.05) < 1e-4 and abs(ranktests.chi2_tail(18.307, 10) - 0.05) < 1e-4
    rows = [(s, c, float(v)) for s, vs in enumerate([(1, 2, 3), (1, 3, 2), (1, 2, 3), (2, 2, 5)]) for c, v in zip("abc", vs, strict=True)]
    f = ranktests.with_p(ranktests.friedman(spark.createDataFrame([("l", *r) for r in rows], "l string, s long, c string, v double"), groups=["l"], subject="s", within="c", v="v"), statistic="q").first()
    ranks = np.array([(1, 2, 3), (1, 3, 2), (1, 2, 3), (1.5, 1.5, 3)])
    q = (12 / (3 * 4 * 4) * (ranks.sum(0) ** 2).sum() - 3 * 4 * 4) / (1 - 6 / (4 * 3 * 8))
    assert abs(f.q - q) < 1e-9 and f.df == 2 and abs(f.p - np.exp(-q / 2)) < 1e-9
    assert ranktests.choose_test(spark.range(5), group="id") == "friedman" and ranktests.choose_test(spark.range(2), group="id") == "wilcoxon" and ranktests.choose_test(spark.range(1), group="id") == "none"


def test_dvh_of_a_line(spark):
    df = spark.createDataFrame([("a", x, 10 - 2 * x) for x in (0.0, 1.0, 1.5, 4.0)] + [("b", 1.0, 3.0)], "k string, dose double, vol double")
    got = {(r.k, r.dose): round(r.density, 9) for r in dose.differential_dvh(df, keys=["k"], dose="dose", vol="vol").collect()}
    assert set(v for k, v in got.items() if k[0] == "a") == {2.0} and got[("b", 1.0)] == 0


def test_joins(spark):
    files = spark.createDataFrame([("c1", "ct", "a.nii"), ("c1", "ct", "a.mha"), ("c1", "mr", "b.nii"), ("c2", "ct", "x.nii")], "case string, kind string, path string")
    rank = F.when(F.col("path").endswith(".mha"), 0).otherwise(1)
    assert [tuple(r) for r in joins.case_catalog(files, case="case", kind="kind", path="path", rank=rank, required=["ct", "mr"], optional=["mask"]).collect()] == [("c1", "a.mha", "b.nii", None)]
    assert sorted(map(tuple, joins.missing_kinds(files, case="case", kind="kind", required=["mr", "ct"]).collect())) == [("c2", "mr")]
    left, right = spark.createDataFrame([(i,) for i in (5, -3, 8, 2)], "a long"), spark.createDataFrame([(i,) for i in (7, 9, 1)], "b long")
    assert sorted(map(tuple, joins.modulo_pairs(left, right, "a", "b").collect())) == [(-3, 1), (2, 7), (5, 9), (8, 1)]


def test_metric_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.csv").write_text(",file_name,MAE,MSE,PSNR,SSIM\n0,p-1,1.5,inf,x,nan\n1,p-2,,2,3,0.5\n")
    rows = tables.read_metrics(spark, str(tmp_path / "m")).orderBy("file_name").collect()
    assert rows[0].MAE_masked == rows[0].MAE_unmasked == 1.5 and rows[0].MSE_masked == float("inf") and rows[0].PSNR_masked is None and rows[0].SSIM_unmasked is None and rows[0].mask_voxels == 0
    (tmp_path / "m/a.csv").write_text("file_name,MAE\np,1\n")
    with pytest.raises(ValueError):
        tables.read_metrics(spark, str(tmp_path / "m"))
    (tmp_path / "r.json").write_text('{"results": [{"mae": 1.0, "psnr": 2.0}, {"mae": 3.0}], "aggregates": {"mae": {"mean": 2.0, "std": 1.0}}}')
    results, aggregates = tables.read_results_json(spark, str(tmp_path / "r.json"))
    assert sorted(map(tuple, results.collect())) == [(0, "mae", 1.0), (0, "psnr", 2.0), (1, "mae", 3.0)] and sorted(map(tuple, aggregates.collect())) == [("mae", "mean", 2.0), ("mae", "std", 1.0)]


def test_volumes_from_files(spark, tmp_path):
    for name, order, kind, code in (("a.nii", "<", "i2", 4), ("b.nii.gz", ">", "f4", 16)):
        v = RNG.integers(-100, 100, (2, 3, 4)).astype(order + kind)
        h = bytearray(352)
        struct.pack_into(f"{order}i", h, 0, 348)
        struct.pack_into(f"{order}8h", h, 40, 3, 4, 3, 2, 1, 1, 1, 1)
        struct.pack_into(f"{order}h", h, 70, code)
        struct.pack_into(f"{order}8f", h, 76, 1, 0.5, 0.75, 3, 0, 0, 0, 0)
        struct.pack_into(f"{order}3f", h, 108, 352, 2, 1)
        body = bytes(h) + v.tobytes()
        (tmp_path / name).write_bytes(gzip.compress(body) if name.endswith("gz") else body)
        df = tables.read_nifti(spark, str(tmp_path)).filter(F.col("volume_id") == name[0])
        assert (as_cubes(df)[name[0]] == v.astype(float) * 2 + 1).all() and df.first()[5:8] == (0.5, 0.75, 3.0)


def test_stream_equals_batch(spark, tmp_path):
    lines = [f"[Rank 0] (epoch: {1 + i % 3}, iters: {i}, time: 0.1, data: 0.2) , G_GAN: {i / 4}, G_L1: -{i}.5e-1" for i in range(30)] + ["", "other"]
    for pieces in (1, 2, 5):
        d = tmp_path / f"log{pieces}"
        d.mkdir()
        for k in range(pieces):
            (d / f"{k}.txt").write_text("\n".join(lines[k::pieces]) + "\n")
        batch = sorted(map(tuple, streams.loss_per_epoch(spark.read.text(str(d)), ["G_GAN", "G_L1"]).collect()))
        streams.keep_latest(streams.loss_stream(spark, str(d), ["G_GAN", "G_L1"]), f"file://{tmp_path}/table{pieces}", f"file://{tmp_path}/state{pieces}")
        stream = streams.latest(spark, f"file://{tmp_path}/table{pieces}", ["epoch"])
        assert [tuple(round(x, 9) for x in r) for r in sorted(map(tuple, stream.collect()))] == [tuple(round(x, 9) for x in r) for r in batch] and len(batch) == 3


def test_numbers_from_ranges(spark):
    keys = [int(x) for x in RNG.integers(-(10**12), 10**12, 150)] + [7] * 40 + list(range(100, 160))
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    for per in (1, 7, 1000):
        got = [(r.number, r.k) for r in joins.numbered(df, "k", per=per).collect()]
        assert [k for _, k in sorted(got)] == sorted(keys) and sorted(n for n, _ in got) == list(range(len(keys)))
    assert joins.numbered(df.limit(0), "k").count() == 0
    odd = spark.createDataFrame([(None,), (3,), (1,)], "k long")
    assert [r.k for r in joins.numbered(odd, "k", per=1).orderBy("number").collect()] == [None, 1, 3]


def test_splits_do_not_depend_on_ranges(spark):
    df = spark.createDataFrame([(i, ["a", "b", None][min(i % 7, 2)]) for i in range(400)], "k long, s string")
    whole, pieces = (sorted(map(tuple, splits.stratified_split(df, key="k", stratum="s", per=per).collect()), key=str) for per in (1000, 20))
    assert whole == pieces and len(whole) == 400


def test_subsets_by_both_ways(spark):
    files = spark.createDataFrame([(f"x/{a}_{i}.nii",) for i, a in enumerate(["p1", "p12", "q", "p3"] * 5)] + [("p1.txt",)], "name string")
    ids_ = spark.createDataFrame([("p1",), ("q",), ("_7.",), (None,)], "id string")
    one, two = (sorted(r.name for r in tables.copy_subset(files, ids_, name="name", id_="id", extensions=[".nii"], few=few).collect()) for few in (2000, 0))
    assert one == two == sorted({f"x/{a}_{i}.nii" for i, a in enumerate(["p1", "p12", "q", "p3"] * 5) if "p1" in a or a == "q" or i == 7})


def test_strict_lookups_and_checks(spark):
    models = {"a": {"x": "m1"}}
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "t string, r string")
    assert [r.m for r in df.select(ids.model_lookup(F.col("t"), F.col("r"), models).alias("m")).collect()] == ["m1", None]
    with pytest.raises(Exception, match="no model for"):
        df.select(ids.model_lookup(F.col("t"), F.col("r"), models, strict=True).alias("m")).collect()
    with pytest.raises(Exception, match="grids differ"):
        joins.require_ok(spark.createDataFrame([("c", "MISS")], "case string, status string")).collect()
    cases_ = spark.createDataFrame([("AB_1ABA001",), ("zz",), ("q_7",)], "case string")
    files = spark.createDataFrame([("1ABA001_b_MR.nii.gz",), ("1ABA001_a_MR_x.nii",), ("1ABA001_CT.nii",), ("zz_MR.nii",)], "name string")
    found, missing = joins.token_matches(cases_, files, case="case", name="name")
    assert sorted(map(tuple, found.collect())) == [("AB_1ABA001", "1ABA001", "1ABA001_a_MR_x.nii"), ("zz", "zz", "zz_MR.nii")] and [r.case for r in missing.collect()] == ["q_7"]


def test_peaks_from_pixels(spark):
    """Two tissues of known intensity, apart from their border; bandwidths of their own."""
    cube = RNG.normal(100, 3, (8, 24, 24))
    cube[:, :, 12:] = RNG.normal(180, 3, (8, 24, 12))
    cube[:, :6, :] = RNG.normal(140, 40, (8, 6, 24))
    s = as_slices(spark, {"a": cube})
    whole = s.select("volume_id", F.lit("all").alias("mask"), "z", F.transform("px", lambda v: F.lit(1.0)).alias("px"))
    left = s.select("volume_id", F.lit("left").alias("mask"), "z", F.transform("px", lambda v, i: (i % 24 < 12).cast("double")).alias("px"))
    none = s.select("volume_id", F.lit("none").alias("mask"), "z", F.transform("px", lambda v: F.lit(0.0)).alias("px"))
    got = {r.mask: r for r in stats.npeaks_find(s, whole.union(left).union(none), strategies={"all": "right"}, radius=1.0, n_levels=256, grid=2000).collect()}
    assert set(got) == {"all", "left"} and abs(got["all"].peak - 180) < 4 and abs(got["left"].peak - 100) < 4
    offsets = filters.footprint(1.001, (1.0, 1.0, 1.0))
    lic = np.zeros(cube.shape)
    for p in np.ndindex(cube.shape):
        around = [tuple(a + b for a, b in zip(p, o, strict=True)) for o in offsets]
        values = [cube[q] for q in around if all(0 <= a < n for a, n in zip(q, cube.shape, strict=True))]
        lic[p] = max(values) - min(values)
    inside = lic[:, :, :12]
    assert abs(got["left"].threshold - np.quantile(inside, 0.5)) < 1e-9 and got["left"].voxels == (inside <= np.quantile(inside, 0.5)).sum()


def test_affine_of_files(spark, tmp_path):
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, 3, 1, 1, 1, 1, 1, 1, 1)
    struct.pack_into("<h", h, 70, 16)
    struct.pack_into("<8f", h, 76, -1, 0.5, 0.75, 3, 0, 0, 0, 0)
    struct.pack_into("<3f", h, 108, 352, 1, 0)
    read = lambda: tables.read_nifti(spark, str(tmp_path)).first().affine
    (tmp_path / "a.nii").write_bytes(bytes(h) + b"\0" * 4)
    assert read() == [[0.5, 0, 0, 0], [0, 0.75, 0, 0], [0, 0, 3, 0], [0, 0, 0, 1]]
    struct.pack_into("<h", h, 252, 1)
    struct.pack_into("<6f", h, 256, 0, 0, 1, 7, 8, 9)  # half a turn about z
    (tmp_path / "a.nii").write_bytes(bytes(h) + b"\0" * 4)
    assert read() == [[-0.5, 0, 0, 7], [0, -0.75, 0, 8], [0, 0, -3, 9], [0, 0, 0, 1]]
    struct.pack_into("<h", h, 254, 1)
    struct.pack_into("<12f", h, 280, *range(12))
    (tmp_path / "a.nii").write_bytes(bytes(h) + b"\0" * 4)
    assert read() == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [0, 0, 0, 1]]
