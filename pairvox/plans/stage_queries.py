"""Queries for stages of a caller's, wide footprints, and what a reader asks of one volume."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairvox.operators import filters, joins, metrics, normalize, stats
from pairvox.plans.adapters import CASES, DENSE, PX, cases, dense_slices, pixel_rows, table
from pairvox.plans.queries import NPEAKS_LEVELS, _changes, _gap_sql, _peaks_sql, query, r9

SPACING = (1.5, 1.0, 1.25)


@query(f"""WITH {DENSE}, o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM range(-2, 3) a(i), range(-3, 4) b(i), range(-2, 3) c(i) WHERE pow(1.5 * a.i, 2) + b.i * b.i + pow(1.25 * c.i, 2) <= 9),
 seen AS (SELECT volume_id, z + dz AS z, y + dy AS y, x + dx AS x, v FROM dpx, o) SELECT d.volume_id, d.z, d.y, d.x, max(s.v) - min(s.v) AS lic FROM dpx d JOIN seen s ON s.volume_id = d.volume_id AND s.z = d.z AND s.y = d.y AND s.x = d.x GROUP BY 1, 2, 3, 4""")
def lic_wide_ball(spark, d):
    """Local change in a ball of three units on uneven spacing, by running extrema along its chords."""
    return _changes(filters.local_change_slabs(dense_slices(spark, d), filters.footprint(3.0, SPACING), depth=5))


OWN_BANDWIDTH = f"""{NPEAKS_LEVELS},
 s AS (SELECT volume_id, mask, any_value(lo) AS lo, any_value(hi) AS hi, any_value(voxels)::DOUBLE AS size FROM lev GROUP BY 1, 2),
 c AS (SELECT volume_id, mask, r.k, sum(weight / size * cos(pi() * r.k * (level + 0.5) / 64)) AS a FROM lev JOIN s USING (volume_id, mask), range(1, 64) r(k) GROUP BY 1, 2, 3),
 z AS (SELECT volume_id, mask, any_value(size) AS size, list(a * a ORDER BY c.k) AS a2 FROM c JOIN s USING (volume_id, mask) GROUP BY 1, 2),
 grid AS ({_gap_sql("SELECT z.*, r.i, pow(10.0, -9 + 8.0 * r.i / 399) AS t FROM z, range(400) r(i)")}),
 flip AS (SELECT volume_id, mask, min(i) AS i FROM (SELECT volume_id, mask, i, g, lead(g) OVER (PARTITION BY volume_id, mask ORDER BY i) AS n FROM grid) WHERE g < 0 AND n >= 0 GROUP BY 1, 2),
 b AS (SELECT volume_id, mask, 0 AS turn, pow(10.0, -9 + 8.0 * i / 399) AS low, pow(10.0, -9 + 8.0 * (i + 1) / 399) AS high FROM flip UNION ALL
  SELECT volume_id, mask, turn + 1, CASE WHEN g < 0 THEN t ELSE low END, CASE WHEN g < 0 THEN high ELSE t END FROM ({_gap_sql("SELECT b.*, size, a2, (low + high) / 2 AS t FROM b JOIN z USING (volume_id, mask) WHERE turn < 50")})),
 bw AS (SELECT s.*, CASE WHEN hi > lo THEN sqrt(coalesce((low + high) / 2, 0.28 * pow(size, -0.4))) * (hi - lo) / 63 * 64 ELSE 0 END AS h FROM s LEFT JOIN (SELECT * FROM b WHERE turn = 50) USING (volume_id, mask)),
 ab AS (SELECT *, lo - greatest(3 * h, 0.05 * (hi - lo)) AS a0, hi + greatest(3 * h, 0.05 * (hi - lo)) AS b0 FROM bw),
 w AS (SELECT volume_id, mask, r.i, round(sum(weight / (size * h * sqrt(2 * pi())) * exp(-0.5 * pow((a0 + r.i * ((b0 - a0) / 200) - (ab.lo + level * (ab.hi - ab.lo) / 63)) / h, 2))), 12) AS y FROM lev JOIN ab USING (volume_id, mask), range(201) r(i) WHERE h > 0 GROUP BY 1, 2, 3)"""


@query(f"""WITH RECURSIVE {OWN_BANDWIDTH}, {_peaks_sql('w', 'volume_id, mask')},
 area AS (SELECT b.volume_id, b.mask, b.i, sum(w.y) AS area FROM bounded b JOIN w ON b.volume_id = w.volume_id AND b.mask = w.mask AND w.i BETWEEN l AND r GROUP BY 1, 2, 3),
 pick AS (SELECT volume_id, mask, CASE mask WHEN 'fat' THEN max(i) ELSE arg_max(i, (area, -i)) END AS i FROM area GROUP BY 1, 2)
SELECT ab.volume_id, ab.mask, size::BIGINT AS voxels, round(h, 9) AS bandwidth, round(CASE WHEN h > 0 THEN a0 + i * ((b0 - a0) / 200) ELSE lo END, 9) AS peak FROM ab LEFT JOIN pick p ON p.volume_id = ab.volume_id AND p.mask = ab.mask""")
def npeaks_own_bandwidth(spark, d):
    """Peaks with the bandwidth and the range that each volume and mask ask for, the right one in fat and the fullest in liver."""
    image = dense_slices(spark, d)
    mask = lambda name, keep: image.select("volume_id", F.lit(name).alias("mask"), "z", F.transform("px", keep).alias("px"))
    masks = mask("fat", lambda v: (v > 0).cast("double")).union(mask("liver", lambda v, i: (i % 8 > 2).cast("double")))
    found = stats.npeaks_find(image, masks, strategies={"fat": "right", "liver": "most"}, radius=1.0, n_levels=64, grid=201, flat=False)
    return found.select("volume_id", "mask", "voxels", r9("bandwidth"), r9("peak"))


def gradient(cube: np.ndarray) -> np.ndarray:
    """Central differences along the three axes, absolute and added up; the border repeats itself."""
    wide = np.pad(cube, 1, mode="edge")
    dx, dy, dz = wide[1:-1, 1:-1, 2:] - wide[1:-1, 1:-1, :-2], wide[1:-1, 2:, 1:-1] - wide[1:-1, :-2, 1:-1], wide[2:, 1:-1, 1:-1] - wide[:-2, 1:-1, 1:-1]
    return np.abs(dx) + np.abs(dy) + np.abs(dz)


def _fullest(x: np.ndarray, y: np.ndarray) -> float:
    return float(x[np.argmax(y)])


@query(f"""WITH {DENSE}, g AS (SELECT *, abs(lead(v, 1, v) OVER wx - lag(v, 1, v) OVER wx) + abs(lead(v, 1, v) OVER wy - lag(v, 1, v) OVER wy) + abs(lead(v, 1, v) OVER wz - lag(v, 1, v) OVER wz) AS lic FROM dpx
  WINDOW wx AS (PARTITION BY volume_id, z, y ORDER BY x), wy AS (PARTITION BY volume_id, z, x ORDER BY y), wz AS (PARTITION BY volume_id, y, x ORDER BY z)),
 i AS (SELECT g.*, m.mask FROM g, (VALUES ('fat'), ('liver')) m(mask) WHERE CASE m.mask WHEN 'fat' THEN v > 0 ELSE x > 2 END),
 t AS (SELECT volume_id, mask, CASE mask WHEN 'fat' THEN (min(lic) + max(lic)) / 2 ELSE quantile_cont(lic, 0.25) END AS threshold FROM i GROUP BY 1, 2),
 f AS (SELECT i.volume_id, i.mask, v, threshold FROM i JOIN t ON i.volume_id = t.volume_id AND i.mask = t.mask WHERE lic <= threshold),
 e AS (SELECT volume_id, mask, any_value(threshold) AS threshold, count(*) AS voxels, min(v) AS lo, max(v) AS hi FROM f GROUP BY 1, 2),
 c AS (SELECT f.volume_id, f.mask, coalesce(least(CAST(ceil((v - lo) / nullif((hi - lo) / 15, 0)) AS BIGINT), 15), 0) AS level, count(*) AS n FROM f JOIN e ON f.volume_id = e.volume_id AND f.mask = e.mask GROUP BY 1, 2, 3),
 p AS (SELECT volume_id, mask, arg_max(level, (n, -level)) AS level FROM c GROUP BY 1, 2)
SELECT e.volume_id, e.mask, round(threshold, 9) AS threshold, voxels, round(lo + level * (hi - lo) / 15, 9) AS peak FROM e JOIN p ON p.volume_id = e.volume_id AND p.mask = e.mask""")
def npeaks_own_stages(spark, d):
    """Peaks with every stage a caller's: a gradient, a threshold between least and greatest for one mask, a plain histogram, the fullest level."""
    image = dense_slices(spark, d)
    mask = lambda name, keep: image.select("volume_id", F.lit(name).alias("mask"), "z", F.transform("px", keep).alias("px"))
    masks = mask("fat", lambda v: (v > 0).cast("double")).union(mask("liver", lambda v, i: (i % 8 > 2).cast("double")))
    found = stats.npeaks_find(
        image, masks, change=lambda s: filters.change_slabs(s, gradient, reach=1, depth=5), threshold={"fat": (F.min("lic") + F.max("lic")) / 2}, quantile=0.25,
        curve=lambda value, weight: (value, weight), strategies={"fat": _fullest, "liver": _fullest}, n_levels=16,
    )
    return found.select("volume_id", "mask", r9("threshold"), "voxels", r9("peak"))


@query("""WITH p AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.3) AS a, quantile_cont(l_quantity, 0.8) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(60.0, l_quantity * (20.0 * a + 40.0 * b) / (a * a + b * b))) / 60.0, 9) AS norm FROM lineitem JOIN p USING (l_suppkey)""")
def npeaks_norm_line(spark, d):
    """Peaks mapped by a transformation of a caller's: the line through (0, 0) that is nearest to all pairs."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    marks = items.groupBy("l_suppkey").agg(F.percentile("l_quantity", F.array(F.lit(0.3), F.lit(0.8))).alias("m"))
    found = marks.select("l_suppkey", F.posexplode("m").alias("k", "peak")).select("l_suppkey", "peak", ((F.col("k") + 1) * 20.0).alias("target"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    line = lambda v, xs, ys: v * total(F.zip_with(xs, ys, lambda x, y: x * y)) / total(F.transform(xs, lambda x: x * x))
    return normalize.peaks_normalize(items, found, volume="l_suppkey", v="l_quantity", transform=line).select("l_orderkey", "l_linenumber", r9("norm"))


@query("""WITH e AS (SELECT l_orderkey, count(*) AS slices, sum(l_quantity) AS total_mask, avg(l_tax) AS u1, sum(l_discount * l_quantity) / sum(l_quantity) AS m1, avg(l_discount) AS u2, sum(l_tax * l_quantity) / sum(l_quantity) AS m2 FROM lineitem GROUP BY 1)
SELECT l_orderkey, 'mae' AS metric, slices, total_mask::DOUBLE AS total_mask, round(u1, 11) AS unmasked_mean, round(m1, 11) AS masked_weighted_mean FROM e UNION ALL SELECT l_orderkey, 'mse', slices, total_mask::DOUBLE, round(u2, 11), round(m2, 11) FROM e""")
def volume_influence(spark, d):
    """Plain and mask-weighted means by volume and metric."""
    out = metrics.volume_influence(table(spark, d, "lineitem"), volume="l_orderkey", metrics={"mae": ("l_tax", "l_discount"), "mse": ("l_discount", "l_tax")}, weight="l_quantity")
    return out.withColumns({c: F.round(c, 11) for c in ("unmasked_mean", "masked_weighted_mean")})


@query("""WITH o AS (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY 1 LIMIT 1 OFFSET 100)
SELECT l_orderkey, l_linenumber, round(100.0::DOUBLE * l_quantity / sum(l_quantity) OVER (), 9) AS weight_pct FROM lineitem JOIN o USING (l_orderkey)""")
def slice_influence_at(spark, d):
    """The slices of the volume at place 100 of the sorted ids, which are all ranked."""
    rows = metrics.volume_at(table(spark, d, "lineitem"), "l_orderkey", 100)
    return metrics.slice_influence(rows, volume="l_orderkey", weight="l_quantity").select("l_orderkey", "l_linenumber", r9("weight_pct"))


@query(f"""WITH {PX}, a AS (SELECT volume_id, 'z' AS axis, z AS plane, count(*) AS area FROM px WHERE v > 0 GROUP BY 1, 2, 3 UNION ALL SELECT volume_id, 'y', y, count(*) FROM px WHERE v > 0 GROUP BY 1, 2, 3 UNION ALL SELECT volume_id, 'x', x, count(*) FROM px WHERE v > 0 GROUP BY 1, 2, 3),
 b AS (SELECT volume_id, axis, arg_max(plane, (area, -plane)) AS plane FROM a GROUP BY 1, 2)
SELECT px.volume_id, axis, plane, z, y, x, v FROM px JOIN b ON b.volume_id = px.volume_id AND plane = CASE axis WHEN 'z' THEN z WHEN 'y' THEN y ELSE x END""")
def mask_plane_pixels(spark, d):
    """The pixels of each volume's three planes with most of the mask."""
    px = pixel_rows(spark, d)
    return metrics.plane_pixels(px, metrics.largest_planes(px)).select("volume_id", "axis", "plane", "z", "y", "x", "v")


@query(f"""WITH {CASES}, f AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) AS k FROM cases), m AS (SELECT m_name, row_number() OVER (ORDER BY m_name) AS k FROM (SELECT 'mask-' || s_name AS m_name FROM supplier))
SELECT c_custkey, c_name, 'P_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS case_name, m_name FROM f LEFT JOIN m USING (k)""")
def case_masks(spark, d):
    """Cases numbered by sorted name, masks by sorted place; cases beyond the last mask have none."""
    masks = table(spark, d, "supplier").select(F.concat(F.lit("mask-"), "s_name").alias("m_name"))
    return joins.case_numbers(cases(spark, d).select("c_custkey", "c_name"), file="c_name", prefix="P", masks=masks, mask="m_name").select("c_custkey", "c_name", "case_name", "m_name")
