"""What has to hold at any size, against plain versions on small tables."""

import gzip
import math
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairvox.operators import dose, joins, metrics, stats
from pairvox.operators.intervals import interval_join
from pairvox.operators.quantiles import _in_ranges, beside, quantiles
from pairvox.plans import queries as plans
from pairvox.sources import nifti, tables
from pairvox.streaming import streams

RNG = random.Random(2)


def value_lists():
    return {
        "many": [RNG.gauss(0, 1) for _ in range(3000)],
        "ties": [RNG.choice([1.0, 2.0, 2.0, 2.0, 5.0]) for _ in range(1500)],
        "one": [4.5] * 700,
        "wide": [RNG.choice([-1, 1]) * 10 ** RNG.uniform(-300, 300) for _ in range(500)] + [float("inf"), float("-inf"), float("nan"), 1.7e308, -1.7e308],
        "few": [3.0, 1.0, 2.0],
        None: [RNG.random() for _ in range(900)],
        "none": [None, None],
    }


@pytest.mark.parametrize("options", [{}, {"direct": 10, "parts": 50, "gather": 20}])
def test_quantiles_equal_percentile(spark, options):
    qs = [0.0, 0.013, 0.25, 0.5, 0.75, 0.98, 1.0]
    df = spark.createDataFrame([(g, x) for g, xs in value_lists().items() for x in xs], "g string, v double").repartition(5)
    want = {r.g: r for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q"), F.count("v").alias("n")).collect() if r.n}
    got = {r.g: r for r in quantiles(df, ["g"], "v", qs, **options).collect()}
    assert got.keys() == want.keys()
    same = lambda a, b: a == b or (math.isnan(a) and math.isnan(b))
    assert all(got[g].n == want[g].n and all(map(same, got[g].quantiles, want[g].q)) for g in got)


def test_quantiles_of_one_group_and_of_none(spark):
    df = spark.createDataFrame([(x,) for x in value_lists()["many"]], "v double")
    got = quantiles(df, [], "v", [0.1, 0.9], direct=10, parts=8, gather=20).first()
    assert np.allclose(got.quantiles, np.quantile(value_lists()["many"], [0.1, 0.9]), atol=0.2) and got.n == 3000
    assert quantiles(df.filter("v > 100"), [], "v", [0.5]).count() == 0


def test_no_task_sees_a_whole_group(spark):
    plan = quantiles(spark.range(10_000).select((F.col("id") * 1.0).alias("v")), [], "v", [0.5], direct=100, gather=100)
    assert plan.first().quantiles == [4999.5]
    assert "percentile" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_intervals_as_the_plain_version(spark, hot):
    points = [(RNG.choice(["a", "a", "a", "b", None]), RNG.choice([None, float("nan"), 0.0, -1e300, 1e18, float("inf"), RNG.uniform(-100, 100), RNG.uniform(-1e6, 1e6), float(RNG.randrange(9))])) for _ in range(300)]
    spans = []
    for i in range(120):
        lo = RNG.choice([None, float("-inf"), 0.0, RNG.uniform(-120, 100), float(RNG.randrange(9))])
        hi = RNG.choice([None, float("inf"), lo, (lo or 0.0) + 10 ** RNG.uniform(-9, 9), (lo or 0.0) - 1])
        spans.append((RNG.choice(["a", "b", "c", None]), lo, hi, i))
    p = spark.createDataFrame(points, "k string, x double").repartition(3)
    s = spark.createDataFrame(spans, "k string, lo double, hi double, i int").repartition(2)
    for half in (False, True):
        inside = lambda k, x, g, lo, hi: k is not None and k == g and x is not None and x == x and (lo is None or x >= lo) and (hi is None or (x < hi if half else x <= hi)) and not (lo is not None and hi is not None and hi < lo)  # noqa: E731, B023
        want = [(k, x, i) for k, x in points for g, lo, hi, i in spans if inside(k, x, g, lo, hi)]
        alone = [(k, x, None) for k, x in points if not any(inside(k, x, g, lo, hi) for g, lo, hi, _ in spans)]
        got = interval_join(p, s, keys=["k"], at="x", lo="lo", hi="hi", half_open=half, hot_points=hot)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, ((r.k, r.x, r.i) for r in got.collect()))) == sorted(map(str, want))
        left = interval_join(p, s, keys=["k"], at="x", lo="lo", hi="hi", half_open=half, how="left", hot_points=hot)
        assert sorted(map(str, ((r.k, r.x, r.i) for r in left.collect()))) == sorted(map(str, want + alone))


def test_sinks_replace_only_what_they_write(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    read = lambda: sorted(map(tuple, spark.read.parquet(path).select("x", "a", "b").collect()))
    tables.write_partitions(spark.createDataFrame([(1, "p", 1), (2, "p", 2), (3, "q", 1)], "x int, a string, b int"), path, ["a", "b"])
    tables.write_partitions(spark.createDataFrame([(9, "p", 2), (8, "r", 1)], "x int, a string, b int"), path, ["a", "b"])
    assert read() == [(1, "p", 1), (3, "q", 1), (8, "r", 1), (9, "p", 2)]
    tables.write_partitions(spark.createDataFrame([], "x int, a string, b int"), path, ["a", "b"])
    assert len(read()) == 4


def test_a_stream_goes_on_and_a_batch_may_run_twice(spark, tmp_path):
    base, log = f"file://{tmp_path}", tmp_path / "log"
    log.mkdir()
    line = lambda e, g: f"(epoch: {e}, iters: 1, time: 0.1, data: 0.2) G_GAN: {g}\n"
    run = lambda: streams.keep_latest(streams.loss_stream(spark, str(log), ["G_GAN"]), f"{base}/table", f"{base}/state")
    read = lambda p="table": sorted(map(tuple, streams.latest(spark, f"{base}/{p}", ["epoch"]).collect()))
    (log / "a.txt").write_text(line(1, 1.0) + line(2, 5.0))
    run()
    assert read() == [(1, 1.0), (2, 5.0)]
    (log / "b.txt").write_text(line(1, 3.0) + line(3, 7.0))
    run()
    assert read() == [(1, 2.0), (2, 5.0), (3, 7.0)]
    run()  # nothing new
    spark.read.parquet(f"{base}/table/batch=1").write.mode("overwrite").parquet(f"{base}/again")
    spark.read.parquet(f"{base}/again").write.mode("overwrite").parquet(f"{base}/table/batch=1")
    assert read() == [(1, 2.0), (2, 5.0), (3, 7.0)]
    streams.compact(spark, f"{base}/table", ["epoch"], f"{base}/compact")
    assert read("compact") == read()


def test_many_runs_with_headers_of_their_own(spark, tmp_path):
    files = {
        "r1/m.csv": 'file,mae,note\na,1.5,"x, y"\nb,,\n',
        "r2/deep/m.csv": "\ufeffmae , file\n2.5,c\nbad,d\n3,e,9,9\n\n",
        "r3/m.csv": "file,old\nf,-1e3\n",
        "r4/m.csv": "file,mae\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    good, bad = tables.read_runs(spark, [str(tmp_path)], "file string, mae double, note string, absent int".replace("file", "name"), run=r"/(r\d)/", renamed={"old": "mae", "file": "name"})
    assert sorted((r.run, r.name, r.mae, r.note, r.absent) for r in good.collect()) == [("r1", "a", 1.5, "x, y", None), ("r1", "b", None, None, None), ("r2", "c", 2.5, None, None), ("r3", "f", -1000.0, None, None)]
    assert sorted((r.run, r.line, r.why) for r in bad.collect()) == [("r2", "3,e,9,9", "more fields than names"), ("r2", "bad,d", "mae")]
    one, _ = tables.read_runs(spark, [str(tmp_path / "r4")], "name string", renamed={"file": "name"})
    assert one.count() == 0


def volume_file(path, cube, order="<", kind="f4", slope=1.0, shift=0.0):
    head = bytearray(352)
    struct.pack_into(f"{order}i", head, 0, 348)
    struct.pack_into(f"{order}8h", head, 40, 3, cube.shape[2], cube.shape[1], cube.shape[0], 1, 1, 1, 1)
    struct.pack_into(f"{order}h", head, 70, next(c for c, k in nifti.KINDS.items() if k == kind))
    struct.pack_into(f"{order}8f", head, 76, 1, 0.5, 0.75, 3, 0, 0, 0, 0)
    struct.pack_into(f"{order}3f", head, 108, 352, slope, shift)
    body = bytes(head) + cube.astype(order + kind).tobytes()
    path.write_bytes(gzip.compress(body) if path.name.endswith("gz") else body)


def test_volumes_as_a_data_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nifti, "TASK_BYTES", 3000)
    monkeypatch.setattr(nifti, "BATCH_VALUES", 30)
    rng, cubes = np.random.default_rng(4), {}
    (tmp_path / "deep").mkdir()
    for name, order, kind in (("a.nii", "<", "i2"), ("deep/b.nii.gz", ">", "f4"), ("big.nii", "<", "f8"), ("c.nii.gz", "<", "u1")):
        cube = rng.integers(0, 100, (70 if name == "big.nii" else 5, 3, 4)).astype(float)
        volume_file(tmp_path / name, cube, order, kind, 2.0, 1.0)
        cubes[nifti._stem(name)] = cube * 2 + 1
    (tmp_path / "notes.txt").write_text("no volume")
    nifti.register(spark)
    parts = nifti.VolumeReader(str(tmp_path)).partitions()
    assert sum(len(p.parts) for p in parts) == 6 and max(n for p in parts for *_, n in p.parts) == 3  # the big one in three shares
    rows = spark.read.format("nifti").load(str(tmp_path)).collect()
    got = {n: np.stack([r.px for r in sorted((r for r in rows if r.volume_id == n), key=lambda r: r.z)]).reshape(-1, 3, 4) for n in cubes}
    assert all((got[n] == cubes[n]).all() for n in cubes) and len(rows) == 85
    assert {(r.height, r.width, r.sx, r.sy, r.sz) for r in rows} == {(3, 4, 0.5, 0.75, 3.0)} and rows[0].affine[2] == [0, 0, 3, 0]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    some = spark.read.format("nifti").option("pushdown", "true").load(str(tmp_path))
    for cond, n in (("volume_id = 'big' AND z > 60 AND z <= 65", 5), ("volume_id IN ('a', 'b') AND z = 2", 2), ("volume_id LIKE 'b%' AND z >= 4", 67), ("z < 1 AND height = 3", 4), ("z < 0", 0), ("volume_id = 'none'", 0)):
        assert some.filter(cond).count() == n, cond
    reader = nifti.FilteringReader(str(tmp_path))
    assert not list(reader.pushFilters([nifti.EqualTo(("volume_id",), "c"), nifti.LessThan(("z",), 2)])) and [p.parts for p in reader.partitions()] == [[(str(tmp_path / "c.nii.gz"), 0, 1)]]


def test_written_volumes(spark, tmp_path):
    rows = [(f"v{i}", z, 2, 3, [float(i * 100 + z * 10 + k) for k in range(6)], 0.5) for i in range(3) for z in range(4)]
    df = spark.createDataFrame(rows, "volume_id string, z int, height int, width int, px array<double>, sx double")
    for kind, compressed in (("f4", True), ("i2", False)):
        path = f"file://{tmp_path}/{kind}"
        nifti.write_volumes(df.repartition(5), path, kind=kind, compressed=compressed)
        nifti.write_volumes(df.filter("volume_id = 'v1'"), path, kind=kind, compressed=compressed)
        back = spark.read.format("nifti").load(path)
        assert sorted((r.volume_id, r.z, r.height, r.width, list(r.px), r.sx) for r in back.collect()) == sorted(rows)
        plain = tables.read_nifti(spark, path)
        assert sorted((r.volume_id, r.z, list(r.px)) for r in plain.collect()) == sorted((r[0], r[1], r[4]) for r in rows)
    with pytest.raises(Exception, match="not 0, 1, 2"):
        nifti.write_volumes(df.filter("z <> 1"), f"file://{tmp_path}/holes")


def test_a_cut_off_file_is_an_error(spark, tmp_path):
    volume_file(tmp_path / "a.nii", np.zeros((4, 3, 4)))
    (tmp_path / "a.nii").write_bytes((tmp_path / "a.nii").read_bytes()[:-5])
    nifti.register(spark)
    with pytest.raises(Exception, match="ends before slice"):
        spark.read.format("nifti").load(str(tmp_path)).count()


def test_numbers_as_text(spark):
    values = [0.0, 1.0, -2.5, 123456.0, 1234567.0, 999999.5, 0.0001, 0.00001234567, -0.000123456789, 1e300, 2.5e-308, 100000.0, 3.14159265, 1e-7, None, float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", metrics.significant(F.col("x")).alias("s")).collect()
    assert [r.s for r in rows] == ["n/a" if x is None or x != x else f"{x:.6g}" for x in values]


def test_boxes_do_not_mix_factors(spark):
    df = spark.createDataFrame([("a", "g", 1.0, "r1"), ("a", "g", 2.0, "r2"), ("b", "g", None, "r1")], "f string, g string, v double, run string")
    with pytest.raises(ValueError, match="run"):
        metrics.box_whiskers(df, facet="f", group="g", v="v", factors=["run"])
    got = {tuple(r) for r in metrics.box_whiskers(df, facet="f", group="g", v="v").collect()}
    assert got == {("a", "g", 2, 1.25, 1.5, 1.75, 1.0, 2.0, 0), ("Total", "g", 2, 1.25, 1.5, 1.75, 1.0, 2.0, 0)}


def test_the_first_of_repeated_rows_counts(spark):
    df = spark.createDataFrame([("m", "l", "p", 2, 9.0), ("m", "l", "p", 1, None), ("m", "l", "p", 3, 1.0), ("m", "l", "q", 1, 4.0)], "m string, l string, p string, i int, v double")
    assert [tuple(r) for r in dose.patient_range(df, model="m", label="l", patient="p", v="v", order=["i"]).collect()] == [("m", "l", 4.0, 9.0, 6.5)]


def test_ways_to_find_ids_agree(spark):
    ids = sorted({"".join(RNG.choices("abé", k=RNG.randrange(1, 6))) for _ in range(60)})
    names = [("".join(RNG.choices("abéc", k=RNG.randrange(0, 9))) + RNG.choice([".nii", ".x"]),) for _ in range(300)] + [(None,)]
    files, listed = spark.createDataFrame(names, "`file name` string"), spark.createDataFrame([(x,) for x in [*ids, None]], "i string")
    want = sorted({n for (n,) in names if n and n.endswith(".nii") and any(i in n for i in ids)})
    for options in ({}, {"few": 5}, {"few": 5, "shipped": 10}):
        got = tables.copy_subset(files.toDF("name"), listed, name="name", id_="i", extensions=[".nii"], **options)
        assert sorted(r[0] for r in got.collect()) == want, options


def test_text_keys_are_numbered_in_ranges(spark):
    names = sorted({"".join(RNG.choices("abé#0", k=RNG.randrange(1, 6))) for _ in range(400)})
    rows = spark.createDataFrame([(n,) for n in RNG.sample(names, len(names))] + [(None,)], "name string")
    assert [r.name for r in joins.numbered(rows, "name", per=20).sort("number").collect()] == [None, *names]
    assert rows.select(joins.range_of(rows, "name", per=20).alias("r")).distinct().count() > 5


def test_equal_shares_split_at_the_least_place(spark):
    h = spark.createDataFrame([("v", i, n) for i, n in enumerate([1.0, 3.0, 7.0, 11.0, 100.0])], "v string, i long, y double")
    lic = spark.createDataFrame([("v", i, y) for i, y in enumerate([0.01, 0.12, 0.07 * 4, 0.1 + 0.2 + 0.14, 1.0])], "v string, i long, y double")
    got = stats.split_intensity(h, lic, volume="v", contrast="t1", digits=9).collect()
    assert [(r.v, r.i) for r in got] == [("v", 1)]


def test_many_bandwidths_at_once(spark):
    rows = [(v, k, k * 0.5, RNG.randrange(1, 30)) for v in range(20) for k in range(v % 3, 64 - v)]
    got = {r.v: r for r in stats.improved_bandwidth(spark.createDataFrame(rows, "v long, level long, value double, weight long"), volume="v", n=64).collect()}
    for v, r in got.items():
        level, value, weight = (np.array([x[i] for x in rows if x[0] == v], float) for i in (1, 2, 3))
        assert (r.bandwidth, r.converged) == pytest.approx(stats._fixed_point(value, level, weight, 64), abs=1e-12)
    p = np.array([[r.count(k) for k in range(64)] for r in ([RNG.randrange(64) for _ in range(300)] for _ in range(50))], float)
    many = stats._fixed_points(p / 300, np.full(50, 300.0), np.ones(50))[0]
    assert many == pytest.approx([stats._fixed_point(np.arange(64.0), np.arange(64.0), w, 64)[0] for w in p], abs=1e-9)


def test_large_groups_stay_where_they_are(spark):
    rows = spark.range(4000).select((F.col("id") % 3 == 0).alias("f"), (F.col("id") % 2).cast("string").alias("g"), (F.col("id") % 997).cast("double").alias("v"))
    each = rows.groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for direct in (10, 10_000):
        plan = beside(rows, each, ["g"], direct)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    ranges = spark.createDataFrame([("0", 0.0, 9.0), ("1", 5.0, 99.0)], "g string, lo double, hi double")
    assert "SortMergeJoin" not in _in_ranges(rows.withColumnRenamed("v", "_v"), ranges, ["g"])._jdf.queryExecution().executedPlan().toString()


def test_every_line_of_runs_in_one_table(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "m.csv").write_text('name,mae\n"a, b",1\nc,x\nd,2,3\n')
    got = tables.parse_runs(spark, [str(tmp_path)], "mae double, name string").collect()
    assert sorted((r.run, r.line, r.why, r.mae if r.why is None else None, r.name) for r in got) == sorted([("r1", '"a, b",1', None, 1.0, "a, b"), ("r1", "c,x", "mae", None, "c"), ("r1", "d,2,3", "more fields than names", None, "d")])


def test_few_pieces_that_are_no_ids_are_shuffled(spark):
    files = spark.range(2000).select(F.concat(F.lit("scan-"), "id", F.lit("-é.nii")).alias("name"))
    ids = spark.range(0, 2000, 5).select(F.concat(F.lit("scan-"), "id", F.lit("-")).cast("binary").alias("_id"))
    assert 400 <= tables._likely_pieces(files, ids, "name", [7, 8, 9, 10]).count() < 420


def flat_tops(spark, folder):
    """Levels 31 and 32 lie around the middle of two places of the grid, so those are equally high; volume 2 has no such top."""
    rows = [(1, v) for v in [25.0, 25.5] * 5 + [5.0] * 2 + [45.0]] + [(2, v) for v in [25.0] * 6 + [5.0] * 3]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")


def as_the_twin(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    got, want = plans.QUERIES[name](spark, str(folder)), con.execute(plans.ORACLE_SQL[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_picked_peaks_with_flat_tops(spark, tmp_path):
    flat_tops(spark, tmp_path)
    as_the_twin(spark, tmp_path, "peak_pick")


def test_peaks_with_flat_tops(spark, tmp_path):
    flat_tops(spark, tmp_path)
    as_the_twin(spark, tmp_path, "peaks")
    y = np.array([0.0, 1.0, 3.0, 3.0, 1.0, 2.0, 0.0])
    assert [p[0] for p in stats._peaks_of(y, 0.1)] == [2, 5] and [p[0] for p in stats._peaks_of(y, 0.1, flat=False)] == [5]


def test_means_halfway_between_two_roundings(spark, tmp_path):
    """Means of 1 and 6 are 0.0494375; binary sums of one fall short, of the other go beyond. 3 has no number, 4 no value, 5 one beyond the decimals."""
    rows = [(1, v) for v in [0.09] * 351 + [0.0] * 288 + [0.05]] + [(6, v) for v in [0.05] * 632 + [0.0] * 7 + [0.04]]
    rows += [(2, 0.05), (3, float("nan")), (3, 0.01), (4, None), (5, -1e12)]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_suppkey: (r.mean, r.rank) for r in plans.QUERIES["rank_rois"](spark, str(tmp_path)).collect()}
    assert math.isnan(got.pop(3)[0])
    assert got == {2: (0.05, 2), 1: (0.049437, 3), 6: (0.049437, 3), 5: (-1e12, 4), 4: (None, 5)}
