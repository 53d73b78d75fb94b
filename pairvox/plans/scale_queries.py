"""Queries for what has to hold at any size: selection in large groups, interval joins, sinks, streams that go on, many runs, volumes as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairvox.operators import metrics
from pairvox.operators.intervals import interval_join
from pairvox.operators.quantiles import quantiles
from pairvox.plans.adapters import dense_slices, table
from pairvox.plans.queries import LAYOUT, LOSS, _cases_with_split, _folder, _log_lines, query
from pairvox.sources import nifti, tables
from pairvox.streaming import streams

QS = [0.0, 0.02, 0.5, 0.99, 1.0]
_QS_SQL = ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS q{round(100 * q)}" for q in QS)


def _columns():
    return [F.round(F.get("quantiles", F.lit(i)), 6).alias(f"q{round(100 * q)}") for i, q in enumerate(QS)]


@query(f"SELECT count(l_extendedprice) AS n, {_QS_SQL} FROM lineitem")
def quantiles_of_all(spark, d):
    """All line items as one group, by selection in ranges."""
    return quantiles(table(spark, d, "lineitem"), [], "l_extendedprice", QS, direct=1000, gather=50).select("n", *_columns())


@query(f"SELECT l_suppkey % 7 AS shelf, count(l_extendedprice) AS n, {_QS_SQL} FROM lineitem GROUP BY 1")
def quantiles_of_groups(spark, d):
    """Large groups by selection."""
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("shelf"), "l_extendedprice")
    return quantiles(rows, ["shelf"], "l_extendedprice", QS, direct=500, gather=100, parts=16).select("shelf", "n", *_columns())


@query("SELECT e.event_id, p.event_id AS purchase_id FROM events e JOIN events p ON p.event_type = 'purchase' AND p.user_id = e.user_id AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 36 HOUR")
def events_after_purchase(spark, d):
    """Events within 36 hours from a purchase of the same user."""
    events = table(spark, d, "events")
    spans = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("opened"), F.expr("ts + INTERVAL 36 HOURS").alias("closed"))
    return interval_join(events.select("event_id", "user_id", "ts"), spans, keys=["user_id"], at="ts", lo="opened", hi="closed", half_open=True).select("event_id", "purchase_id")


@query("""WITH b AS (SELECT l_returnflag, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1),
i AS (SELECT l_returnflag, 'cheap' AS band, NULL AS lo, low + 20000 AS hi FROM b UNION ALL SELECT l_returnflag, 'middle', low + 15000, low + 50000 FROM b UNION ALL SELECT l_returnflag, 'least', low, low FROM b UNION ALL SELECT l_returnflag, 'dear', high - 5000, NULL FROM b)
SELECT l_orderkey, l_linenumber, band FROM lineitem l LEFT JOIN i ON i.l_returnflag = l.l_returnflag AND (lo IS NULL OR l_extendedprice >= lo) AND (hi IS NULL OR l_extendedprice <= hi)""")
def price_bands(spark, d):
    """Line items in bands of prices of their flag: some overlap, some are open, one has one value; hot bins are split."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    ends = items.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    none = F.lit(None).cast("double")
    each = [("cheap", none, F.col("low") + 20000), ("middle", F.col("low") + 15000, F.col("low") + 50000), ("least", F.col("low"), F.col("low")), ("dear", F.col("high") - 5000, none)]
    bands = ends.select("l_returnflag", F.explode(F.array(*(F.struct(F.lit(n).alias("band"), a.alias("lo"), b.alias("hi")) for n, a, b in each))).alias("b")).select("l_returnflag", "b.*")
    return interval_join(items, bands, keys=["l_returnflag"], at="l_extendedprice", lo="lo", hi="hi", how="left", hot_points=500).select("l_orderkey", "l_linenumber", "band")


# Sinks that keep what they don't replace, streams that go on, and many runs at once


@query("SELECT event_type AS experiment, user_id, round(avg(value), 6) + CASE WHEN event_type = 'click' THEN 1000 ELSE 0 END AS mae FROM events GROUP BY 1, 2")
def rewritten_experiment(spark, d):
    """Volume metrics of all experiments, then one experiment written again: the others stay."""
    path = _folder(spark, "experiments")
    each = table(spark, d, "events").groupBy(F.col("event_type").alias("experiment"), "user_id").agg(F.round(F.avg("value"), 6).alias("mae"))
    tables.write_volume_metrics(each, path)
    tables.write_volume_metrics(each.filter("experiment = 'click'").withColumn("mae", F.col("mae") + 1000), path)
    return spark.read.parquet(path).select("experiment", "user_id", "mae")


@query(LAYOUT.replace("SELECT split,", "SELECT split_part(case_id, '_', 1) AS region, split,").replace("GROUP BY 1, 2", "WHERE NOT (split_part(case_id, '_', 1) = 'AB' AND split = 'val' AND c_acctbal <= 5000 AND c_acctbal > 0) GROUP BY 1, 2, 3"))
def rewritten_region(spark, d):
    """Slices by region, split and domain, then one folder written again with fewer rows: the region's other folders and the other regions stay."""
    path = _folder(spark, "regions")
    rows = _cases_with_split(spark, d)
    tables.write_region_layout(rows, path, name="slice_name")
    again = rows.join(table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey"), "c_custkey", "left_semi")
    tables.write_region_layout(again.filter("slice_name LIKE 'AB%' AND split = 'val'"), path, name="slice_name")
    return spark.read.parquet(path).groupBy("region", "split", "domain").agg(F.count("*").alias("files"))


@query(f"SELECT epoch, round(avg(value), 11) AS G_GAN FROM ({LOSS}) GROUP BY 1")
def restarted_loss_stream(spark, d):
    """The log arrives in two parts; the stream is stopped after the first and started again from its checkpoint. Equal to epoch_losses."""
    path = _folder(spark, "parts")
    lines = _log_lines(spark, d).withColumn("first", F.pmod(F.xxhash64("value"), F.lit(3)) == 0)
    for part in ("first", "NOT first"):
        lines.filter(part).select("value").write.mode("append").text(f"{path}/log")
        streams.keep_latest(streams.loss_stream(spark, f"{path}/log", ["G_GAN"]), f"{path}/table", f"{path}/state")
    streams.compact(spark, f"{path}/table", ["epoch"], f"{path}/compact")
    return streams.latest(spark, f"{path}/compact", ["epoch"]).select("epoch", F.round("G_GAN", 11).alias("G_GAN"))


@query("""WITH e AS (SELECT 'run-' || user_id % 4 AS run, event_id, user_id % 4 AS k, value, event_type FROM events)
SELECT run, 'row' AS kind, event_id, round(value, 6) AS mae, CASE WHEN k <> 1 THEN event_type END AS model, NULL AS why FROM e WHERE NOT (k = 2 AND event_type = 'error')
UNION ALL SELECT run, 'bad', NULL, NULL, NULL, 'mae' FROM e WHERE k = 2 AND event_type = 'error'""")
def many_runs(spark, d):
    """Metric files of four runs with other columns, orders and names each, and text among the numbers of one, read at once."""
    path = _folder(spark, "runs")
    rows = table(spark, d, "events").select((F.col("user_id") % 4).alias("k"), "event_id", F.col("value").alias("mae"), F.col("event_type").alias("model"), "props")
    columns = {0: ["event_id", "mae", "model"], 1: ["mae", "event_id"], 2: ["model", "event_id", "mae", "props"], 3: ["event_id", "model", "mae"]}
    for k, names in columns.items():
        own = rows.filter(F.col("k") == k)
        if k == 2:
            own = own.withColumn("mae", F.when(F.col("model") == "error", "n/a").otherwise(F.col("mae").cast("string")))
        own = own.select(*names) if k != 3 else own.select(*names).toDF("event_id", "name", "MAE")
        own.write.option("header", True).csv(f"{path}/run-{k}")
    lines = tables.parse_runs(spark, [f"{path}/run-{k}" for k in columns], "event_id long, mae double, model string", renamed={"MAE": "mae", "name": "model"})
    good = lambda c: F.when(F.col("why").isNull(), c)
    kind = F.when(F.col("why").isNull(), "row").otherwise("bad")
    return lines.select("run", kind.alias("kind"), good(F.col("event_id")).alias("event_id"), good(F.round("mae", 6)).alias("mae"), good(F.col("model")).alias("model"), "why")


# Volumes as files


def _stored_volumes(spark, d, **options) -> str:
    """Embeddings as volumes of 16 slices, written as files."""
    path = _folder(spark, "volumes")
    each = dense_slices(spark, d)
    nifti.write_volumes(each.select(F.concat(F.lit("v"), F.col("volume_id")).alias("volume_id"), "z", "height", "width", "px", F.lit(0.5).alias("sx"), F.lit(0.75).alias("sy"), F.lit(3.0).alias("sz")), path, **options)
    return path


@query("SELECT 'v' || vec_id // 16 AS volume_id, vec_id % 16 AS z, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, round(CAST(embedding[10] AS DOUBLE), 6) AS tenth, 0.75 AS sy FROM embeddings")
def stored_volumes(spark, d):
    """Volumes written as compressed files and read again, slice by slice."""
    path = _stored_volumes(spark, d, kind="f8")
    read = spark.read.format("nifti").load(path)
    total = F.aggregate("px", F.lit(0.0), lambda a, x: a + x)
    return read.select("volume_id", "z", F.round(total, 6).alias("total"), F.round(F.get("px", F.lit(9)), 6).alias("tenth"), "sy")


@query("SELECT 'v' || vec_id // 16 AS volume_id, vec_id % 16 AS z, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE ('v' || vec_id // 16) LIKE 'v1%' AND vec_id % 16 >= 3 AND vec_id % 16 < 12")
def some_stored_slices(spark, d):
    """Slices of some volumes from files that are not compressed: the source skips other files and seeks to the slices."""
    path = _stored_volumes(spark, d, kind="f8", compressed=False)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("nifti").option("pushdown", "true").load(path)
    return read.filter("volume_id LIKE 'v1%' AND z >= 3 AND z < 12").select("volume_id", "z", F.round(F.get("px", F.lit(0)), 6).alias("first"))


# Tables of metrics as text, boxes and epochs


@query("SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_discount = 0) AS removed, count(*) FILTER (l_discount IS DISTINCT FROM 0) AS kept FROM lineitem GROUP BY 1")
def zero_mask_dry_run(spark, d):
    return metrics.zero_mask_report(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount")


_TEXT = "CASE WHEN {0} IS NULL THEN 'n/a' ELSE printf('%.6g', {0}) END"


@query(f"SELECT p_brand, p_size, {_TEXT.format('avg(p_retailprice)')} || ' +- ' || {_TEXT.format('stddev_samp(p_retailprice)')} AS price, {_TEXT.format('avg(p_retailprice * 1e-8)')} || ' +- ' || {_TEXT.format('stddev_samp(p_retailprice * 1e-8)')} AS small FROM part GROUP BY 1, 2")
def mean_std_as_text(spark, d):
    """Groups of one row have no deviation."""
    rows = table(spark, d, "part").select("p_brand", "p_size", F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * 1e-8).alias("small"))
    return metrics.mean_std_text(rows, ["price", "small"], ["p_brand", "p_size"])


@query("""WITH c AS (SELECT quality AS l, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), r AS (SELECT l, sum(n) AS r, coalesce(sum(n) FILTER (l = p), 0) AS hit FROM c GROUP BY 1), k AS (SELECT p, sum(n) AS c FROM c GROUP BY 1)
SELECT count(*) AS classes, round(sum(hit) / sum(r), 9) AS pixel_accuracy, round(avg(hit / r), 9) AS mean_accuracy, round(avg(hit / (r + coalesce(c, 0) - hit + 1e-12)), 9) AS mean_iou FROM r LEFT JOIN k ON l = p""")
def seg_means(spark, d):
    cm = metrics.confusion_matrix(table(spark, d, "labels"), label="quality", pred="toxic", n=2)
    return metrics.segmentation_means(cm).withColumns({c: F.round(c, 9) for c in ("pixel_accuracy", "mean_accuracy", "mean_iou")})


@query("""WITH b AS (SELECT unnest([l_returnflag, 'Total']) AS facet, l_linestatus, l_extendedprice * (1 + l_quantity) AS v FROM lineitem), q AS (SELECT facet, l_linestatus, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1, 2)
SELECT facet, l_linestatus, count(*) AS n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 4) AS low, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 4) AS high, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
FROM b JOIN q USING (facet, l_linestatus) GROUP BY facet, l_linestatus, q1, median, q3""")
def box_whiskers(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") * (1 + F.col("l_quantity"))).alias("v"), F.lit("one run").alias("run"))
    out = metrics.box_whiskers(rows, facet="l_returnflag", group="l_linestatus", v="v", factors=["run"])
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "low", "high")})


@query("""WITH e AS (SELECT user_id, event_id % 12 AS epoch, value FROM events WHERE event_id % 13 > 0), s AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM e) ORDER BY md5('7:' || user_id), user_id LIMIT 20)
SELECT CAST(epoch AS INT) AS epoch, count(DISTINCT user_id) AS items, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std FROM e JOIN s USING (user_id) GROUP BY 1""")
def epochs_from_files(spark, d):
    """Metrics of the same twenty users in every epoch, which a file name gives; the latest checkpoint has no number."""
    k = F.col("event_id")
    file = F.when(k % 13 == 0, "runs/latest_net_G.pth").otherwise(F.concat(F.lit("runs/"), k % 12, F.lit("_net_G.pth")))
    out = metrics.epoch_subset_metrics(table(spark, d, "events").withColumn("file", file), file="file", item="user_id", metrics=["value"], n=20, seed=7)
    return out.withColumns({c: F.round(c, 6) for c in ("value_mean", "value_std")})


@query("SELECT DISTINCT o_orderkey, 'scan-' || o_orderkey || '-' || o_custkey || '.nii' AS name FROM orders WHERE o_orderkey % 3 < 2 AND EXISTS (SELECT 1 FROM orders p WHERE p.o_orderpriority = '1-URGENT' AND p.o_orderkey = orders.o_orderkey)")
def subset_by_many_ids(spark, d):
    """Files of the urgent orders, by thousands of ids in one pass over the names; a third has an unknown extension."""
    orders = table(spark, d, "orders")
    name = F.concat(F.lit("scan-"), "o_orderkey", F.lit("-"), "o_custkey", F.when(F.col("o_orderkey") % 3 < 2, ".nii").otherwise(".txt"))
    ids = orders.filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("scan-"), "o_orderkey", F.lit("-")).alias("id"))
    return tables.copy_subset(orders.select("o_orderkey", name.alias("name")), ids, name="name", id_="id", extensions=[".nii"], few=100)
