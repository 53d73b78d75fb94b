"""Operator 1: shards that all hold the corpus mixture, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairvox.llm.common import table


def interleave_shards(
    docs: DataFrame, *, n_shards: int = 16, key: str = "doc_id", stratum: str = "source", seed: int = 17, rows_per_bucket: int = 50_000
) -> DataFrame:
    """(key, stratum, stratum_rank, stratum_rows, position, shard, slot) for every row of docs.

    Rows are shuffled by a seeded hash (MD5) of the key and ranked within their stratum; a row's fractional rank
    (rank - 1/2) / stratum rows is its place in the whole, and the order by fractional rank is cut into n_shards
    runs whose sizes differ by one at most. So every shard holds each stratum in proportion.

    Both ranks are exact and need no task that sees a whole stratum: rows are ranked inside small hash buckets, and a
    bucket's offset comes from bucket counts. The counts for the second order follow from the stratum sizes alone.

    A null stratum counts as the empty one; a null key is shuffled like any other. Rows with equal keys, and equal rows,
    get places of their own; ties of the fractional rank go by stratum. Texts are only measured, at any length. Other
    columns don't come along, so theirs can't clash. No rows give no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), *_carried(docs))
    rows = rows.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_key").cast("string"))))
    total = docs.count()
    buckets = max(1, -(-total // rows_per_bucket))
    lead = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")  # buckets are ranges of the hash
    bucket = F.shiftright(lead * buckets, 32).alias("_bucket")

    counts = rows.groupBy("_stratum", bucket).count()
    by_stratum = Window.partitionBy("_stratum")
    offsets = counts.select(
        "_stratum",
        "_bucket",
        (F.sum("count").over(by_stratum.orderBy("_bucket")) - F.col("count")).alias("_before"),
        F.sum("count").over(by_stratum).alias("_rows"),
    )
    first = Window.partitionBy("_stratum", "_bucket").orderBy("_hash", "_key", "_size", "_crc")
    ranked = (
        rows.withColumn("_bucket", bucket)
        .withColumn("_in", F.row_number().over(first))
        .join(offsets, ["_stratum", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
    )
    # Bucket b of the second order holds the ranks k with floor(buckets * (2k - 1) / (2 rows)) = b. A stratum with more rows
    # than buckets says how many ranks each bucket has, a smaller one where each of its ranks goes: never more rows than docs.
    below = lambda b: F.expr(f"(2 * _rows * ({b}) + {buckets - 1}) div {2 * buckets}")
    of_rank = F.expr(f"({buckets} * (2 * _k - 1)) div (2 * _rows)")
    strata = counts.groupBy("_stratum").agg(F.sum("count").alias("_rows")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.least("_rows", F.lit(buckets))).cast("array<long>")))
    large = F.col("_rows") > buckets
    sizes = strata.select(
        F.when(large, F.col("_k") - 1).otherwise(of_rank).alias("_place"), F.when(large, below("_k") - below("_k - 1")).otherwise(F.lit(1).cast("long")).alias("_n")
    ).groupBy("_place").agg(F.sum("_n").alias("_n"))
    starts = sizes.select("_place", (F.sum("_n").over(Window.orderBy("_place")) - F.col("_n")).alias("_start"))
    ranked = ranked.withColumn("_place", F.expr(f"({buckets} * (2 * _rank - 1)) div (2 * _rows)"))
    second = Window.partitionBy("_place").orderBy(F.expr("(2 * _rank - 1) / _rows"), "_stratum", "_key", "_rank")
    placed = (
        ranked.withColumn("_at", F.row_number().over(second) - 1)
        .join(starts, "_place")
        .withColumn("position", F.col("_start") + F.col("_at"))
        .withColumn("shard", F.expr(f"(position * {n_shards}) div {max(total, 1)}").cast("int"))
    )
    begin = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return placed.select(
        F.col("_key").alias(key), F.col("_stratum").alias("stratum"), F.col("_rank").alias("stratum_rank"), F.col("_rows").alias("stratum_rows"),
        "position", "shard", (F.col("position") - begin).alias("slot"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
    )


def _carried(docs: DataFrame, text: str = "text") -> list:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return [(F.octet_length(body).cast("long") + 1).alias("_size"), F.crc32(body).alias("_crc")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = interleave_shards(table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "stratum", "stratum_rank"
    )


#: CRC-32 by its table, made from the rule; the list of bytes comes from the text's hexadecimal form.
ORACLE_SQL = """
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS own FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(source, '') AS stratum, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, stratum, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, own[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::BIGINT) AS text_crc32 FROM d, t),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR))), doc_id, size, text_crc32) AS stratum_rank, count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER () AS total FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * stratum_rank - 1 AS DOUBLE) / n, stratum, doc_id, stratum_rank) - 1 AS position FROM k),
s AS (SELECT *, CAST(position * 16 // total AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(position - (shard * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, stratum, CAST(stratum_rank AS BIGINT) AS stratum_rank FROM s
"""
