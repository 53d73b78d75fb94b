"""The given tables seen as imaging tables, and the same views as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.operators.geometry import pixels


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def slices(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 slices: a label is a volume, a vector a slice."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("long").alias("volume_id"), F.col("vec_id").alias("z"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").cast("array<double>").alias("px"))


def pixel_rows(spark: SparkSession, d: str) -> DataFrame:
    return pixels(slices(spark, d))


def dense_slices(spark: SparkSession, d: str) -> DataFrame:
    """The same with volumes of consecutive slices: a volume is vec_id div 16, z counts from 0."""
    return slices(spark, d).select(F.expr("z div 16").alias("volume_id"), (F.col("z") % 16).alias("z"), "height", "width", "px")


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cases with ids of both grammars, slice names and paths."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    body = F.element_at(F.array(*map(F.lit, ("AB", "HN", "TH", "B", "P"))), (k % 5 + 1).cast("int"))
    center = F.substring(F.lit("ABC"), 1, 3)
    letter = F.substr(center, (F.col("c_nationkey") % 3 + 1).cast("int"), F.lit(1))
    case = F.concat(body, F.lit("_1"), body, letter, F.lpad((k % 1000).cast("string"), 3, "0"))
    return c.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", case.alias("case_id"), F.concat(case, F.lit("-"), (k % 40).cast("string"), F.lit(".nii")).alias("slice_name"))


def roi(spark: SparkSession, d: str, status: str) -> DataFrame:
    """Line items as doses in regions of interest (suppliers), real under F, synthetic under O."""
    return table(spark, d, "lineitem").filter(F.col("l_linestatus") == status).select(F.col("l_suppkey").alias("name"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("dose"))


CASES = """cases AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, case_id, case_id || '-' || (c_custkey % 40) || '.nii' AS slice_name FROM (
 SELECT *, body || '_1' || body || substr('ABC', CAST(c_nationkey % 3 + 1 AS INT), 1) || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS case_id
 FROM (SELECT *, ['AB', 'HN', 'TH', 'B', 'P'][CAST(c_custkey % 5 + 1 AS INT)] AS body FROM customer)))"""

PX = """px AS (SELECT CAST(label AS BIGINT) AS volume_id, vec_id AS z, CAST((i - 1) // 8 AS BIGINT) AS y, CAST((i - 1) % 8 AS BIGINT) AS x, CAST(embedding[CAST(i AS INT)] AS DOUBLE) AS v
 FROM embeddings, range(1, 65) r(i))"""

DENSE = f"""{PX}, dpx AS (SELECT z // 16 AS volume_id, z % 16 AS z, y, x, v FROM px)"""

ROI = "roi AS (SELECT l_linestatus AS status, l_suppkey AS name, l_returnflag AS flag, l_quantity AS dose FROM lineitem)"
