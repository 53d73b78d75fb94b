"""Smallest labels over links, in checkpointed rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one for a local master, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def smallest_label(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (node, other) reach. Labels also jump to their own label, so rounds are few."""
    both = cut(links.select("node", "other").union(links.select("other", "node")).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("_near"))
        step = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("_near", "label")).alias("label"), F.col("label").alias("_old"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("_far"))
        new = cut(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("_far", "label")).alias("label"), "_old"))
        if not new.filter("label <> _old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
