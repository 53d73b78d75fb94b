"""Growing logs and metric files as streams. State is one row an epoch or a volume; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.operators.metrics import volume_metrics
from pairvox.sources.tables import parse_loss_lines


def loss_per_epoch(lines: DataFrame, losses: list[str]) -> DataFrame:
    """(epoch, mean of each loss), of a batch or a stream of log lines."""
    return parse_loss_lines(lines, losses).groupBy("epoch").agg(*(F.avg(n).alias(n) for n in losses))


def loss_stream(spark: SparkSession, path: str, losses: list[str]) -> DataFrame:
    return loss_per_epoch(spark.readStream.text(path), losses)


def volume_metrics_stream(spark: SparkSession, path: str, schema: str, **columns) -> DataFrame:
    """Volume metrics of CSV slice metrics as files arrive; columns as for `volume_metrics`."""
    return volume_metrics(spark.readStream.schema(schema).option("header", True).csv(path), **columns)


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Brings a table at `path` up to what the stream's source holds now, and returns. `stream` is an aggregate, whose changed rows each batch writes.

    Rows go into a folder of their batch's number, which is replaced as a whole: a batch that runs again after a failure
    writes what it wrote before. State and progress are in `checkpoint`, so another run, of another session too, goes on
    where this one ended. `latest` reads the table; nothing passes through the driver.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key in a table of `keep_latest`. The batch's number is compared, so rows that were written twice count once."""
    rows = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_last"))
    return last.select(*keys, "_last.*")


def compact(spark: SparkSession, path: str, keys: list[str], to: str) -> None:
    """The last rows alone, as a table at `to` that `latest` reads alike."""
    latest(spark, path, keys).write.mode("overwrite").parquet(f"{to}/batch=-1")
