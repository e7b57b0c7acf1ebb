"""Output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators.response import action_rows

COMMITS = "batch_id long, sinks array<string>"


def write_action_log(alerts: DataFrame, path: str, run: str) -> None:
    """Write one audit row per action, by run and day; writing a run again replaces it."""
    (action_rows(alerts).withColumn("dt", F.to_date("ts"))
        .select("timestamp", "alert_id", "action", "target", "severity", "dt")
        .write.mode("overwrite").partitionBy("dt").parquet(f"{path}/run={run}"))


def overwrite_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder, so a replay replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def commit_batch(spark: SparkSession, root: str, batch_id: int, sinks: list[str]) -> None:
    """Tell that a batch is written to all its sinks: one row in one file, written last."""
    row = spark.createDataFrame([(batch_id, sinks)], COMMITS).coalesce(1)
    row.write.mode("overwrite").parquet(f"{root}/commits/committed={batch_id}")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """The batches that are written to all their sinks."""
    return spark.read.schema(COMMITS).parquet(f"{root}/commits")


def read_committed(spark: SparkSession, root: str, sink: str) -> DataFrame:
    """Rows of a sink, with ``batch_id``, of whole batches only.

    A batch that failed between two of its sinks is not seen in any of them
    until it has been repeated.
    """
    whole = committed(spark, root).filter(F.array_contains("sinks", sink)).select("batch_id")
    rows = spark.read.parquet(f"{root}/{sink}")
    return rows.withColumn("batch_id", F.col("batch_id").cast("long")).join(whole, "batch_id", "left_semi")
