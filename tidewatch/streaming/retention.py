"""Keeping the newest alerts of a running flow.

The alerts that are kept are a table of versions.  A version is made from the
one before and the alerts of the batches committed since, so the work of a
step does not grow with the history; it counts once its row in the log is
written.  Repeating a batch or a step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import constants as K
from tidewatch.operators.response import alert_retention
from tidewatch.sources.datasets import path_exists
from tidewatch.sources.sinks import COMMITS, committed, read_committed

NONE = -1


def _version(spark: SparkSession, root: str) -> int:
    """Last batch that the current version holds."""
    log = f"{root}/kept_log"
    if not path_exists(spark, log):
        return NONE
    return spark.read.parquet(log).agg(F.coalesce(F.max("upto"), F.lit(NONE))).first()[0]


def retain_alerts(spark: SparkSession, root: str, keep: int = K.MAX_ALERTS_KEPT) -> int:
    """Take the batches committed since the current version into the next one; returns its last batch."""
    version = _version(spark, root)
    upto = committed(spark, root).agg(F.coalesce(F.max("batch_id"), F.lit(NONE))).first()[0]
    if upto <= version:
        return version
    rows = read_committed(spark, root, "alerts").filter(F.col("batch_id").between(version + 1, upto)).drop("batch_id")
    if version != NONE:
        rows = rows.unionByName(spark.read.parquet(f"{root}/kept/upto={version}"))
    alert_retention(rows, keep).write.mode("overwrite").parquet(f"{root}/kept/upto={upto}")
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(f"{root}/kept_log")
    return upto


def kept_alerts(spark: SparkSession, root: str) -> DataFrame:
    """The alerts of the current version."""
    return spark.read.parquet(f"{root}/kept/upto={_version(spark, root)}")


def start_retention(spark: SparkSession, root: str, checkpoint: str, keep: int = K.MAX_ALERTS_KEPT,
                    available_now: bool = True) -> StreamingQuery:
    """Follow the commits of a flow; every batch of them makes one version."""
    commits = spark.readStream.schema(COMMITS).parquet(f"{root}/commits/*")
    writer = commits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: retain_alerts(batch.sparkSession, root, keep))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
