"""Latency of a running flow, from what its micro-batches report."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidewatch.plans.reports import distribution_summary

PROGRESS = ("query_id string, run_id string, batch_id long, at string, input_rows long, batch_ms long, add_batch_ms long, "
            "watermark string")


class ProgressTable(StreamingQueryListener):
    """Appends a row per micro-batch of this session's streams to a table.

    Add it with ``spark.streams.addListener``.  ``wait`` blocks until all that
    an ended query reported is in the table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._ended: dict[str, threading.Event] = {}

    def _event(self, run_id: str) -> threading.Event:
        return self._ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._event(str(event.runId))

    def onQueryProgress(self, event) -> None:
        told = event.progress
        row = (str(told.id), str(told.runId), told.batchId, told.timestamp, told.numInputRows, told.batchDuration,
               told.durationMs.get("addBatch"), dict(told.eventTime).get("watermark"))
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._event(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 120) -> bool:
        return self._event(str(query.runId)).wait(seconds)


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch that took rows; a batch that was repeated after a failure counts once, as last reported."""
    rows = spark.read.schema(PROGRESS).parquet(path).filter("input_rows > 0")
    last = rows.groupBy("query_id", "batch_id").agg(F.max_by(F.struct(*rows.columns), "at").alias("row"))
    return last.select("row.*")


def latency(progress: DataFrame, bins: int = 60) -> tuple[DataFrame, DataFrame]:
    """Mean and 95th percentile of the batch duration in milliseconds, and its histogram."""
    return distribution_summary(progress, "batch_ms", bins)
