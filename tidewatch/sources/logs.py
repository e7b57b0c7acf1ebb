"""JSON log sources, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.sources.schemas import LOG_SCHEMA


def read_log_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the declared schema; unknown keys are ignored."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").json(path)


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines in column ``value``, for validation by reason."""
    return spark.read.text(path)


def stream_log_text(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def log_from_json(raw: Column) -> Column:
    """Typed log struct of one JSON text column."""
    return F.from_json(raw, LOG_SCHEMA, {"mode": "PERMISSIVE"})
