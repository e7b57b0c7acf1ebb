"""Derived log columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import columns as C


def with_event_time(df: DataFrame, ingest_ts: Column | None = None,
                    source: str = "timestamp") -> DataFrame:
    """Add ``ts``.  ``ingest_ts`` replaces unreadable timestamps and defaults to query time."""
    if ingest_ts is None:
        ingest_ts = F.current_timestamp()
    return C.compute_once(df, {"ts": C.parse_timestamp(F.col(source), ingest_ts)})


def enrich_logs(df: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Add event time, calendar, code and direction columns; other columns are kept."""
    df = with_event_time(df, ingest_ts)
    ts = F.col("ts")
    return df.withColumns({
        "timestamp_utc": C.iso_utc(ts),
        "hour_of_day": C.hour_of_day(ts),
        "is_weekend": C.is_weekend(ts),
        "protocol_code": C.protocol_code(F.col("protocol")),
        "event_type_code": C.event_type_code(F.col("event_type")),
        "log_level_code": C.log_level_code(F.col("log_level")),
        "traffic_direction": C.traffic_direction(F.col("src_ip"), F.col("dst_ip")),
    })
