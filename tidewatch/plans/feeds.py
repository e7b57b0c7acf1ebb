"""Dashboard feeds and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.operators.response import newest

_NO_VALUE = "—"


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)).alias(name)


def log_payload(scored: DataFrame) -> DataFrame:
    """Ten-field feed row (plus ``ts`` for ordering)."""
    stamp = F.col("timestamp_utc")
    if "timestamp" in scored.columns:
        stamp = F.coalesce(stamp, F.col("timestamp"))
    return scored.select(
        _text("id"), F.coalesce(stamp, F.lit("")).alias("timestamp"),
        _text("src_ip"), _text("dst_ip"), _text("event_type"), _text("log_level"), _text("message"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        _text("severity", "NORMAL"), F.coalesce("threat_score", F.lit(0)).alias("threat_score"), "ts")


def recent_logs(parsed: DataFrame, keep: int = K.MAX_LOGS_KEPT) -> DataFrame:
    return newest(parsed, keep, "id")


def _clock(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm:ss"), F.lit(_NO_VALUE))


def _shown(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(_NO_VALUE)).alias(name)


def log_feed(scored: DataFrame, rows: int = K.LOG_FEED_ROWS) -> DataFrame:
    return newest(scored, rows, "id").select(
        "id", _clock(F.col("ts")).alias("time"), _shown("src_ip"), _shown("event_type"),
        _text("message"), F.coalesce("is_anomaly", F.lit(False)).alias("highlight"),
        _text("severity", "NORMAL"))


def alert_feed(alerts: DataFrame, rows: int = K.ALERT_FEED_ROWS) -> DataFrame:
    return newest(alerts, rows, "log_id").select(
        F.col("id").alias("alert_id"), "severity",
        F.concat(F.lit("Score: "), F.col("threat_score").cast("string"), F.lit("/100")).alias("score"),
        F.concat("src_ip", F.lit(" → "), "dst_ip").alias("route"), "message",
        F.concat(_clock(F.col("ts")), F.lit(" · "),
                 F.coalesce("event_type", F.lit("unknown"))).alias("footer"))


def action_feed(actions: DataFrame, rows: int = K.ACTION_FEED_ROWS) -> DataFrame:
    return newest(actions, rows, "log_id", "position").select(
        "alert_id", "action", F.coalesce("description", "action").alias("description"), "severity")


def service_stats(evaluated: DataFrame, alerts: DataFrame, model_loaded: bool) -> DataFrame:
    """One row of counters; ``severity_counts`` holds only severities that occurred."""
    logs = evaluated.agg(F.count("*").alias("total_logs"),
                         F.coalesce(F.sum("rule_hits"), F.lit(0)).alias("suppressed_count"))
    sent = (alerts.groupBy("severity").agg(F.count("*").alias("n"))
                  .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n"))))
                        .alias("severity_counts"),
                       F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"),
                       F.coalesce(F.sum(F.when(F.col("severity").isin("HIGH", "CRITICAL"), F.col("n"))),
                                  F.lit(0)).alias("active_threats")))
    # both sides are one aggregate row
    return logs.crossJoin(sent).select(
        "total_logs", "total_alerts", "severity_counts", "active_threats", "suppressed_count",
        F.lit(model_loaded).alias("model_loaded"))


def stat_tiles(stats: DataFrame) -> DataFrame:
    """Eight tiles, missing severities as 0."""
    tiles = [("total_logs", F.col("total_logs")), ("total_alerts", F.col("total_alerts"))]
    tiles += [(s.lower(), F.coalesce(F.try_element_at("severity_counts", F.lit(s)), F.lit(0)))
              for s in K.SEVERITY_RANGES]
    tiles += [("active_threats", F.col("active_threats")), ("suppressed", F.col("suppressed_count"))]
    return stats.select(*[value.cast("long").alias(name) for name, value in tiles])
