"""Alerts and response actions.  Actions are rows; nothing is enforced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.functions.columns import iso_utc
from tidewatch.operators.cooldown import alert_cooldown

ALERT_INPUT = ["id", "ts", "severity", "threat_score", "src_ip", "dst_ip", "event_type",
               "message", "anomaly_score", "confidence", "factors"]


def response_gate(scored: DataFrame) -> DataFrame:
    return scored.filter(~F.col("severity").isin("NORMAL", "SUPPRESSED"))


def alert_id() -> Column:
    """Content hash: the same log gives the same alert id in batch, stream and replay."""
    return F.sha2(F.concat_ws(
        "|", F.col("id").cast("string"), F.coalesce("src_ip", F.lit("unknown")),
        F.unix_micros("ts").cast("string"), F.col("severity")), 256)


def response_actions() -> Column:
    """Array of (type, description, target) for the row's severity."""
    addresses = {name: F.coalesce(F.col(name), F.lit("unknown")) for name in ("src_ip", "dst_ip")}

    def step(kind: str, text: str, address: str | None, target: str | None) -> Column:
        description = F.concat(F.lit(text), addresses[address]) if address else F.lit(text)
        return F.struct(
            F.lit(kind).alias("type"), description.alias("description"),
            (F.lit(target) if target else addresses[address]).alias("target"))

    kind = "array<struct<type:string,description:string,target:string>>"
    chosen = F.array().cast(kind)
    for severity, steps in K.RESPONSE_PLAYBOOK.items():
        chosen = F.when(F.col("severity") == severity,
                        F.array(*[step(*s) for s in steps]).cast(kind)).otherwise(chosen)
    return chosen


def create_alerts(passed: DataFrame) -> DataFrame:
    """Twelve-field alerts, plus ``log_id`` and ``ts`` of the log they come from."""
    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    return passed.select(
        alert_id().alias("id"), iso_utc(F.col("ts")).alias("timestamp"),
        "severity", "threat_score", text("src_ip", "unknown"), text("dst_ip", "unknown"),
        text("event_type", "unknown"), text("message", ""),
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "factors", response_actions().alias("actions"),
        F.col("id").alias("log_id"), "ts")


def respond(scored: DataFrame, blocks: int | None = None) -> DataFrame:
    """Alerts of all scored rows that pass the gate and the cooldown."""
    return create_alerts(alert_cooldown(response_gate(scored), blocks))


def action_rows(alerts: DataFrame) -> DataFrame:
    """Audit rows: one per action."""
    return alerts.select(
        "timestamp", F.col("id").alias("alert_id"), "severity", "ts", "log_id",
        F.posexplode("actions").alias("position", "action"),
    ).select("timestamp", "alert_id", F.col("action.type").alias("action"),
             F.col("action.target").alias("target"), "severity",
             F.col("action.description").alias("description"), "position", "ts", "log_id")


def newest(rows: DataFrame, n: int, *tie: str) -> DataFrame:
    """Last ``n`` rows, newest first."""
    keys = [F.col(c).desc() for c in ("ts", *tie)]
    return rows.orderBy(*keys).limit(n)


def alert_retention(alerts: DataFrame, keep: int = K.MAX_ALERTS_KEPT) -> DataFrame:
    return newest(alerts, keep, "log_id")


def recent_alerts(alerts: DataFrame, limit: int = K.DEFAULT_ALERT_PAGE) -> DataFrame:
    if not 1 <= limit <= K.MAX_ALERTS_KEPT:
        raise ValueError(f"limit must be between 1 and {K.MAX_ALERTS_KEPT}")
    return newest(alerts, limit, "log_id")


def _actions_taken(per_severity: Column) -> list[Column]:
    """Action counts follow from alert counts: each severity has a fixed playbook."""
    severities: dict[str, list[str]] = {}
    for severity, steps in K.RESPONSE_PLAYBOOK.items():
        for kind, *_ in steps:
            severities.setdefault(kind, []).append(severity)

    def total(names: list[str]) -> Column:
        return F.aggregate(
            per_severity, F.lit(0).cast("long"),
            lambda so_far, s: so_far + F.when(s["severity"].isin(names), s["n"]).otherwise(0))

    return [F.struct(F.lit("actions_taken").alias("metric"), F.lit(kind).alias("key"),
                     total(names).alias("value")) for kind, names in severities.items()]


def response_stats(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counters in long form: metric, key, value.  Alerts are aggregated once."""
    sent = (alerts.groupBy("severity").agg(F.count("*").alias("n"))
                  .agg(F.collect_list(F.struct("severity", "n")).alias("by"),
                       F.coalesce(F.sum("n"), F.lit(0)).alias("sent")))
    due = response_gate(scored).agg(F.count("*").alias("due"))
    by = F.col("by")

    def single(metric: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.lit("all").alias("key"),
                        value.cast("long").alias("value"))

    rows = F.concat(
        F.array(single("total_alerts", F.col("sent")),
                single("suppressed_by_cooldown", F.col("due") - F.col("sent"))),
        F.transform(by, lambda s: F.struct(
            F.lit("by_severity").alias("metric"), s["severity"].alias("key"), s["n"].alias("value"))),
        F.filter(F.array(*_actions_taken(by)), lambda a: a["value"] > 0))
    # both sides are one aggregate row
    return sent.crossJoin(due).select(F.inline(rows))
