"""Log processing from parsed rows to alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidewatch.operators.context import evaluate_context
from tidewatch.operators.cooldown import alert_cooldown
from tidewatch.operators.forest import Model
from tidewatch.operators.predict import predict_logs
from tidewatch.operators.response import ALERT_INPUT, alert_id, create_alerts, response_gate
from tidewatch.operators.scoring import finish_live, gate, live_rows, quiet_rows
from tidewatch.operators.correlation import correlate
from tidewatch.operators.blocks import BLOCK_COLUMNS, with_blocks
from tidewatch.session import stage


@dataclass(frozen=True)
class Detection:
    """Frames of one run.

    ``evaluated``: every log with anomaly and context columns.
    ``live``: scored logs (anomalous, unsuppressed).
    ``passed``: live rows that raised an alert.
    """
    evaluated: DataFrame
    live: DataFrame
    passed: DataFrame

    def alerts(self) -> DataFrame:
        return create_alerts(self.passed)

    def scored(self) -> DataFrame:
        """Every log with its score; quiet logs get 0."""
        return self.live.unionByName(quiet_rows(self.evaluated))


def detect(predicted: DataFrame, staged: bool = True, blocks: int | None = None) -> Detection:
    """Context, score and response over enriched logs that carry an anomaly result.

    The live rows, the small share the model flagged and no rule suppressed,
    are laid out in blocks once, for correlation and cooldown, and written
    again after correlation, so that the run, the cooldown and the alerts
    share one correlation.
    """
    evaluated = evaluate_context(predicted)
    live = finish_live(correlate(with_blocks(live_rows(evaluated), blocks), keep_blocks=True))
    if staged:
        live = stage(live, "scored-live")
    # only what an alert shows goes through the cooldown
    due = response_gate(live).select(*ALERT_INPUT, *BLOCK_COLUMNS)
    passed = alert_cooldown(due)
    return Detection(evaluated, live.drop(*BLOCK_COLUMNS), passed)


def predict_and_detect(enriched: DataFrame, model: Model | None, staged: bool = True,
                       blocks: int | None = None) -> Detection:
    """Full run with a fitted model.  Model scores are the costly part, so all
    evaluated rows are staged once and every later step reads that table."""
    predicted = predict_logs(enriched, model)
    if staged:
        predicted = stage(predicted, "predicted")
    return detect(predicted, staged, blocks)


def run_logs(run: Detection) -> DataFrame:
    """One row per valid log: is_anomaly, severity, threat_score, alert_id, suppressed.

    Alerts can only belong to live rows, so only those are joined, by the
    content hash that names an alert.  A missing or repeated log id therefore
    neither loses an alert nor adds rows; logs that are equal in all that the
    hash covers share their alert.
    """
    ids = run.passed.select(alert_id().alias("alert_id")).distinct()
    live = run.live.withColumn("_alert", alert_id())
    live = live.join(ids, live["_alert"] == ids["alert_id"], "left").select(
        "id", "is_anomaly", "severity", "threat_score", "alert_id",
        F.lit(False).alias("suppressed"))
    quiet = run.evaluated.filter(gate().isNotNull()).select(
        "id", "is_anomaly", gate().alias("severity"), F.lit(0).alias("threat_score"),
        F.lit(None).cast("string").alias("alert_id"), F.col("suppress").alias("suppressed"))
    return live.unionByName(quiet)


def ingest_response(submitted: DataFrame, processed: DataFrame, key: str = "id") -> DataFrame:
    """Reply per submitted log; an invalid one still gets ``ok`` and defaults."""
    return submitted.select(key).join(processed, key, "left").select(
        key, F.lit("ok").alias("status"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.coalesce("severity", F.lit("NORMAL")).alias("severity"),
        F.coalesce("threat_score", F.lit(0)).alias("threat_score"), "alert_id",
        F.coalesce("suppressed", F.lit(False)).alias("suppressed"))
