"""Tables behind the evaluation figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.operators.metrics import confusion_matrix, report_metrics
from tidewatch.operators.quantiles import FINISH_ROWS, exact_percentiles


def ground_truth(logs: DataFrame) -> DataFrame:
    """Add ``is_actual_attack`` from the event type."""
    event = F.coalesce(F.col("event_type"), F.lit(""))
    return logs.withColumn("is_actual_attack", event.isin(K.ATTACK_TYPES))


def detection_confusion(logs: DataFrame) -> DataFrame:
    marked = ground_truth(logs).select(
        F.col("is_actual_attack").cast("int").alias("y_true"),
        F.coalesce("is_anomaly", F.lit(False)).cast("int").alias("y_pred"))
    return report_metrics(confusion_matrix(marked))


def histogram(df: DataFrame, column: str, bins: int, *by: str) -> DataFrame:
    """Equal-width bins over each group's own range; the maximum falls in the last bin.

    Empty bins are listed with 0.
    """
    values = df.select(*by, F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ranges = values.groupBy(*by).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    # a single value gets the range value - 0.5 .. value + 0.5
    flat = F.col("low") == F.col("high")
    ranges = ranges.withColumns({
        "low": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")),
        "high": F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))})
    width = (F.col("high") - F.col("low")) / bins
    if by:
        placed = values.join(ranges, list(by))
    else:
        low, high = ranges.select("low", "high").first()  # one row
        placed = values.withColumns({"low": F.lit(low).cast("double"), "high": F.lit(high).cast("double")})
    place = F.floor((F.col("_v") - F.col("low")) / width)
    counts = placed.groupBy(*by, F.least(place, F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")))
    return grid.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.col("low") + F.col("bin") * width).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"))


def score_histogram(logs: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(ground_truth(logs), "anomaly_score", bins, "is_actual_attack")


def _listed(df: DataFrame, column: str, values: list[str], stats: list[Column]) -> DataFrame:
    """Aggregates for every listed value, present or not, with its place in the list."""
    found = df.groupBy(column).agg(*stats)
    wanted = df.sparkSession.createDataFrame(list(enumerate(values)), f"place int, {column} string")
    return wanted.join(found, column, "left")


def detection_rate(logs: DataFrame) -> DataFrame:
    """Detected share per attack type; listed types always appear."""
    stats = [F.count("*").alias("n"), F.count_if(F.coalesce("is_anomaly", F.lit(False))).alias("hit")]
    out = _listed(logs, "event_type", K.ATTACK_TYPES, stats)
    total, hit = F.coalesce("n", F.lit(0)), F.coalesce("hit", F.lit(0))
    return out.select("place", "event_type", total.alias("total"), hit.alias("detected"),
                      F.round(hit / F.greatest(total, F.lit(1)) * 100, 4).alias("rate"))


def severity_distribution(scored: DataFrame) -> DataFrame:
    """Counts in fixed order, zero-filled."""
    out = _listed(scored, "severity", K.SEVERITY_ORDER, [F.count("*").alias("n")])
    return out.select("place", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def distribution_summary(df: DataFrame, column: str, bins: int = 60,
                         finish_rows: int = FINISH_ROWS) -> tuple[DataFrame, DataFrame]:
    """(mean and P95, histogram) of a numeric column."""
    values = df.select(F.lit(column).alias("key"), F.col(column).cast("double").alias("value")).filter(
        F.col("value").isNotNull())
    found = exact_percentiles(values, [0.95], finish_rows).collect()  # one row
    p95 = F.lit(found[0]["value"] if found else None).cast("double").alias("p95")
    return values.agg(F.avg("value").alias("mean")).select("mean", p95), histogram(df, column, bins)


def fp_reduction(evaluated: DataFrame) -> DataFrame:
    """False positives before and after context suppression."""
    false_hit = ~F.col("is_actual_attack") & F.coalesce("is_anomaly", F.lit(False))
    before = F.count_if(false_hit)
    after = F.count_if(false_hit & ~F.col("suppress"))
    reduction = (before - after) / F.greatest(before, F.lit(1)) * 100
    return ground_truth(evaluated).agg(
        before.alias("fp_before"), after.alias("fp_after"), F.round(reduction, 4).alias("reduction_pct"))


def score_vs_confidence(scored: DataFrame) -> DataFrame:
    """Predicted anomalies with their class."""
    return ground_truth(scored).filter(F.col("is_anomaly")).select(
        "id", "confidence", "threat_score",
        F.when(F.col("is_actual_attack"), "True Attack").otherwise("False Positive").alias("class"))
