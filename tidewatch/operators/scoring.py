"""Five-factor threat score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.functions import columns as C
from tidewatch.operators.correlation import correlate


def gate() -> Column:
    """SUPPRESSED, NORMAL, or null for a row that has to be scored."""
    return (F.when(F.coalesce(F.col("suppress"), F.lit(False)), "SUPPRESSED")
             .when(~F.coalesce(F.col("is_anomaly"), F.lit(False)), "NORMAL"))


def ml_points() -> Column:
    points = (F.coalesce(F.col("confidence"), F.lit(0.0)) * F.lit(35.0)).cast("int")
    return F.least(F.lit(35), points)


def _bytes() -> Column:
    return F.coalesce(F.col("bytes_sent"), F.lit(0))


def _duration() -> Column:
    return F.coalesce(F.col("duration"), F.lit(1.0))


def _suspicious_port() -> Column:
    return F.coalesce(F.col("dst_port"), F.lit(0)).isin(K.SUSPICIOUS_PORTS)


def feature_points() -> Column:
    volume = F.when(_bytes() > 100000, 8).when(_bytes() > 10000, 4).otherwise(0)
    port = F.when(_suspicious_port(), 7).otherwise(0)
    rapid = F.when(_duration() < 0.01, 5).otherwise(0)
    level = (F.when(F.col("log_level") == "CRITICAL", 5)
              .when(F.col("log_level") == "ERROR", 3).otherwise(0))
    return F.least(F.lit(25), volume + port + rapid + level)


def keyword_points() -> Column:
    return C.keyword_points(F.col("message"), K.SCORE_KEYWORD_CAP)


def attack_bonus() -> Column:
    return C.lookup(F.col("event_type"), K.ATTACK_BONUS, 0)


def with_static_points(df: DataFrame) -> DataFrame:
    """The four factors that depend on the row alone."""
    return df.withColumns({
        "ml_points": ml_points(), "feature_points": feature_points(),
        "keyword_points": keyword_points(), "bonus_points": attack_bonus()})


def severity_of(score: Column) -> Column:
    level = F.lit("LOW")
    for name, (low, _) in K.SEVERITY_RANGES.items():
        level = F.when(score >= low, name).otherwise(level)
    return level


def _in_peak() -> Column:
    return F.coalesce(F.array_contains("context_flags", "peak_hours"), F.lit(False))


def total_points() -> Column:
    total = (F.col("ml_points") + F.col("feature_points") + F.col("keyword_points")
             + F.col("correlation_points") + F.col("bonus_points"))
    reduced = F.when(_in_peak(), (total * F.lit(K.PEAK_TOTAL_FACTOR)).cast("int")).otherwise(total)
    return F.least(F.greatest(reduced, F.lit(0)), F.lit(100)).cast("int")


def _factors(scored: Column) -> Column:
    """Nullable members: a factor that does not apply is null."""
    def only(condition: Column, value: Column) -> Column:
        return F.when(scored & condition, value)

    def kept(name: str) -> Column:
        return F.when(scored, F.col(name))

    return F.struct(
        F.when(F.col("severity") == "SUPPRESSED", F.col("context_reason")).alias("reason"),
        kept("ml_points").alias("ml_anomaly_base"),
        only(_bytes() > 100000, _bytes()).alias("high_bytes_sent"),
        only(_suspicious_port(), F.col("dst_port")).alias("suspicious_port"),
        only(_duration() < 0.01, _duration()).alias("rapid_connection"),
        kept("feature_points").alias("feature_modifiers"),
        kept("keyword_points").alias("keyword_risk"),
        kept("correlation_points").alias("event_correlation"),
        kept("repeat_count").alias("repeat_count"),
        kept("bonus_points").alias("attack_pattern_bonus"),
        only(_in_peak(), F.lit(True)).alias("peak_hours_reduction"))


def finish_live(correlated: DataFrame) -> DataFrame:
    """Score, severity and factors of correlated rows."""
    out = correlated.withColumn("threat_score", total_points())
    out = out.withColumn("severity", severity_of(F.col("threat_score")))
    return out.withColumn("factors", _factors(F.lit(True)))


def live_rows(evaluated: DataFrame) -> DataFrame:
    """Anomalous, unsuppressed rows with their static points."""
    return with_static_points(evaluated.filter(gate().isNull()))


def quiet_rows(evaluated: DataFrame) -> DataFrame:
    """Normal and suppressed rows: score 0."""
    quiet = evaluated.withColumn("severity", gate()).filter(F.col("severity").isNotNull())
    quiet = quiet.withColumns({
        "ml_points": F.lit(0), "feature_points": F.lit(0), "keyword_points": F.lit(0),
        "bonus_points": F.lit(0), "repeat_count": F.lit(0).cast("long"),
        "correlation_points": F.lit(0), "threat_score": F.lit(0)})
    return quiet.withColumn("factors", _factors(F.lit(False)))


def score_live(evaluated: DataFrame, blocks: int | None = None) -> DataFrame:
    """Scored rows only."""
    return finish_live(correlate(live_rows(evaluated), blocks))


def threat_score(evaluated: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every row with points, ``threat_score``, ``severity`` and ``factors``."""
    return score_live(evaluated, blocks).unionByName(quiet_rows(evaluated))
