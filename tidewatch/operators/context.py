"""Context rules: which anomalies are expected, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.functions import columns as C
from tidewatch.operators.whitelist import with_listed


def _hour() -> Column:
    return F.coalesce(F.col("hour_of_day"), F.lit(12))


def _confidence() -> Column:
    return F.coalesce(F.col("confidence"), F.lit(0.0))


def _address(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def maintenance_flag() -> Column:
    low, high = K.MAINTENANCE_HOURS
    return (_hour() >= low) & (_hour() < high)


def maintenance_suppresses() -> Column:
    return maintenance_flag() & (_confidence() < K.MAINTENANCE_CONFIDENCE)


def backup_flag() -> Column:
    return C.has_prefix(_address("dst_ip"), K.BACKUP_PREFIXES)


def backup_suppresses() -> Column:
    event = F.coalesce(F.col("event_type"), F.lit(""))
    return (backup_flag() & (F.coalesce(F.col("bytes_sent"), F.lit(0)) > K.BACKUP_MIN_BYTES)
            & ~event.isin(K.BACKUP_EXCLUDED_EVENTS))


def whitelist_flag() -> Column:
    return (_address("src_ip").isin(K.WHITELISTED_IPS)
            | _address("dst_ip").isin(K.WHITELISTED_IPS))


def whitelist_suppresses(listed: Column | None = None) -> Column:
    return (whitelist_flag() if listed is None else listed) & (_confidence() < K.WHITELIST_CONFIDENCE)


def peak_flag() -> Column:
    low, high = K.PEAK_HOURS
    return (_hour() >= low) & (_hour() < high)


def internal_suppresses() -> Column:
    return ((F.coalesce(F.col("traffic_direction"), F.lit("")) == "internal")
            & (_confidence() < K.INTERNAL_CONFIDENCE))


def _anomalous() -> Column:
    return F.coalesce(F.col("is_anomaly"), F.lit(False))


def evaluate_context(df: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """Add ``suppress``, ``context_reason``, ``adjusted_score``, ``context_flags``,
    ``rule_hits`` (suppressing rules matched) and ``peak_adjusted``.

    A table ``whitelist`` with a column ``entry`` (addresses, dotted prefixes,
    subnets) takes the place of the fixed list of trusted addresses.
    """
    on = _anomalous()
    if whitelist is not None:
        df = with_listed(df, whitelist)
    listed = whitelist_flag() if whitelist is None else F.col("_listed")
    hits = {
        "_maintenance": on & maintenance_suppresses(),
        "_backup": on & backup_suppresses(),
        "_whitelist": on & whitelist_suppresses(listed),
        "_internal": on & internal_suppresses(),
        "_peak": on & peak_flag(),
    }
    df = df.withColumns(hits)
    m, b, w, i, peak = (F.col(c) for c in
                        ("_maintenance", "_backup", "_whitelist", "_internal", "_peak"))
    score = F.coalesce(F.col("anomaly_score"), F.lit(0.0))
    backup_text = F.concat(F.lit(K.REASON_BACKUP_BEFORE_IP), _address("dst_ip"),
                           F.lit(K.REASON_BACKUP_AFTER_IP))
    flags = F.array_compact(F.array(
        F.when(on & maintenance_flag(), F.lit("maintenance_window")),
        F.when(on & backup_flag(), F.lit("backup_traffic")),
        F.when(on & listed, F.lit("whitelisted_ip")),
        F.when(peak, F.lit("peak_hours")),
        F.when(i, F.lit("internal_traffic"))))
    # the last matching rule gives the reason
    reason = (F.when(~on, K.REASON_NOT_ANOMALY)
               .when(i, K.REASON_INTERNAL)
               .when(w, K.REASON_WHITELIST)
               .when(b, backup_text)
               .when(m, K.REASON_MAINTENANCE)
               .otherwise(K.REASON_CONFIRMED))
    adjusted = (F.when(~on, score)
                 .when(peak, F.round(score * F.lit(K.PEAK_SCORE_FACTOR), 4))
                 .otherwise(F.round(score, 4)))
    return df.withColumns({
        "suppress": m | b | w | i,
        "context_reason": reason,
        "adjusted_score": adjusted,
        "context_flags": flags,
        "rule_hits": m.cast("int") + b.cast("int") + w.cast("int") + i.cast("int"),
        "peak_adjusted": peak.cast("int"),
    }).drop(*hits, "_listed")


def suppression_stats(evaluated: DataFrame) -> DataFrame:
    """One row of counters.  ``suppressed`` counts rule hits, ``suppressed_rows`` logs."""
    stats = evaluated.agg(
        F.count("*").alias("total_evaluated"),
        F.coalesce(F.sum("rule_hits"), F.lit(0)).alias("suppressed"),
        F.coalesce(F.sum(F.col("suppress").cast("int")), F.lit(0)).alias("suppressed_rows"),
        F.coalesce(F.sum("peak_adjusted"), F.lit(0)).alias("adjusted"))
    rate = F.col("suppressed") / F.greatest(F.col("total_evaluated"), F.lit(1)) * 100
    return stats.withColumn("suppression_rate", F.round(rate, 2))
