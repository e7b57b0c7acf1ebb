"""Anomaly result columns: is_anomaly, prediction, anomaly_score, confidence, error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.operators.features import feature_columns
from tidewatch.operators.forest import Model, decision, with_raw_score


def predicted_label(score: Column) -> Column:
    return F.when(score < 0, -1).otherwise(1)


def confidence(score: Column) -> Column:
    """0..1, from the unrounded score; 0 unless anomalous."""
    scaled = F.least(F.greatest(-score / F.lit(K.CONFIDENCE_SCALE), F.lit(0.0)), F.lit(1.0))
    return F.when(score < 0, scaled).otherwise(0.0)


def _result(df: DataFrame, score: Column, error: Column) -> DataFrame:
    failed = error.isNotNull()
    return df.withColumns({
        "is_anomaly": F.when(failed, False).otherwise(score < 0),
        "prediction": F.when(failed, 1).otherwise(predicted_label(score)),
        "anomaly_score": F.when(failed, 0.0).otherwise(F.round(score, 4)),
        "confidence": F.when(failed, 0.0).otherwise(F.round(confidence(score), 4)),
        "error": error})


def predict_from_score(df: DataFrame, score: str) -> DataFrame:
    """Result columns from a decision score; a null score is a failed extraction."""
    failed = F.when(F.col(score).isNull(), "Feature extraction failed")
    return _result(df, F.col(score), failed)


def predict_logs(df: DataFrame, model: Model | None) -> DataFrame:
    """Features, scaling, forest walk and result columns of enriched logs."""
    if model is None:
        return _result(df, F.lit(0.0), F.lit("Model not loaded"))
    raw = feature_columns(df, model.n_features)[:model.n_features]
    names = [f"_f{i}" for i in range(len(raw))]
    df = df.withColumns(dict(zip(names, raw)))
    complete = F.lit(True)
    for name in names:
        complete = complete & F.col(name).isNotNull()
    # the walk needs numbers everywhere; incomplete rows are discarded after it
    filled = [F.coalesce(F.col(n), F.lit(0.0)) for n in names]
    scored = with_raw_score(df.withColumn("_complete", complete), filled, model)
    scored = scored.withColumn(
        "_decision", F.when(F.col("_complete"), decision(F.col("raw_score"), model.offset)))
    return predict_from_score(scored, "_decision").drop(*names, "_complete", "_decision", "raw_score")


def fallback(df: DataFrame, model_loaded: bool, features: str = "features") -> DataFrame:
    """Result columns when no score can be given, and the reason."""
    error = (F.lit("Model not loaded") if not model_loaded
             else F.when(F.col(features).isNull(), "Feature extraction failed"))
    return _result(df, F.lit(0.0), error)
