"""Training and evaluation on the unified table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.operators.features import core_feature_columns, finite_features, table_features
from tidewatch.operators.forest import Model, decision, fit_model, with_raw_score
from tidewatch.operators.harmonize import subsample
from tidewatch.operators.metrics import binary_metrics, confusion_matrix, training_summary
from tidewatch.operators.predict import predicted_label
from tidewatch.session import stage

LEAKING = ("event_type_code",)


def normal_rows(train: DataFrame) -> DataFrame:
    """The detector learns from normal traffic only."""
    return train.filter(F.col("label") == 0)


def training_columns(train: DataFrame, leak: bool = True) -> list[str]:
    """Feature columns; ``leak=False`` leaves out the one derived from the label."""
    return [c for c in table_features(train) if leak or c not in LEAKING]


def train_detector(train: DataFrame, trees: int = K.LABELLED_TREES,
                   contamination: float = K.LABELLED_CONTAMINATION, max_samples: int = 0,
                   leak: bool = True, row_key: str | None = None, staged: bool = True) -> Model:
    """Fit on normal rows.  The features are read several times, so they are staged once.

    Rows of one ``row_key`` are told apart by their features.
    """
    columns = training_columns(train, leak)
    normal = finite_features(normal_rows(train).select(*([row_key] if row_key else []), *columns), columns)
    if row_key:
        normal = normal.select(F.xxhash64(row_key, *columns).alias("_key"), *columns)
    key = F.col("_key") if row_key else None
    normal = subsample(normal, max_samples, row_key=key)
    if staged:
        normal = stage(normal, "training")
    return fit_model(normal, columns, trees, contamination, row_key=key)


def log_feature_table(enriched: DataFrame, *keep: str) -> DataFrame:
    """The core features of enriched logs as named, finite columns."""
    named = [c.alias(n) for c, n in zip(core_feature_columns(enriched), K.CORE_FEATURES)]
    return finite_features(enriched.select(*keep, *named), K.CORE_FEATURES)


def train_on_logs(enriched: DataFrame, row_key: str = "id", trees: int = K.DEFAULT_TREES,
                  contamination: float = K.DEFAULT_CONTAMINATION, staged: bool = True) -> Model:
    """Fit on unlabelled logs, with the same features that scoring uses."""
    rows = log_feature_table(enriched.withColumn("_key", F.col(row_key)), "_key")
    if staged:
        rows = stage(rows, "training")
    return fit_model(rows, K.CORE_FEATURES, trees, contamination,
                     row_key=F.col("_key"), data_source="logs")


def score_table(df: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (decision value), ``y_pred`` and, where labelled, ``y_true``."""
    columns = model.scaler.features
    scored = with_raw_score(finite_features(df, columns), [F.col(c) for c in columns], model)
    scored = scored.withColumn("score", decision(F.col("raw_score"), model.offset)).drop("raw_score")
    scored = scored.withColumn("y_pred", (predicted_label(F.col("score")) == -1).cast("int"))
    return scored.withColumn("y_true", F.col("label")) if "label" in df.columns else scored


def evaluate(test: DataFrame, model: Model) -> dict:
    """Metrics on a labelled table, as stored with the model."""
    scored = score_table(test, model)
    return binary_metrics(confusion_matrix(scored)).first().asDict()


def summarise_training(train: DataFrame, model: Model) -> DataFrame:
    return training_summary(score_table(normal_rows(train), model))
