"""Numeric feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.functions import columns as C


def with_message_risk(df: DataFrame) -> DataFrame:
    """Add ``message_risk_score``; a value already present is kept."""
    score = C.keyword_points(F.col("message"), K.FEATURE_KEYWORD_CAP)
    if "message_risk_score" in df.columns:
        score = F.coalesce(F.col("message_risk_score"), score)
    return df.withColumn("message_risk_score", score)


def _number(df: DataFrame, name: str, default) -> Column:
    """Column as DOUBLE; an absent column gives the default, an unreadable value null."""
    if name not in df.columns:
        return default if isinstance(default, Column) else F.lit(float(default))
    return F.col(name).try_cast("double")


def core_feature_columns(df: DataFrame) -> list[Column]:
    """The eleven live-log features, in model order."""
    def code(name: str, source: str, build, default: int) -> Column:
        fallback = build(F.col(source)).cast("double") if source in df.columns else F.lit(float(default))
        return _number(df, name, fallback)

    risk = C.keyword_points(F.col("message") if "message" in df.columns else F.lit(""),
                            K.FEATURE_KEYWORD_CAP).cast("double")
    if "message_risk_score" in df.columns:
        given = F.col("message_risk_score")
        risk = F.when(given.isNull(), risk).otherwise(given.try_cast("double"))
    return [
        _number(df, "src_port", 0), _number(df, "dst_port", 0),
        _number(df, "bytes_sent", 0), _number(df, "bytes_recv", 0),
        _number(df, "duration", 0),
        code("protocol_code", "protocol", C.protocol_code, 0),
        code("event_type_code", "event_type", C.event_type_code, 0),
        code("log_level_code", "log_level", C.log_level_code, 1),
        risk,
        _number(df, "hour_of_day", 12), _number(df, "is_weekend", 0),
    ]


def feature_columns(df: DataFrame, n_features: int = len(K.CORE_FEATURES)) -> list[Column]:
    """The first ``n_features`` features: core, then flow features, then 0.0 padding.

    A model with at most eleven features always gets the eleven core ones.
    """
    features = core_feature_columns(df)
    if n_features > len(features):
        features += [_number(df, n, d) for n, d in K.FLOW_FEATURE_DEFAULTS.items()]
        features += [F.lit(0.0)] * (n_features - len(features))
        features = features[:n_features]
    return features


def with_features(df: DataFrame, n_features: int = len(K.CORE_FEATURES)) -> DataFrame:
    """Add ``features``; null when any value is unreadable."""
    vector = F.array(*feature_columns(df, n_features))
    df = df.withColumn("features", vector)
    complete = F.forall("features", lambda x: x.isNotNull())
    return df.withColumn("features", F.when(complete, F.col("features")))


def feature_matrix(df: DataFrame, n_features: int = len(K.CORE_FEATURES)) -> DataFrame:
    """Rows whose vector could be built."""
    return with_features(df, n_features).filter(F.col("features").isNotNull())


def finite(value: Column) -> Column:
    """NaN and null to 0, infinities to plus or minus one million."""
    x = value.cast("double")
    return (F.when(x.isNull() | F.isnan(x), 0.0)
             .when(x == float("inf"), 1e6)
             .when(x == float("-inf"), -1e6)
             .otherwise(x))


def table_features(df: DataFrame, wanted: Sequence[str] = tuple(K.TABLE_FEATURES)) -> list[str]:
    """Training columns that the table really has."""
    return [name for name in wanted if name in df.columns]


def finite_features(df: DataFrame, wanted: Sequence[str] = tuple(K.TABLE_FEATURES)) -> DataFrame:
    """Replace each training column by its finite DOUBLE form."""
    return df.withColumns({n: finite(F.col(n)) for n in table_features(df, wanted)})
