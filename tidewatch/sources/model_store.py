"""Model persistence: three Parquet tables (scaler, forest, meta)."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tidewatch import constants as K
from tidewatch.operators.forest import FOREST_SCHEMA, SCALER_SCHEMA, Model, Scaler
from tidewatch.sources.datasets import path_exists

META_SCHEMA = ("n_features int, feature_columns array<string>, data_source string, "
               "contamination double, trees int, training_rows long, sample_size int, "
               "score_offset double, test_metrics string")


def save_model(spark: SparkSession, model: Model, path: str, test_metrics: dict | None = None) -> None:
    s = model.scaler
    scaler = [(i, f, m, d) for i, (f, m, d) in enumerate(zip(s.features, s.mean, s.std))]
    meta = [(model.n_features, s.features, model.data_source, model.contamination, model.trees,
             model.training_rows, model.sample_size, model.offset,
             json.dumps(test_metrics) if test_metrics else None)]
    forest = [tuple(row) for row in model.forest]
    # all three are bounded by the model, not by the data
    for name, rows, schema in (("scaler", scaler, SCALER_SCHEMA), ("forest", forest, FOREST_SCHEMA),
                               ("meta", meta, META_SCHEMA)):
        (spark.createDataFrame(rows, schema).coalesce(1)
              .write.mode("overwrite").parquet(f"{path}/{name}"))


def load_model(spark: SparkSession, path: str) -> Model | None:
    """The saved model, or None when any part is absent."""
    if not all(path_exists(spark, f"{path}/{part}") for part in ("scaler", "forest", "meta")):
        return None
    meta = spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").first()
    return Model(
        scaler=Scaler.from_table(spark.read.schema(SCALER_SCHEMA).parquet(f"{path}/scaler")),
        forest=spark.read.schema(FOREST_SCHEMA).parquet(f"{path}/forest").collect(),
        sample_size=meta["sample_size"], offset=meta["score_offset"],
        contamination=meta["contamination"], trees=meta["trees"],
        training_rows=meta["training_rows"], data_source=meta["data_source"])


def model_metadata(spark: SparkSession, path: str) -> dict | None:
    if not path_exists(spark, f"{path}/meta"):
        return None
    row = spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").first().asDict()
    row["test_metrics"] = json.loads(row["test_metrics"]) if row["test_metrics"] else None
    return row


def model_n_features(spark: SparkSession, path: str) -> int:
    meta = model_metadata(spark, path)
    return meta["n_features"] if meta else len(K.CORE_FEATURES)
