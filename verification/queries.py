"""One registered query per operator, with its SQL counterpart where there is one."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import constants as K
from tidewatch.functions import columns as C
from tidewatch.operators import (context, correlation, enrich, features, forest, harmonize, metrics,
                                 predict, quantiles, response, scoring, validate)
from tidewatch.plans import detection, feeds, reports, training
from tidewatch.session import stage, use_small_methods, use_utc, work_path
from tidewatch.sources import datasets, logs as log_sources, model_store, sinks
from tidewatch.sources.schemas import LOG_SCHEMA, NSL_SCHEMA
from tidewatch.streaming import flow, progress, retention
from verification import bridge, fixed_model
from verification.oracle import (NSL_CATEGORY, UNSW_CLEAN, UNSW_FLOW, UNSW_PORT, UNSW_PROTO, UNSW_RISK,
                                 UNSW_STATE, dbl, keyword_sum, log2_of, pick, sql, table_case, text)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_STAGED: dict[tuple[str, str, str], DataFrame] = {}
_STREAMED: dict[tuple[str, str, str], str] = {}


class Inputs:
    """The derived views of one scale factor, built on demand.

    The log views over the given tables are written once per session and scale
    factor, so that queries start from stored log rows.  Dataset rows are plain
    arithmetic on few columns, which costs less than reading them from a table
    with all columns; they are written for small tables only, to be spread.
    """

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = use_small_methods(use_utc(spark)), sf

    def _view(self, build, written: bool = True) -> DataFrame:
        """The view, stored unless ``written`` is false and its table comes in enough splits."""
        key = (self.spark.sparkContext.applicationId, self.sf, build.__name__)
        if key not in _STAGED:
            view = build(self.spark, self.sf)
            cores = self.spark.sparkContext.defaultParallelism
            if not written and view.rdd.getNumPartitions() >= cores:
                return view
            # one small file is one task; large tables already come in many splits
            if view.rdd.getNumPartitions() < cores:
                view = view.repartition(cores)
            _STAGED[key] = stage(view, build.__name__)
        return _STAGED[key]

    @property
    def logs(self) -> DataFrame:
        return self._view(bridge.net_logs)

    @property
    def enriched(self) -> DataFrame:
        return enrich.enrich_logs(self.logs)

    @property
    def evaluated(self) -> DataFrame:
        return context.evaluate_context(self.enriched)

    @property
    def live(self) -> DataFrame:
        return scoring.score_live(self.evaluated)

    @property
    def scored(self) -> DataFrame:
        return scoring.threat_score(self.evaluated)

    def run(self) -> detection.Detection:
        return detection.detect(self.enriched)

    @property
    def raw(self) -> DataFrame:
        return self._view(bridge.raw_json)

    @property
    def nsl(self) -> DataFrame:
        return self._view(bridge.nsl_like, written=False)

    @property
    def unsw(self) -> DataFrame:
        return self._view(bridge.unsw_like, written=False)

    @property
    def nsl_std(self) -> DataFrame:
        return harmonize.nsl_standardize(self.nsl, bridge.keyed_synthetic(), "k", "split")

    @property
    def unsw_std(self) -> DataFrame:
        return harmonize.unsw_standardize(self.unsw, bridge.keyed_synthetic(), "k", "split")

    @property
    def unified(self) -> DataFrame:
        return harmonize.union_datasets(self.nsl_std, self.unsw_std)

    @property
    def train(self) -> DataFrame:
        return self.unified.filter(F.col("split") == "train")

    def path(self, label: str) -> str:
        return work_path(self.spark, label)


def query(name: str, select: str | None = None, *needs: str, parsed: bool = False):
    """Register ``fn(inputs)``; ``select`` over the named SQL views is its counterpart."""
    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf: fn(Inputs(spark, sf))
        if select is not None:
            ORACLES[name] = sql(select, *needs, parsed=parsed)
        return fn
    return register


def whole(select: str, *names: str) -> str:
    """SQL sums of integers are wider than BIGINT; bring them back."""
    casts = ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)
    return f"SELECT * REPLACE ({casts}) FROM ({select})"


def _ingest_ts():
    return F.lit("2024-01-07 00:00:00").cast("timestamp")


# ============================================================ sources and sinks
@query("read_log_json", """
SELECT CAST(id AS VARCHAR) AS id, CASE fault WHEN 4 THEN 'not-a-time' WHEN 5 THEN substr(timestamp_utc, 1, 19) || '+05:30'
    WHEN 6 THEN substr(timestamp_utc, 1, 19) ELSE timestamp_utc END AS timestamp,
  CASE WHEN fault = 0 THEN NULL ELSE src_ip END AS src_ip, dst_ip,
  CASE WHEN fault = 1 THEN NULL ELSE src_port END AS src_port,
  CASE WHEN fault = 2 THEN NULL ELSE dst_port END AS dst_port,
  CASE WHEN fault = 7 THEN 'QUIC' ELSE protocol END AS protocol,
  CASE WHEN fault = 3 THEN NULL ELSE CAST(bytes_sent AS DOUBLE) END AS bytes_sent,
  CAST(bytes_recv AS DOUBLE) AS bytes_recv, duration, event_type, log_level, message FROM raw""", "raw")
def read_log_json(t: Inputs) -> DataFrame:
    path = t.path("json")
    t.raw.select("value").write.text(path)
    return log_sources.read_log_json(t.spark, path)


NSL_MADE = {"duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "hot", "num_failed_logins",
            "num_compromised", "root_shell", "su_attempted", "num_root", "count", "srv_count", "serror_rate",
            "same_srv_rate", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
            "dst_host_serror_rate", "attack_type"}


def _nsl_column(field) -> str:
    return field.name if field.name in NSL_MADE else f"CAST(0 AS {field.dataType.simpleString()}) AS {field.name}"


@query("read_nsl_csv", f"SELECT {', '.join(_nsl_column(f) for f in NSL_SCHEMA.fields)} FROM nsl", "nsl")
def read_nsl_csv(t: Inputs) -> DataFrame:
    train, test = (datasets.read_nsl_csv(t.spark, path) for path in _write_nsl_csv(t))
    return train.unionByName(test)


UNSW_NAMES = K.UNSW_STRING_COLUMNS + K.UNSW_LONG_COLUMNS + K.UNSW_DOUBLE_COLUMNS


@query("read_unsw_csv", "SELECT nullif(attack_cat, '') AS attack_cat, " + ', '.join(UNSW_NAMES[1:]) + " FROM unsw", "unsw")
def read_unsw_csv(t: Inputs) -> DataFrame:
    path = t.path("unsw")
    # white space and empty texts have to survive the file; the columns stand in another order than declared
    (t.unsw.select(*reversed(UNSW_NAMES)).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return datasets.read_unsw_csv(t.spark, path).select(*UNSW_NAMES)


def _write_nsl_csv(t: Inputs) -> tuple[str, str]:
    paths = {}
    for split in ("train", "test"):
        paths[split] = t.path(f"nsl-{split}")
        t.nsl.filter(F.col("split") == split).select(*K.NSL_COLUMNS).write.csv(paths[split])
    return paths["train"], paths["test"]


@query("optional_source", whole("""
SELECT split, 'NSL-KDD' AS dataset, count(*) AS n, sum(CASE WHEN category <> 'Normal' THEN 1 ELSE 0 END) AS attacks
FROM (SELECT split, """ + NSL_CATEGORY + """ AS category FROM nsl) GROUP BY split""", "attacks"), "nsl")
def optional_source(t: Inputs) -> DataFrame:
    absent = t.path("absent")
    train, test = datasets.load_datasets(
        t.spark, _write_nsl_csv(t), (f"{absent}/train.csv", f"{absent}/test.csv"))
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split", "dataset").agg(
        F.count("*").alias("n"), F.sum("label").alias("attacks"))


STORED_SQL = whole("""SELECT dataset, split, count(*) AS n, sum(label) AS attacks,
  round(avg(norm_duration), 6) AS mean_duration FROM unified GROUP BY dataset, split""", "attacks")


def _stored(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset", "split").agg(
        F.count("*").alias("n"), F.sum("label").alias("attacks"),
        F.round(F.avg("norm_duration"), 6).alias("mean_duration"))


@query("write_unified_table", STORED_SQL, "unified")
def write_unified_table(t: Inputs) -> DataFrame:
    path = t.path("unified")
    datasets.write_unified_table(t.unified, path)
    return _stored(t.spark.read.parquet(path))


@query("read_unified_table", STORED_SQL, "unified")
def read_unified_table(t: Inputs) -> DataFrame:
    path = t.path("unified-csv")
    unified = t.unified
    datasets.write_unified_table(unified, path, "csv")
    return _stored(datasets.read_unified_table(t.spark, path, unified.schema, "csv"))


def _trained(t: Inputs, trees: int = K.LABELLED_TREES) -> forest.Model:
    return training.train_detector(t.train, trees=trees, row_key="k")


SCALER_SQL = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, round(avg({c}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END, 6) AS std "
    f"FROM unified WHERE label = 0 AND split = 'train'" for i, c in enumerate(K.TABLE_FEATURES)) + ")"


@query("save_load_model", f"""SELECT *, true AS same_forest, true AS same_settings,
  (SELECT count(*) FROM unified WHERE label = 0 AND split = 'train') AS training_rows FROM ({SCALER_SQL})""", "unified")
def save_load_model(t: Inputs) -> DataFrame:
    """The stored scaler, and whether every node, the threshold and all other settings come back as they were."""
    path = t.path("model")
    model = _trained(t)
    model_store.save_model(t.spark, model, path)
    loaded = model_store.load_model(t.spark, path)
    assert model_store.model_n_features(t.spark, path) == loaded.n_features
    nodes = [sorted((row.asDict() for row in m.forest), key=lambda n: (n["tree_id"], n["node_id"])) for m in (model, loaded)]
    settings = [f.name for f in dataclasses.fields(model) if f.name != "forest"]
    table = t.spark.read.parquet(f"{path}/scaler")
    return table.select(
        "position", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
        F.lit(len(nodes[0]) > 0 and nodes[0] == nodes[1]).alias("same_forest"),
        F.lit(all(getattr(model, name) == getattr(loaded, name) for name in settings)).alias("same_settings"),
        F.lit(loaded.training_rows).cast("long").alias("training_rows"))


@query("write_action_log",
       "SELECT timestamp, alert_id, action, target, severity FROM actions", "actions")
def write_action_log(t: Inputs) -> DataFrame:
    path = t.path("actions")
    alerts = t.run().alerts()
    for _ in range(2):  # the second time replaces the first
        sinks.write_action_log(alerts, path, "first")
    return t.spark.read.parquet(path).drop("dt", "run")


_CUTS = ["2024-01-05 08:00:00", "2024-01-05 16:00:00", "2024-01-06 00:00:00", "2024-01-06 12:00:00"]
DELAY = "60 seconds"
CATCH_UP_BUCKET_MS = 600_000  # the lines are stored ones: no one waits for an alert


def _closing(number: int, stamp: str) -> str:
    """An anomalous log of an address of its own, which moves the watermark."""
    return json.dumps({
        "id": str(number), "timestamp": stamp, "src_ip": "192.0.2.250", "dst_ip": "10.0.1.9", "src_port": 1,
        "dst_port": 4444, "protocol": "TCP", "bytes_sent": 1, "bytes_recv": 1, "duration": 1.0,
        "event_type": "ddos", "log_level": "INFO", "message": ""})


def _stretches(t: Inputs, late: str = "false") -> list[DataFrame]:
    """The raw lines in stretches of rising time; rows for which ``late`` holds come last of all."""
    # the stream validates the lines; their order needs no more than the time
    seen = t.raw.select("value", F.col("id").alias("number"), F.get_json_object("value", "$.timestamp").alias("timestamp"))
    # every stretch reads all lines, whose time is read once
    seen = stage(enrich.with_event_time(seen, _ingest_ts()).select(
        "value", F.coalesce("ts", _ingest_ts()).alias("ts"), F.expr(late.replace("id", "number")).alias("late")), "timed-lines")
    edges = [None, *_CUTS, None]
    parts = [seen.filter("not late" + (f" and ts >= timestamp'{low}'" if low else "")
                         + (f" and ts < timestamp'{high}'" if high else "")).select("value")
             for low, high in zip(edges, edges[1:])]
    if late != "false":
        parts.append(t.spark.createDataFrame([(_closing(-1, "2024-01-08T00:00:00Z"),)], "value string"))
        parts.append(seen.filter("late").select("value"))
    return [*parts, t.spark.createDataFrame([(_closing(-9, "2024-01-09T00:00:00Z"),)], "value string")]


def _stream_events(t: Inputs, source: str, shared: bool = False) -> DataFrame:
    """The raw lines as a stream of enriched logs with their given score."""
    spark = use_utc(t.spark.newSession())
    # state is split once and for all when a stream first starts
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    raw = log_sources.stream_log_text(spark, source)
    logs = flow.enriched_stream(raw, _ingest_ts(), shared).withColumn("id", F.col("id").cast("long"))
    given = t.logs.select("id", "anomaly_score", "is_anomaly", "confidence")
    return logs.join(given, "id", "left").withColumns({
        "anomaly_score": F.coalesce("anomaly_score", F.lit(-0.3)), "is_anomaly": F.coalesce("is_anomaly", F.lit(True)),
        "confidence": F.coalesce("confidence", F.lit(0.6))})


def _streamed(t: Inputs, late: str = "false") -> str:
    """Run intake and flow over the lines in several batches, with a real delay; once per session and lines."""
    key = (t.spark.sparkContext.applicationId, t.sf, late)
    if key not in _STREAMED:
        _STREAMED[key] = _run_stream(t, late)
    return _STREAMED[key]


def _run_stream(t: Inputs, late: str) -> str:
    """A stretch is written in as many files as it has partitions and is one batch; the flow goes on from its state."""
    root, lines, state = t.path("stream"), t.path("lines"), t.path("stream-state")
    stretches = _stretches(t, late)
    for n, part in enumerate(stretches, 1):
        part.write.text(f"{lines}/{n:02}")
        scored = flow.score_stream(_stream_events(t, f"{lines}/*", shared=True), DELAY, bucket_ms=CATCH_UP_BUCKET_MS)
        # what a stretch makes due is released with the next one, and only after the last one by a batch without lines
        scored.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", n == len(stretches))
        flow.start(scored, root, state).awaitTermination()
    told = progress.ProgressTable(t.spark, f"{root}/progress")
    t.spark.streams.addListener(told)
    try:
        raw = log_sources.stream_log_text(t.spark, f"{lines}/*")
        intake = flow.start_intake(raw, root, t.path("intake-state"), _ingest_ts())
        intake.awaitTermination()
        assert told.wait(intake)
    finally:
        t.spark.streams.removeListener(told)
    retention.start_retention(t.spark, root, t.path("retention-state")).awaitTermination()
    return root


@query("fanout_sinks", """
SELECT 'logs' AS sink, severity, count(*) AS n FROM scored GROUP BY severity
UNION ALL SELECT 'alerts', severity, count(*) FROM alerts GROUP BY severity
UNION ALL SELECT 'stats', severity, count(*) FROM scored GROUP BY severity
UNION ALL SELECT 'totals', severity, count(*) FROM scored GROUP BY severity
UNION ALL SELECT 'actions', severity, count(*) FROM actions GROUP BY severity
UNION ALL SELECT 'rejected', reason, count(*) FROM raw WHERE reason <> 'OK' GROUP BY reason""",
       "scored", "alerts", "actions", "raw", parsed=True)
def fanout_sinks(t: Inputs) -> DataFrame:
    root = _streamed(t)
    read = t.spark.read.parquet
    parts = [sinks.read_committed(t.spark, root, sink).groupBy("severity").agg(F.count("*").alias("n"))
             .select(F.lit(sink).alias("sink"), "severity", "n") for sink in ("logs", "alerts", "actions")]
    stats = read(f"{root}/stats").groupBy("severity").agg(F.sum("logs").alias("n"))
    totals = read(f"{root}/totals")
    last = totals.agg(F.max("batch_id")).first()[0]
    totals = totals.filter(F.col("batch_id") == last).select("severity", F.col("logs").alias("n"))
    rejected = read(f"{root}/rejected").groupBy(F.col("reason").alias("severity")).agg(F.count("*").alias("n"))
    named = {"stats": stats, "totals": totals, "rejected": rejected}
    return harmonize.union_datasets(*parts, *[df.select(F.lit(sink).alias("sink"), "severity", "n")
                                              for sink, df in named.items()])


# ========================================================= validation, enrichment
@query("validate_required",
       "SELECT id, CASE WHEN fault = 0 THEN reason ELSE 'OK' END AS reason FROM raw", "raw")
def validate_required(t: Inputs) -> DataFrame:
    return validate.validate_required(t.raw).select("id", "reason")


@query("validate_types", "SELECT id, reason FROM raw", "raw")
def validate_types(t: Inputs) -> DataFrame:
    return validate.validate_types(t.raw).select("id", "reason")


@query("coerce_log_schema", """
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN fault = 0 THEN NULL ELSE src_ip END AS src_ip, src_port,
  CASE WHEN fault = 2 THEN 443 ELSE dst_port END AS dst_port, CASE WHEN fault = 3 THEN NULL ELSE CAST(bytes_sent AS DOUBLE) END AS bytes_sent, duration,
  CASE fault WHEN 0 THEN 'src_ip' WHEN 3 THEN 'bytes_sent' END AS rejected_fields FROM raw""", "raw")
def coerce_log_schema(t: Inputs) -> DataFrame:
    return validate.coerce_log_schema(t.raw.select("value")).select(
        "id", "src_ip", "src_port", "dst_port", "bytes_sent", "duration", "rejected_fields")


@query("parse_batch_filter", """
SELECT CAST(id AS VARCHAR) AS id, src_ip, src_port, dst_port, CAST(bytes_sent AS DOUBLE) AS bytes_sent,
  duration, CASE WHEN fault = 7 THEN 'QUIC' ELSE protocol END AS protocol, message
FROM raw WHERE reason = 'OK'""", "raw")
def parse_batch_filter(t: Inputs) -> DataFrame:
    valid, _ = validate.split_valid(validate.parse_logs(t.raw.select("value")))
    return valid.select("id", "src_ip", "src_port", "dst_port", "bytes_sent", "duration", "protocol", "message")


def _parsed(t: Inputs) -> DataFrame:
    valid, _ = validate.split_valid(validate.parse_logs(t.raw.select("value")))
    return valid


@query("normalize_timestamp", """
SELECT CAST(id AS VARCHAR) AS id, CAST(epoch(parsed_ts) AS BIGINT) AS utc_seconds FROM raw WHERE reason = 'OK'""", "raw")
def normalize_timestamp(t: Inputs) -> DataFrame:
    return enrich.with_event_time(_parsed(t), _ingest_ts()).select(
        "id", F.unix_seconds("ts").alias("utc_seconds"))


@query("hour_of_day", "SELECT id, hour_of_day FROM enriched", "enriched")
def hour_of_day(t: Inputs) -> DataFrame:
    return enrich.with_event_time(t.logs).select("id", C.hour_of_day(F.col("ts")).alias("hour_of_day"))


@query("is_weekend", "SELECT id, is_weekend FROM enriched", "enriched")
def is_weekend(t: Inputs) -> DataFrame:
    return enrich.with_event_time(t.logs).select("id", C.is_weekend(F.col("ts")).alias("is_weekend"))


@query("encode_protocol", "SELECT id, protocol_code FROM enriched", "enriched")
def encode_protocol(t: Inputs) -> DataFrame:
    return t.logs.select("id", C.protocol_code(F.col("protocol")).alias("protocol_code"))


@query("encode_event_type", "SELECT id, event_type_code FROM enriched", "enriched")
def encode_event_type(t: Inputs) -> DataFrame:
    return t.logs.select("id", C.event_type_code(F.col("event_type")).alias("event_type_code"))


@query("encode_log_level", "SELECT id, log_level_code FROM enriched", "enriched")
def encode_log_level(t: Inputs) -> DataFrame:
    return t.logs.select("id", C.log_level_code(F.col("log_level")).alias("log_level_code"))


@query("traffic_direction", "SELECT id, traffic_direction FROM enriched", "enriched")
def traffic_direction(t: Inputs) -> DataFrame:
    return t.logs.select("id", C.traffic_direction(F.col("src_ip"), F.col("dst_ip")).alias("traffic_direction"))


@query("enrich_logs", """
SELECT CAST(id AS VARCHAR) AS id, strftime(parsed_ts, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp_utc,
  CAST(hour(parsed_ts) AS INTEGER) AS hour_of_day, CASE WHEN isodow(parsed_ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN fault = 7 THEN 0 ELSE protocol_code END AS protocol_code, event_type_code, log_level_code,
  traffic_direction FROM raw WHERE reason = 'OK'""", "raw")
def enrich_logs(t: Inputs) -> DataFrame:
    return enrich.enrich_logs(_parsed(t), _ingest_ts()).select(
        "id", "timestamp_utc", "hour_of_day", "is_weekend", "protocol_code", "event_type_code",
        "log_level_code", "traffic_direction")


DOC_RISK = f"SELECT doc_id, least(25, {keyword_sum('text')}) AS message_risk_score FROM documents"


@query("message_risk_score", f"SELECT id, least(25, {keyword_sum('message')}) AS message_risk_score FROM enriched", "enriched")
def message_risk_score(t: Inputs) -> DataFrame:
    return features.with_message_risk(t.logs).select("id", "message_risk_score")


@query("message_risk_score_texts", DOC_RISK)
def message_risk_score_texts(t: Inputs) -> DataFrame:
    docs = bridge.table(t.spark, t.sf, "documents").select("doc_id", F.col("text").alias("message"))
    return features.with_message_risk(docs).select("doc_id", "message_risk_score")


CORE_SQL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in K.CORE_FEATURES)
RISKED = f"(SELECT *, least(25, {keyword_sum('message')}) AS message_risk_score FROM enriched)"
FLOW_DEFAULT_SQL = ", ".join(f"{dbl(v)} AS {n}" for n, v in K.FLOW_FEATURE_DEFAULTS.items())


def _unpack(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("id", *[F.col("features")[i].alias(n) for i, n in enumerate(names)])


@query("core_features", f"SELECT id, {CORE_SQL} FROM {RISKED}", "enriched")
def core_features(t: Inputs) -> DataFrame:
    return _unpack(features.with_features(t.enriched), K.CORE_FEATURES)


@query("expanded_features", f"SELECT id, {CORE_SQL}, {FLOW_DEFAULT_SQL}, {dbl(0.0)} AS pad FROM {RISKED}", "enriched")
def expanded_features(t: Inputs) -> DataFrame:
    return _unpack(features.with_features(t.enriched, 20), K.CORE_FEATURES + K.FLOW_FEATURES + ["pad"])


@query("feature_matrix", f"SELECT id, {CORE_SQL} FROM {RISKED} WHERE id % 10 <> 3", "enriched")
def feature_matrix(t: Inputs) -> DataFrame:
    broken = t.enriched.withColumn(
        "bytes_sent", F.when(F.col("id") % 10 == 3, "n/a").otherwise(F.col("bytes_sent").cast("string")))
    return _unpack(features.feature_matrix(broken), K.CORE_FEATURES)


LOGARITHMS = ("log_bytes_sent", "log_bytes_recv")  # compared to six decimals


@query("normalized_features", "SELECT k, dataset, " + ", ".join(
    f"round({c}, 6) AS {c}" if c in LOGARITHMS else f"CAST({c} AS DOUBLE) AS {c}"
    for c in K.TABLE_FEATURES if c != "count") + " FROM unified", "unified")
def normalized_features(t: Inputs) -> DataFrame:
    table = t.unified.drop("count")  # a missing column is left out
    names = features.table_features(table)
    return table.select("k", "dataset", *[
        (F.round(c, 6) if c in LOGARITHMS else F.col(c).cast("double")).alias(c) for c in names])


@query("nan_to_num", """
SELECT id, CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN CAST(1e6 AS DOUBLE) WHEN 2 THEN CAST(-1e6 AS DOUBLE)
  WHEN 3 THEN 0 ELSE duration END AS x FROM enriched""", "enriched")
def nan_to_num(t: Inputs) -> DataFrame:
    x = bridge.pick(F.col("id") % 5, float("nan"), float("inf"), float("-inf"), None)
    x = F.when(F.col("id") % 5 == 4, F.col("duration")).otherwise(x)
    return t.logs.select("id", features.finite(x).alias("x"))


# ================================================================ harmonisation
@query("nsl_attack_category", f"SELECT k, {NSL_CATEGORY} AS attack_category FROM nsl", "nsl")
def nsl_attack_category(t: Inputs) -> DataFrame:
    return t.nsl.select("k", harmonize.nsl_attack_category(F.col("attack_type")).alias("attack_category"))


@query("nsl_label", f"SELECT k, CASE WHEN {NSL_CATEGORY} <> 'Normal' THEN 1 ELSE 0 END AS label FROM nsl", "nsl")
def nsl_label(t: Inputs) -> DataFrame:
    return t.nsl.select("k", harmonize.nsl_label(
        harmonize.nsl_attack_category(F.col("attack_type"))).alias("label"))


@query("nsl_protocol_code",
       f"SELECT k, {table_case('protocol_type', K.NSL_PROTOCOL_CODES, 3)} AS protocol_code FROM nsl", "nsl")
def nsl_protocol_code(t: Inputs) -> DataFrame:
    return t.nsl.select("k", harmonize.nsl_protocol_code(F.col("protocol_type")).alias("protocol_code"))


@query("nsl_service_port",
       f"SELECT k, {table_case('service', K.NSL_SERVICE_PORTS, 0)} AS dst_port FROM nsl", "nsl")
def nsl_service_port(t: Inputs) -> DataFrame:
    return t.nsl.select("k", harmonize.nsl_service_port(F.col("service")).alias("dst_port"))


def hash_of(column: str, salt: int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {column}, {salt})), 1, 13) AS BIGINT)"


@query("synthetic_columns", f"""
SELECT k, {hash_of('k', 1)} % 64511 + 1024 AS src_port, CAST({hash_of('k', 2)} % 1000000 AS DOUBLE) / 1000000 AS hour_of_day,
  CASE WHEN {hash_of('k', 3)} % 100 < 28 THEN 1 ELSE 0 END AS is_weekend FROM nsl""", "nsl")
def synthetic_columns(t: Inputs) -> DataFrame:
    made = harmonize.synthetic_from("k")
    return t.nsl.select("k", made.src_port.alias("src_port"), made.hour.alias("hour_of_day"),
                        made.weekend.alias("is_weekend"))


@query("log2_bytes", f"""SELECT k, round({log2_of('src_bytes')}, 6) AS log_bytes_sent,
  round({log2_of('dst_bytes')}, 6) AS log_bytes_recv FROM nsl""", "nsl")
def log2_bytes(t: Inputs) -> DataFrame:
    return t.nsl.select("k", F.round(harmonize.log2_bytes(F.col("src_bytes")), 6).alias("log_bytes_sent"),
                        F.round(harmonize.log2_bytes(F.col("dst_bytes")), 6).alias("log_bytes_recv"))


@query("norm_duration", f"SELECT k, CAST(least(greatest(duration, 0), 300) AS DOUBLE) / {dbl(300.0)} AS norm_duration FROM nsl", "nsl")
def norm_duration(t: Inputs) -> DataFrame:
    return t.nsl.select("k", harmonize.norm_duration(F.col("duration")).alias("norm_duration"))


@query("nsl_flag_severity", f"SELECT k, {table_case('flag', K.NSL_FLAG_SEVERITY, 1)} AS log_level_code FROM nsl", "nsl")
def nsl_flag_severity(t: Inputs) -> DataFrame:
    return t.nsl.select("k", harmonize.nsl_flag_severity(F.col("flag")).alias("log_level_code"))


@query("category_event_code", f"SELECT k, {table_case(NSL_CATEGORY, K.CATEGORY_EVENT_CODES, 0)} AS event_type_code FROM nsl", "nsl")
def category_event_code(t: Inputs) -> DataFrame:
    return t.nsl.select("k", harmonize.category_event_code(
        harmonize.nsl_attack_category(F.col("attack_type"))).alias("event_type_code"))


@query("nsl_risk_score", "SELECT k, message_risk_score FROM nsl_std", "nsl_std")
def nsl_risk_score(t: Inputs) -> DataFrame:
    return t.nsl.select("k", harmonize.nsl_risk_score().alias("message_risk_score"))


@query("norm_ports", "SELECT k, src_port, dst_port FROM nsl_std", "nsl_std")
def norm_ports(t: Inputs) -> DataFrame:
    made = bridge.keyed_synthetic()
    return t.nsl.select("k", harmonize.norm_port(made.src_port).alias("src_port"),
                        harmonize.norm_port(harmonize.nsl_service_port(F.col("service"))).alias("dst_port"))


UNIFIED_SQL = "SELECT k, split, " + ", ".join(
    f"round({c}, 6) AS {c}" if c in LOGARITHMS else c for c in K.UNIFIED_COLUMNS) + " FROM "


def _comparable(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in LOGARITHMS})


@query("nsl_standardize", UNIFIED_SQL + "nsl_std", "nsl_std")
def nsl_standardize(t: Inputs) -> DataFrame:
    return _comparable(t.nsl_std)


@query("unsw_clean_category", f"SELECT k, {UNSW_CLEAN} AS attack_type FROM unsw", "unsw")
def unsw_clean_category(t: Inputs) -> DataFrame:
    return t.unsw.select("k", harmonize.unsw_clean_category(F.col("attack_cat")).alias("attack_type"))


@query("unsw_attack_category", f"SELECT k, {table_case(UNSW_CLEAN, K.UNSW_ATTACK_CATEGORY, 'Unknown')} AS attack_category FROM unsw", "unsw")
def unsw_attack_category(t: Inputs) -> DataFrame:
    return t.unsw.select("k", harmonize.unsw_attack_category(
        harmonize.unsw_clean_category(F.col("attack_cat"))).alias("attack_category"))


@query("unsw_label", "SELECT k, CAST(label AS INTEGER) AS label FROM unsw", "unsw")
def unsw_label(t: Inputs) -> DataFrame:
    return t.unsw_std.select("k", "label")


@query("unsw_protocol_code", f"SELECT k, {UNSW_PROTO} AS protocol_code FROM unsw", "unsw")
def unsw_protocol_code(t: Inputs) -> DataFrame:
    return t.unsw.select("k", harmonize.unsw_protocol_code(F.col("proto")).alias("protocol_code"))


@query("unsw_service_port", f"SELECT k, CAST({UNSW_PORT} AS BIGINT) AS dst_port FROM unsw", "unsw")
def unsw_service_port(t: Inputs) -> DataFrame:
    port = harmonize.unsw_service_port(F.col("service"), bridge.keyed_synthetic().port)
    return t.unsw.select("k", port.alias("dst_port"))


@query("unsw_state_severity", f"SELECT k, {UNSW_STATE} AS log_level_code FROM unsw", "unsw")
def unsw_state_severity(t: Inputs) -> DataFrame:
    return t.unsw.select("k", harmonize.unsw_state_severity(F.col("state")).alias("log_level_code"))


@query("unsw_risk_score", f"SELECT k, {UNSW_RISK} AS message_risk_score FROM unsw", "unsw")
def unsw_risk_score(t: Inputs) -> DataFrame:
    return t.unsw.select("k", harmonize.unsw_risk_score().alias("message_risk_score"))


@query("unsw_flow_features", f"SELECT k, {UNSW_FLOW} FROM unsw", "unsw")
def unsw_flow_features(t: Inputs) -> DataFrame:
    return t.unsw.select("k", *[c.alias(n) for n, c in harmonize.unsw_flow_features().items()])


@query("unsw_standardize", UNIFIED_SQL + "unsw_std", "unsw_std")
def unsw_standardize(t: Inputs) -> DataFrame:
    return _comparable(t.unsw_std)


@query("union_datasets", UNIFIED_SQL + "unified", "unified")
def union_datasets(t: Inputs) -> DataFrame:
    return _comparable(t.unified)


@query("seeded_shuffle", "SELECT k, label, attack_type FROM nsl_std", "nsl_std")
def seeded_shuffle(t: Inputs) -> DataFrame:
    return harmonize.seeded_shuffle(t.nsl_std.select("k", "label", "attack_type"))


@query("class_balance", whole("""
SELECT split, count(*) AS total, sum(label) AS attack, count(*) - sum(label) AS normal,
  round((count(*) - sum(label)) / count(*) * 100, 1) AS normal_pct, round(sum(label) / count(*) * 100, 1) AS attack_pct,
  round(sum(label) / count(*), 6) AS attack_rate FROM unified GROUP BY split""", "attack", "normal"), "unified")
def class_balance(t: Inputs) -> DataFrame:
    return harmonize.class_balance(t.unified, "split")


@query("value_counts", """
SELECT attack_type, count(*) AS n FROM unsw_std GROUP BY attack_type ORDER BY n DESC, attack_type LIMIT 10""", "unsw_std")
def value_counts(t: Inputs) -> DataFrame:
    return harmonize.value_counts(t.unsw_std, "attack_type", 10)


DESCRIBE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, "
    f"round(CAST(max({c}) AS DOUBLE), 6) AS max FROM unified WHERE split = 'train'" for c in K.TABLE_FEATURES)


@query("describe_features", DESCRIBE_SQL, "unified")
def describe_features(t: Inputs) -> DataFrame:
    out = quantiles.describe(t.train, K.TABLE_FEATURES)
    return out.select("feature", "count", *[F.round(c, 6).alias(c) for c in
                                            ("mean", "std", "min", "p25", "p50", "p75", "max")])


# ================================================================ model
@query("normal_only_filter", "SELECT k, dataset FROM unified WHERE label = 0 AND split = 'train'", "unified")
def normal_only_filter(t: Inputs) -> DataFrame:
    return training.normal_rows(t.train).select("k", "dataset")


@query("subsample_n", f"SELECT k FROM nsl_std WHERE label = 0 ORDER BY {hash_of('k', 42)} LIMIT 1000", "nsl_std")
def subsample_n(t: Inputs) -> DataFrame:
    normal = training.normal_rows(t.nsl_std)
    return harmonize.subsample(normal, 1000, row_key=F.col("k")).select("k")


@query("fit_scaler", SCALER_SQL, "unified")
def fit_scaler(t: Inputs) -> DataFrame:
    out = forest.fit_scaler(training.normal_rows(t.train), K.TABLE_FEATURES)
    return out.select("position", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


SCALED_SQL = ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}"
    for c in K.TABLE_FEATURES)


@query("scale_features", f"SELECT k, {SCALED_SQL} FROM nsl_std", "nsl_std")
def scale_features(t: Inputs) -> DataFrame:
    names = K.TABLE_FEATURES
    scaler = forest.Scaler.from_table(forest.fit_scaler(t.nsl_std, names))
    return forest.scale_features(t.nsl_std.select("k", *names), scaler).select(
        "k", *[F.round(c, 6).alias(c) for c in names])


@query("iforest_fit")
def iforest_fit(t: Inputs) -> DataFrame:
    normal = features.finite_features(training.normal_rows(t.train).select("k", *K.TABLE_FEATURES), K.TABLE_FEATURES)
    normal = stage(normal.withColumn("k", F.xxhash64("k", *K.TABLE_FEATURES)), "training")
    scaler = forest.Scaler.from_table(forest.fit_scaler(normal, K.TABLE_FEATURES))
    return forest.fit_forest(forest.scale_features(normal, scaler), K.TABLE_FEATURES, row_key=F.col("k"))


@query("iforest_invariants", """
SELECT CAST(t AS INTEGER) AS tree_id, (SELECT least(256, count(*)) FROM unified WHERE label = 0 AND split = 'train') AS rows,
  true AS sound FROM range(200) r(t)""", "unified")
def iforest_invariants(t: Inputs) -> DataFrame:
    """Every tree grows from its full sample, numbers its nodes without gaps and keeps to its depth."""
    leaf = F.col("left") < 0
    return iforest_fit(t).groupBy("tree_id").agg(
        F.sum(F.when(leaf, F.col("n"))).alias("rows"),
        ((F.max("depth") <= 8) & (F.count("*") == F.max("node_id") + 1)
         & (2 * F.count_if(leaf) == F.count("*") + 1)).alias("sound"))


def _fixed_scores(t: Inputs) -> DataFrame:
    model = fixed_model.model()
    return forest.with_raw_score(t.enriched, features.core_feature_columns(t.enriched), model)


@query("iforest_path_length", f"SELECT id, round({fixed_model.MEAN_PATH_SQL}, 9) AS mean_path FROM {RISKED}", "enriched")
def iforest_path_length(t: Inputs) -> DataFrame:
    model = fixed_model.model()
    walk = forest.path_length_udf(t.spark, model.forest)
    scaled = model.scaler.columns(features.core_feature_columns(t.enriched))
    return t.enriched.select("id", F.round(walk(*scaled), 9).alias("mean_path"))


DECISION_SQL = f"({fixed_model.RAW_SCORE_SQL} - {dbl(fixed_model.OFFSET)})"


@query("anomaly_score", f"SELECT id, round({fixed_model.RAW_SCORE_SQL}, 9) AS raw_score, round({DECISION_SQL}, 9) AS decision FROM {RISKED}", "enriched")
def anomaly_score(t: Inputs) -> DataFrame:
    return _fixed_scores(t).select(
        "id", F.round("raw_score", 9).alias("raw_score"),
        F.round(forest.decision(F.col("raw_score"), fixed_model.OFFSET), 9).alias("decision"))


@query("contamination_threshold", """
SELECT round(quantile_cont(anomaly_score, 0.1), 9) AS score_offset FROM enriched WHERE NOT is_attack""", "enriched")
def contamination_threshold(t: Inputs) -> DataFrame:
    normal = t.logs.filter(~F.col("is_attack"))
    return quantiles.exact_percentiles(quantiles.keyed_values(normal, ["anomaly_score"]), [0.1]).select(
        F.round("value", 9).alias("score_offset"))


@query("predict_label", "SELECT id, CASE WHEN anomaly_score < 0 THEN -1 ELSE 1 END AS prediction FROM enriched", "enriched")
def predict_label(t: Inputs) -> DataFrame:
    return t.logs.select("id", predict.predicted_label(F.col("anomaly_score")).alias("prediction"))


@query("predict_logs", f"""
SELECT id, d < 0 AS is_anomaly, CASE WHEN d < 0 THEN -1 ELSE 1 END AS prediction, round(d, 4) AS anomaly_score,
  CASE WHEN d < 0 THEN round(least(greatest(-d / {dbl(0.5)}, 0), 1), 4) ELSE {dbl(0.0)} END AS confidence,
  CAST(NULL AS VARCHAR) AS error
FROM (SELECT id, {DECISION_SQL} AS d FROM {RISKED})""", "enriched")
def predict_logs(t: Inputs) -> DataFrame:
    out = predict.predict_logs(t.enriched.drop("is_anomaly", "anomaly_score", "confidence"), fixed_model.model())
    return out.select("id", "is_anomaly", "prediction", "anomaly_score", "confidence", "error")


@query("predict_fallback", """
SELECT id, false AS is_anomaly, 1 AS prediction, CAST(0 AS DOUBLE) AS anomaly_score, CAST(0 AS DOUBLE) AS confidence,
  'Model not loaded' AS error, CASE WHEN id % 10 = 3 THEN 'Feature extraction failed' END AS second_error FROM enriched""", "enriched")
def predict_fallback(t: Inputs) -> DataFrame:
    absent = predict.predict_logs(t.enriched, None)
    broken = absent.withColumn("features", F.when(F.col("id") % 10 != 3, F.array(F.lit(1.0)))).withColumnRenamed("error", "first_error")
    return predict.fallback(broken, model_loaded=True).select(
        "id", "is_anomaly", "prediction", "anomaly_score", "confidence",
        F.col("first_error").alias("error"), F.col("error").alias("second_error"))


def _judged(t: Inputs) -> DataFrame:
    return t.logs.select("id", F.col("is_attack").cast("int").alias("y_true"),
                         F.col("is_anomaly").cast("int").alias("y_pred"),
                         F.col("anomaly_score").alias("score"))


@query("training_summary", whole("""
SELECT count(*) AS n_samples, sum(CASE WHEN anomaly_score < 0 THEN 1 ELSE 0 END) AS n_anomalies,
  round(sum(CASE WHEN anomaly_score < 0 THEN 1 ELSE 0 END) / count(*) * 100, 2) AS anomaly_percentage,
  round(avg(anomaly_score), 4) AS mean_score, round(stddev_pop(anomaly_score), 4) AS std_score,
  round(min(anomaly_score), 4) AS min_score, round(max(anomaly_score), 4) AS max_score FROM enriched""", "n_anomalies"), "enriched")
def training_summary(t: Inputs) -> DataFrame:
    return metrics.training_summary(_judged(t))


MATRIX_SQL = "(" + whole("""SELECT sum(CASE WHEN NOT is_attack AND NOT is_anomaly THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN NOT is_attack AND is_anomaly THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN is_attack AND NOT is_anomaly THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN is_attack AND is_anomaly THEN 1 ELSE 0 END) AS tp FROM enriched""", "tn", "fp", "fn", "tp") + ")"


@query("confusion_matrix", f"SELECT tn, fp, fn, tp FROM {MATRIX_SQL}", "enriched")
def confusion_matrix(t: Inputs) -> DataFrame:
    return metrics.confusion_matrix(_judged(t))


@query("binary_metrics", f"""
SELECT round((tp + tn) / (tn + fp + fn + tp), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision,
  round(tp / (tp + fn), 4) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 4) AS f1_score,
  tp, fp, tn, fn, round(fp / greatest(fp + tn, 1), 4) AS false_positive_rate FROM {MATRIX_SQL}""", "enriched")
def binary_metrics(t: Inputs) -> DataFrame:
    return metrics.binary_metrics(metrics.confusion_matrix(_judged(t)))


@query("classification_report", f"""
SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1_score, support FROM (
 SELECT 'Normal' AS class, pn AS p, rn AS r, fn1 AS f, sn AS support FROM m
 UNION ALL SELECT 'Attack', pa, ra, fa1, sa FROM m
 UNION ALL SELECT 'accuracy', (tn + tp) / (sn + sa), (tn + tp) / (sn + sa), (tn + tp) / (sn + sa), sn + sa FROM m
 UNION ALL SELECT 'macro avg', (pn + pa) / 2, (rn + ra) / 2, (fn1 + fa1) / 2, sn + sa FROM m
 UNION ALL SELECT 'weighted avg', (pn * sn + pa * sa) / (sn + sa), (rn * sn + ra * sa) / (sn + sa),
   (fn1 * sn + fa1 * sa) / (sn + sa), sn + sa FROM m)""".replace("FROM m", """FROM (
  SELECT *, 2 * pn * rn / (pn + rn) AS fn1, 2 * pa * ra / (pa + ra) AS fa1 FROM (
   SELECT *, tn / (tn + fn) AS pn, tn / (tn + fp) AS rn, tn + fp AS sn,
     tp / (tp + fp) AS pa, tp / (tp + fn) AS ra, tp + fn AS sa FROM """ + MATRIX_SQL + "))"), "enriched")
def classification_report(t: Inputs) -> DataFrame:
    return metrics.classification_report(metrics.confusion_matrix(_judged(t)))


@query("score_distribution", """
SELECT round(avg(anomaly_score) FILTER (NOT is_attack), 4) AS normal_mean,
  round(stddev_pop(anomaly_score) FILTER (NOT is_attack), 4) AS normal_std,
  round(avg(anomaly_score) FILTER (is_attack), 4) AS attack_mean,
  round(stddev_pop(anomaly_score) FILTER (is_attack), 4) AS attack_std,
  round(avg(anomaly_score) FILTER (NOT is_attack) - avg(anomaly_score) FILTER (is_attack), 4) AS separation
FROM enriched""", "enriched")
def score_distribution(t: Inputs) -> DataFrame:
    return metrics.score_distribution(_judged(t))


@query("train_evaluate")
def train_evaluate(t: Inputs) -> DataFrame:
    model = _trained(t)
    scored = training.score_table(t.unified.filter(F.col("split") == "test"), model)
    return metrics.binary_metrics(metrics.confusion_matrix(scored))


@query("train_evaluate_totals", """
SELECT count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS attacks FROM unified WHERE split = 'test'""", "unified")
def train_evaluate_totals(t: Inputs) -> DataFrame:
    """The confusion matrix covers every test row under its true label."""
    return train_evaluate(t).select((F.col("tn") + F.col("fp")).alias("normal"), (F.col("fn") + F.col("tp")).alias("attacks"))


# ================================================================ context
def _rule(name: str, flag, suppresses, flag_sql: str, suppress_sql: str) -> None:
    select = f"SELECT id, is_anomaly AND ({flag_sql}) AS flag, {suppress_sql} AS suppress FROM rules"

    @query(name, select, "rules")
    def run(t: Inputs) -> DataFrame:
        on = F.col("is_anomaly")
        return t.enriched.select("id", (on & flag()).alias("flag"), (on & suppresses()).alias("suppress"))


_rule("rule_maintenance", context.maintenance_flag, context.maintenance_suppresses, "f_maintenance", "s_maintenance")
_rule("rule_backup", context.backup_flag, context.backup_suppresses, "f_backup", "s_backup")
_rule("rule_whitelist", context.whitelist_flag, context.whitelist_suppresses, "f_white", "s_white")
_rule("rule_internal", context.internal_suppresses, context.internal_suppresses, "s_internal", "s_internal")


@query("rule_whitelist_table", """
SELECT * FROM (WITH single AS (SELECT src_ip AS entry FROM enriched WHERE id % 97 = 0),
  prefixes AS (SELECT regexp_extract(dst_ip, '^[0-9]+[.][0-9]+[.][0-9]+[.]') AS entry FROM enriched WHERE id % 1001 = 1),
  subnets AS (SELECT regexp_extract(src_ip, '^[0-9]+[.][0-9]+[.]') AS entry FROM enriched WHERE id % 1009 = 2),
  listed AS (SELECT DISTINCT address FROM (SELECT src_ip AS address FROM enriched UNION SELECT dst_ip FROM enriched)
    WHERE address IN (SELECT entry FROM single)
      OR regexp_extract(address, '^[0-9]+[.][0-9]+[.][0-9]+[.]') IN (SELECT entry FROM prefixes)
      OR regexp_extract(address, '^[0-9]+[.][0-9]+[.]') IN (SELECT entry FROM subnets))
SELECT id, coalesce(is_anomaly AND whitelisted, false) AS whitelisted,
  coalesce(is_anomaly AND (s_maintenance OR s_backup OR s_internal OR (whitelisted AND confidence < 0.6)), false) AS suppress
FROM (SELECT *, src_ip IN (SELECT address FROM listed) OR dst_ip IN (SELECT address FROM listed) AS whitelisted
  FROM evaluated))""", "enriched", "evaluated")
def rule_whitelist_table(t: Inputs) -> DataFrame:
    """The trusted addresses come from a table: single ones, prefixes and subnets taken from the logs themselves."""
    logs = t.enriched
    listed = (logs.filter("id % 97 = 0").select(F.col("src_ip").alias("entry"))
              .unionByName(logs.filter("id % 1001 = 1").select(F.regexp_extract("dst_ip", r"^([0-9]+\.){3}", 0).alias("entry")))
              .unionByName(logs.filter("id % 1009 = 2").select(
                  F.concat(F.regexp_extract("src_ip", r"^[0-9]+\.[0-9]+", 0), F.lit(".0.0/16")).alias("entry"))))
    return context.evaluate_context(logs, listed).select(
        "id", F.array_contains("context_flags", "whitelisted_ip").alias("whitelisted"), "suppress")


@query("context_gate", """
SELECT id, suppress, context_reason, adjusted_score, flags FROM evaluated WHERE NOT is_anomaly""", "evaluated")
def context_gate(t: Inputs) -> DataFrame:
    return t.evaluated.filter(~F.col("is_anomaly")).select(
        "id", "suppress", "context_reason", "adjusted_score", F.array_join("context_flags", ",").alias("flags"))


@query("rule_peak_hours", "SELECT id, peak_adjusted, adjusted_score FROM evaluated", "evaluated")
def rule_peak_hours(t: Inputs) -> DataFrame:
    return t.evaluated.select("id", "peak_adjusted", "adjusted_score")


@query("context_reason", "SELECT id, context_reason FROM evaluated", "evaluated")
def context_reason(t: Inputs) -> DataFrame:
    return t.evaluated.select("id", "context_reason")


@query("context_flags", "SELECT id, flags FROM evaluated", "evaluated")
def context_flags(t: Inputs) -> DataFrame:
    return t.evaluated.select("id", F.array_join("context_flags", ",").alias("flags"))


@query("context_evaluate", """
SELECT id, suppress, context_reason, adjusted_score, flags, rule_hits, peak_adjusted FROM evaluated""", "evaluated")
def context_evaluate(t: Inputs) -> DataFrame:
    return t.evaluated.select("id", "suppress", "context_reason", "adjusted_score",
                              F.array_join("context_flags", ",").alias("flags"), "rule_hits", "peak_adjusted")


SUPPRESSION_SQL = whole("""
SELECT count(*) AS total_evaluated, sum(rule_hits) AS suppressed, sum(CASE WHEN suppress THEN 1 ELSE 0 END) AS suppressed_rows,
  sum(peak_adjusted) AS adjusted, round(sum(rule_hits) / greatest(count(*), 1) * 100, 2) AS suppression_rate FROM evaluated""",
                        "suppressed", "suppressed_rows", "adjusted")


@query("suppression_stats", SUPPRESSION_SQL, "evaluated")
def suppression_stats(t: Inputs) -> DataFrame:
    return context.suppression_stats(t.evaluated)


# ================================================================ scoring
@query("score_gate", "SELECT id, gate FROM points", "points")
def score_gate(t: Inputs) -> DataFrame:
    return t.evaluated.select("id", scoring.gate().alias("gate"))


@query("ml_base_points", "SELECT id, ml_points FROM points", "points")
def ml_base_points(t: Inputs) -> DataFrame:
    return t.logs.select("id", scoring.ml_points().alias("ml_points"))


@query("feature_points", "SELECT id, feature_points FROM points", "points")
def feature_points(t: Inputs) -> DataFrame:
    return t.logs.select("id", scoring.feature_points().alias("feature_points"))


@query("keyword_points", "SELECT id, keyword_points FROM points", "points")
def keyword_points(t: Inputs) -> DataFrame:
    return t.logs.select("id", scoring.keyword_points().alias("keyword_points"))


@query("event_correlation", "SELECT id, repeat_count, correlation_points FROM correlated", "correlated")
def event_correlation(t: Inputs) -> DataFrame:
    # two narrow reads of the source: the rows, and their span summaries
    live = t.evaluated.filter(scoring.gate().isNull()).select("id", "src_ip", "ts")
    return correlation.correlate(live).select("id", "repeat_count", "correlation_points")


@query("attack_bonus", "SELECT id, bonus_points FROM points", "points")
def attack_bonus(t: Inputs) -> DataFrame:
    return t.logs.select("id", scoring.attack_bonus().alias("bonus_points"))


@query("peak_reduction", "SELECT id, f_peak AS in_peak, threat_score FROM live", "live")
def peak_reduction(t: Inputs) -> DataFrame:
    return t.live.select("id", F.array_contains("context_flags", "peak_hours").alias("in_peak"), "threat_score")


@query("severity_bucket", "SELECT id, threat_score, severity FROM live", "live")
def severity_bucket(t: Inputs) -> DataFrame:
    return t.live.select("id", "threat_score", scoring.severity_of(F.col("threat_score")).alias("severity"))


@query("threat_score", "SELECT id, threat_score, severity, repeat_count FROM scored", "scored")
def threat_score(t: Inputs) -> DataFrame:
    return t.scored.select("id", "threat_score", "severity", "repeat_count")


FACTORS_SQL = f"""CASE WHEN severity = 'SUPPRESSED' THEN context_reason END AS reason,
  CASE WHEN is_live THEN ml_points END AS ml_anomaly_base,
  CASE WHEN is_live AND bytes_sent > 100000 THEN bytes_sent END AS high_bytes_sent,
  CASE WHEN is_live AND dst_port IN ({', '.join(map(str, K.SUSPICIOUS_PORTS))}) THEN dst_port END AS suspicious_port,
  CASE WHEN is_live AND duration < {dbl(0.01)} THEN duration END AS rapid_connection,
  CASE WHEN is_live THEN feature_points END AS feature_modifiers,
  CASE WHEN is_live THEN keyword_points END AS keyword_risk,
  CASE WHEN is_live THEN correlation_points END AS event_correlation,
  CASE WHEN is_live THEN repeat_count END AS repeat_count,
  CASE WHEN is_live THEN bonus_points END AS attack_pattern_bonus,
  CASE WHEN is_live AND f_peak THEN true END AS peak_hours_reduction"""


@query("score_factors", f"SELECT id, {FACTORS_SQL} FROM scored", "scored")
def score_factors(t: Inputs) -> DataFrame:
    return t.scored.select("id", "factors.*")


@query("ip_history_size", whole("""
SELECT sum(repeat_count) AS ip_history_size FROM (
  SELECT repeat_count, row_number() OVER (PARTITION BY src_ip ORDER BY secs DESC, id DESC) AS place FROM correlated)
WHERE place = 1""", "ip_history_size"), "correlated")
def ip_history_size(t: Inputs) -> DataFrame:
    live = t.evaluated.filter(scoring.gate().isNull()).select("id", "src_ip", "ts")
    return correlation.ip_history_size(correlation.correlate(live))


# ================================================================ response
@query("response_gate", "SELECT id, severity FROM live", "live")
def response_gate(t: Inputs) -> DataFrame:
    return response.response_gate(t.scored).select("id", "severity")


@query("alert_cooldown", "SELECT id, src_ip FROM passed", "passed")
def cooldown(t: Inputs) -> DataFrame:
    return t.run().passed.select("id", "src_ip")


ALERT_SQL = """SELECT alert_id AS id, timestamp_utc AS timestamp, severity, threat_score, src_ip, dst_ip, event_type,
  message, anomaly_score, confidence, repeat_count FROM alerts"""


def _alerts_shown(alerts: DataFrame) -> DataFrame:
    return alerts.select("id", "timestamp", "severity", "threat_score", "src_ip", "dst_ip", "event_type", "message",
                         "anomaly_score", "confidence", F.col("factors.repeat_count").alias("repeat_count"))


@query("create_alert", f"""SELECT alert_id AS id, timestamp_utc AS timestamp, severity, threat_score, src_ip, dst_ip,
  event_type, message, anomaly_score, confidence, {FACTORS_SQL} FROM (SELECT *, true AS is_live FROM alerts)""", "alerts")
def create_alert(t: Inputs) -> DataFrame:
    """Alerts with each of their factors in a column."""
    return t.run().alerts().select("id", "timestamp", "severity", "threat_score", "src_ip", "dst_ip", "event_type",
                                   "message", "anomaly_score", "confidence", "factors.*")


@query("response_actions", "SELECT alert_id, position, action AS type, description, target FROM actions", "actions")
def response_actions(t: Inputs) -> DataFrame:
    alerts = t.run().alerts()
    return alerts.select(F.col("id").alias("alert_id"), F.posexplode("actions").alias("position", "a")).select(
        "alert_id", "position", "a.type", "a.description", "a.target")


@query("action_rows", "SELECT timestamp, alert_id, action, target, severity FROM actions", "actions")
def action_rows(t: Inputs) -> DataFrame:
    return response.action_rows(t.run().alerts()).select("timestamp", "alert_id", "action", "target", "severity")


@query("alert_retention", f"{ALERT_SQL} ORDER BY secs DESC, alerts.id DESC LIMIT 500", "alerts")
def alert_retention(t: Inputs) -> DataFrame:
    return _alerts_shown(response.alert_retention(t.run().alerts()))


@query("response_stats", """
SELECT 'total_alerts' AS metric, 'all' AS key, count(*) AS value FROM passed
UNION ALL SELECT 'suppressed_by_cooldown', 'all', (SELECT count(*) FROM live) - (SELECT count(*) FROM passed)
UNION ALL SELECT 'by_severity', severity, count(*) FROM alerts GROUP BY severity
UNION ALL SELECT 'actions_taken', action, count(*) FROM actions GROUP BY action""", "alerts", "actions")
def response_stats(t: Inputs) -> DataFrame:
    run = t.run()
    return response.response_stats(run.live, run.alerts())


@query("recent_alerts", f"{ALERT_SQL} ORDER BY secs DESC, alerts.id DESC LIMIT 50", "alerts")
def recent_alerts(t: Inputs) -> DataFrame:
    return _alerts_shown(response.recent_alerts(t.run().alerts()))


# ================================================================ whole runs and feeds
RUN_SQL = """SELECT s.id, s.is_anomaly, s.severity, s.threat_score, a.alert_id, s.suppress AS suppressed
FROM scored s LEFT JOIN alerts a ON a.id = s.id"""


def _parsed_logs(t: Inputs) -> DataFrame:
    """Raw JSON lines, parsed, validated and enriched."""
    parsed = _parsed(t).withColumn("id", F.col("id").cast("long"))
    return enrich.enrich_logs(parsed, _ingest_ts())


def _parsed_run(t: Inputs) -> detection.Detection:
    """The run over the valid raw lines, with the given score of each log."""
    given = t.logs.select("id", "anomaly_score", "is_anomaly", "confidence")
    return detection.detect(_parsed_logs(t).join(given, "id"))


@query("process_logs", RUN_SQL, "scored", "alerts", parsed=True)
def process_logs(t: Inputs) -> DataFrame:
    return detection.run_logs(_parsed_run(t))


@query("process_logs_fitted_invariants", """
SELECT count(*) AS logs, CAST(0 AS BIGINT) AS inconsistent, true AS share_kept FROM raw WHERE reason = 'OK'""", "raw")
def process_logs_fitted_invariants(t: Inputs) -> DataFrame:
    """Each valid log once, its fields in agreement, and the share of anomalies that the model was fitted to."""
    severe = F.col("severity").isin("LOW", "MEDIUM", "HIGH", "CRITICAL")
    agree = ((F.col("severity") == "NORMAL") == ~F.col("is_anomaly")) & \
        ((F.col("severity") == "SUPPRESSED") == F.col("suppressed")) & \
        (severe | (F.col("alert_id").isNull() & (F.col("threat_score") == 0))) & F.col("threat_score").between(0, 100)
    return process_logs_fitted(t).agg(
        F.count_distinct("id").alias("logs"), F.count_if(~F.coalesce(agree, F.lit(False))).alias("inconsistent"),
        (F.abs(F.avg(F.col("is_anomaly").cast("double")) - K.DEFAULT_CONTAMINATION) < 0.02).alias("share_kept"))


@query("process_logs_fitted")
def process_logs_fitted(t: Inputs) -> DataFrame:
    enriched = _parsed_logs(t)
    model = training.train_on_logs(enriched)
    return detection.run_logs(detection.predict_and_detect(enriched, model))


@query("log_payload", """
SELECT CAST(id AS VARCHAR) AS id, timestamp_utc AS timestamp, src_ip, dst_ip, event_type, log_level, message,
  is_anomaly, severity, threat_score FROM scored""", "scored")
def log_payload(t: Inputs) -> DataFrame:
    return feeds.log_payload(t.scored).drop("ts")


@query("recent_logs", """
SELECT id, timestamp_utc, src_ip, event_type, message FROM enriched ORDER BY secs DESC, id DESC LIMIT 1000""", "enriched")
def recent_logs(t: Inputs) -> DataFrame:
    return feeds.recent_logs(t.enriched).select("id", "timestamp_utc", "src_ip", "event_type", "message")


STATS_SQL = """SELECT (SELECT count(*) FROM evaluated) AS total_logs, count(*) AS total_alerts,
  count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity IN ('HIGH', 'CRITICAL')) AS active_threats,
  (SELECT sum(rule_hits) FROM evaluated) AS suppressed FROM alerts"""


def _service_stats(t: Inputs) -> DataFrame:
    run = t.run()
    return feeds.service_stats(run.evaluated, run.alerts(), model_loaded=True)


@query("service_stats", whole("""
SELECT (SELECT count(*) FROM evaluated) AS total_logs, (SELECT count(*) FROM alerts) AS total_alerts,
  string_agg(severity || '=' || n, ',' ORDER BY severity) AS severity_counts,
  sum(CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN n ELSE 0 END) AS active_threats,
  (SELECT sum(rule_hits) FROM evaluated) AS suppressed_count, true AS model_loaded
FROM (SELECT severity, count(*) AS n FROM alerts GROUP BY severity)""", "active_threats", "suppressed_count"), "alerts", "evaluated")
def service_stats(t: Inputs) -> DataFrame:
    shown = F.array_join(F.transform(F.map_entries("severity_counts"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _service_stats(t).withColumn("severity_counts", shown)


@query("ingest_response", """
SELECT r.id, 'ok' AS status, CASE WHEN r.valid THEN x.is_anomaly ELSE false END AS is_anomaly,
  CASE WHEN r.valid THEN x.severity ELSE 'NORMAL' END AS severity,
  CASE WHEN r.valid THEN x.threat_score ELSE 0 END AS threat_score,
  CASE WHEN r.valid THEN x.alert_id END AS alert_id, CASE WHEN r.valid THEN x.suppressed ELSE false END AS suppressed
FROM (SELECT id, reason = 'OK' AS valid FROM raw) r LEFT JOIN (""" + RUN_SQL + ") x ON x.id = r.id",
       "raw", "scored", "alerts", parsed=True)
def ingest_response(t: Inputs) -> DataFrame:
    # logs that fail validation never reach the run, so they take the defaults
    return detection.ingest_response(t.raw, detection.run_logs(_parsed_run(t)))


@query("log_feed", """
SELECT id, strftime(ts, '%H:%M:%S') AS time, src_ip, event_type, message, is_anomaly AS highlight, severity
FROM scored ORDER BY secs DESC, id DESC LIMIT 200""", "scored")
def log_feed(t: Inputs) -> DataFrame:
    return feeds.log_feed(t.scored)


@query("alert_feed", """
SELECT alert_id, severity, 'Score: ' || threat_score || '/100' AS score, src_ip || ' → ' || dst_ip AS route, message,
  strftime(ts, '%H:%M:%S') || ' · ' || event_type AS footer
FROM alerts ORDER BY secs DESC, id DESC LIMIT 100""", "alerts")
def alert_feed(t: Inputs) -> DataFrame:
    return feeds.alert_feed(t.run().alerts())


@query("action_feed", """
SELECT alert_id, action, description, severity FROM actions ORDER BY secs DESC, log_id DESC, position DESC LIMIT 150""", "actions")
def action_feed(t: Inputs) -> DataFrame:
    return feeds.action_feed(response.action_rows(t.run().alerts()))


@query("stat_tiles", whole(STATS_SQL, "suppressed"), "alerts", "evaluated")
def stat_tiles(t: Inputs) -> DataFrame:
    return feeds.stat_tiles(_service_stats(t))


# ================================================================ reports
ATTACKS = ", ".join(text(a) for a in K.ATTACK_TYPES)


@query("ground_truth", f"SELECT id, event_type IN ({ATTACKS}) AS is_actual_attack FROM enriched", "enriched")
def ground_truth(t: Inputs) -> DataFrame:
    return reports.ground_truth(t.logs).select("id", "is_actual_attack")


@query("detection_confusion", f"""
SELECT tn, fp, fn, tp, round((tp + tn) / greatest(tn + fp + fn + tp, 1), 4) AS accuracy, round(p, 4) AS precision,
  round(r, 4) AS recall, round(2 * p * r / greatest(p + r, {dbl(0.001)}), 4) AS f1_score
FROM (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM {MATRIX_SQL})""", "enriched")
def detection_confusion(t: Inputs) -> DataFrame:
    return reports.detection_confusion(t.logs)


def _histogram_sql(source: str, column: str, bins: int, by: str | None) -> str:
    over = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    on = f"g.{by} = c.{by} AND " if by else ""
    shown = f"g.{by} AS {by}, " if by else ""
    return f"""
SELECT {shown}g.bin, round(g.low + g.bin * ((g.high - g.low) / {bins}), 9) AS bin_start, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT {lead}low, high, bin FROM (SELECT {lead}min({column}) OVER ({over}) AS low,
        max({column}) OVER ({over}) AS high FROM {source}), range(0, {bins}) AS r(bin)) g
LEFT JOIN (SELECT {lead}least({bins - 1}, CAST(floor((v - low) / ((high - low) / {bins})) AS BIGINT)) AS bin, count(*) AS n
  FROM (SELECT {lead}{column} AS v, min({column}) OVER ({over}) AS low, max({column}) OVER ({over}) AS high FROM {source})
  GROUP BY ALL) c ON {on}g.bin = c.bin"""


@query("score_histogram", _histogram_sql(
    f"(SELECT *, event_type IN ({ATTACKS}) AS is_actual_attack FROM enriched)",
    "anomaly_score", 50, "is_actual_attack"), "enriched")
def score_histogram(t: Inputs) -> DataFrame:
    return reports.score_histogram(t.logs).withColumn("bin_start", F.round("bin_start", 9))


@query("detection_rate", whole(f"""
SELECT p.place, p.event_type, count(e.id) AS total, coalesce(sum(CASE WHEN e.is_anomaly THEN 1 ELSE 0 END), 0) AS detected,
  round(coalesce(sum(CASE WHEN e.is_anomaly THEN 1 ELSE 0 END), 0) / greatest(count(e.id), 1) * 100, 4) AS rate
FROM (VALUES {', '.join(f'({i}, {text(a)})' for i, a in enumerate(K.ATTACK_TYPES))}) p(place, event_type)
LEFT JOIN enriched e ON e.event_type = p.event_type GROUP BY p.place, p.event_type""", "detected"), "enriched")
def detection_rate(t: Inputs) -> DataFrame:
    return reports.detection_rate(t.logs)


@query("severity_distribution", f"""
SELECT p.place, p.severity, count(s.id) AS n
FROM (VALUES {', '.join(f'({i}, {text(a)})' for i, a in enumerate(K.SEVERITY_ORDER))}) p(place, severity)
LEFT JOIN scored s ON s.severity = p.severity GROUP BY p.place, p.severity""", "scored")
def severity_distribution(t: Inputs) -> DataFrame:
    return reports.severity_distribution(t.scored)


@query("distribution_summary", "SELECT round(avg(duration), 6) AS mean, round(quantile_cont(duration, 0.95), 6) AS p95 FROM enriched", "enriched")
def distribution_summary(t: Inputs) -> DataFrame:
    summary, _ = reports.distribution_summary(t.logs, "duration")
    return summary.select(F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"))


@query("distribution_histogram", _histogram_sql("enriched", "duration", 60, None), "enriched")
def distribution_histogram(t: Inputs) -> DataFrame:
    _, bins = reports.distribution_summary(t.logs, "duration")
    return bins.withColumn("bin_start", F.round("bin_start", 9))


@query("fp_reduction", f"""
SELECT b AS fp_before, a AS fp_after, round((b - a) / greatest(b, 1) * 100, 4) AS reduction_pct FROM (
  SELECT count(*) FILTER (is_anomaly AND NOT (event_type IN ({ATTACKS}))) AS b,
    count(*) FILTER (is_anomaly AND NOT (event_type IN ({ATTACKS})) AND NOT suppress) AS a FROM evaluated)""", "evaluated")
def fp_reduction(t: Inputs) -> DataFrame:
    return reports.fp_reduction(t.evaluated)


@query("score_vs_confidence", f"""
SELECT id, confidence, threat_score, CASE WHEN event_type IN ({ATTACKS}) THEN 'True Attack' ELSE 'False Positive' END AS class
FROM scored WHERE is_anomaly""", "scored")
def score_vs_confidence(t: Inputs) -> DataFrame:
    return reports.score_vs_confidence(t.scored)


# ================================================================ streams
@query("stream_alert_retention", f"{ALERT_SQL} ORDER BY secs DESC, alerts.id DESC LIMIT 500", "alerts", parsed=True)
def stream_alert_retention(t: Inputs) -> DataFrame:
    """The alerts kept by the compaction that follows the flow."""
    return _alerts_shown(retention.kept_alerts(t.spark, _streamed(t)))


@query("stream_latency", whole("""SELECT count(*) + 1 AS input_rows, true AS one_bin_per_batch, true AS mean_in_range,
  true AS p95_in_range FROM raw""", "input_rows"), "raw")
def stream_latency(t: Inputs) -> DataFrame:
    """What must hold of the latency figures: every line counted once, every batch in one bin, figures inside the range."""
    rows = progress.progress_rows(t.spark, f"{_streamed(t)}/progress")
    summary, bins = progress.latency(rows)
    told = rows.agg(F.sum("input_rows").alias("input_rows"), F.count("*").alias("batches"),
                    F.min("batch_ms").alias("low"), F.max("batch_ms").alias("high")).first()
    low, high = F.lit(told["low"]), F.lit(told["high"])
    return summary.select(
        F.lit(told["input_rows"]).cast("long").alias("input_rows"),
        F.lit(bins.agg(F.sum("n")).first()[0] == told["batches"]).alias("one_bin_per_batch"),
        F.col("mean").between(low, high).alias("mean_in_range"), F.col("p95").between(low, high).alias("p95_in_range"))


@query("stream_process_logs", """
SELECT CAST(id AS VARCHAR) AS id, timestamp_utc AS timestamp, src_ip, is_anomaly, severity, threat_score FROM scored""", "scored", parsed=True)
def stream_process_logs(t: Inputs) -> DataFrame:
    return t.spark.read.parquet(f"{_streamed(t)}/logs").select(
        "id", "timestamp", "src_ip", "is_anomaly", "severity", "threat_score")


@query("stream_correlation_cooldown", "SELECT id AS log_id, severity, repeat_count FROM alerts", "alerts", parsed=True)
def stream_correlation_cooldown(t: Inputs) -> DataFrame:
    return t.spark.read.parquet(f"{_streamed(t)}/alerts").select(
        "log_id", "severity", F.col("factors.repeat_count").alias("repeat_count"))


@query("stream_stats", whole("""
SELECT count(*) AS total_logs, sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS anomalies, sum(rule_hits) AS suppressed,
  sum(CASE WHEN suppress THEN 1 ELSE 0 END) AS suppressed_rows, sum(peak_adjusted) AS adjusted FROM evaluated""", "anomalies", "suppressed", "suppressed_rows", "adjusted"), "evaluated", parsed=True)
def stream_stats(t: Inputs) -> DataFrame:
    lines = t.path("lines")
    for n, part in enumerate(_stretches(t)):
        part.write.text(f"{lines}/{n:02}")
    logs = _stream_events(t, f"{lines}/*").filter("id >= 0")
    counters = flow.stream_stats(context.evaluate_context(logs))
    path = t.path("counters")
    writer = (counters.writeStream.outputMode("complete").trigger(availableNow=True)
              .option("checkpointLocation", t.path("counters-state"))
              .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)))
    writer.start().awaitTermination()
    return t.spark.read.parquet(path)


@query("session_counts", """
SELECT src_ip, min(secs) AS first_seconds, max(secs) AS last_seconds, count(*) AS events
FROM numbered GROUP BY src_ip, session_no""", "numbered")
def session_counts(t: Inputs) -> DataFrame:
    live = t.evaluated.filter(scoring.gate().isNull()).select("id", "src_ip", "ts")
    return correlation.gap_sessions(live).select(
        "src_ip", F.unix_seconds("first_ts").alias("first_seconds"),
        F.unix_seconds("last_ts").alias("last_seconds"), "events")


@query("stream_late_rows", """
SELECT CAST(id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS copies FROM points WHERE gate IS NULL AND id % 50 = 7""",
       "points", parsed=True)
def stream_late_rows(t: Inputs) -> DataFrame:
    """Every 50th log arrives days late: what is live of it is set apart, and nothing else.

    Logs whose time cannot be read take the given ingest time, which is as late.
    """
    return flow.late_rows(t.spark, _streamed(t, "id % 50 = 7")).select("id", "copies")
