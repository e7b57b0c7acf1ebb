import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import enrich, features, validate
from tidewatch.sources.logs import read_log_json, read_log_text

GOOD = {
    "timestamp": "2026-02-19T12:00:00+00:00", "src_ip": "10.0.0.50", "dst_ip": "203.0.113.50",
    "src_port": 50000, "dst_port": 443, "protocol": "TCP", "bytes_sent": 500, "bytes_recv": 1200,
    "duration": 0.5, "event_type": "connection", "log_level": "INFO",
    "message": "Normal connection established"}


def without(*names):
    return {k: v for k, v in GOOD.items() if k not in names}


CASES = [
    (GOOD, "OK"),
    (without("src_ip"), "Missing required field: src_ip"),
    (without("timestamp", "message"), "Missing required field: timestamp"),
    ({**GOOD, "bytes_sent": "x"}, "bytes_sent must be numeric"),
    ({**GOOD, "bytes_sent": None}, "bytes_sent must be numeric"),
    ({**GOOD, "bytes_sent": 1.5, "bytes_recv": 1e300}, "OK"),
    ({**GOOD, "duration": True}, "duration must be numeric"),
    ({**GOOD, "dst_port": 443.0}, "dst_port must be integer"),
    ({**GOOD, "dst_port": 2**40}, "dst_port must be integer"),
    ({**GOOD, "src_port": "80", "dst_port": 1.5}, "src_port must be integer"),
    ({**GOOD, "protocol": None}, "OK"),
    ({**GOOD, "src_ip": None}, "src_ip must be string"),
    ({}, "Missing required field: timestamp"),
]


def frame(spark, docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "n int, value string")


def test_validation_reasons(spark):
    got = validate.validate_types(frame(spark, [c[0] for c in CASES])).orderBy("n").collect()
    assert [r["reason"] for r in got] == [c[1] for c in CASES]


def test_broken_json_is_not_a_log(spark):
    df = spark.createDataFrame([("{not json",), ("[1, 2]",)], "value string")
    reasons = {r["reason"] for r in validate.validate_types(df).collect()}
    assert reasons == {"Missing required field: timestamp"}


def test_batch_keeps_valid_rows_and_quarantines_the_rest(spark):
    docs = [GOOD] * 9 + [without("timestamp")]
    valid, rejected = validate.split_valid(validate.parse_logs(frame(spark, docs)))
    assert valid.count() == 9 and rejected.count() == 1
    row = valid.first()
    assert row["src_port"] == 50000 and row["bytes_sent"] == 500.0 and row["id"] is None


def test_edge_coercion(spark):
    docs = [GOOD, {**GOOD, "src_port": "80", "dst_port": 443.0}, {**GOOD, "dst_port": 1.5},
            {**GOOD, "bytes_sent": None, "message": 7}, {"bad": "data"}]
    got = validate.coerce_log_schema(frame(spark, docs)).orderBy("n").collect()
    assert [r["rejected_fields"] for r in got[:4]] == [None, None, "dst_port", "bytes_sent,message"]
    assert (got[1]["src_port"], got[1]["dst_port"]) == (80, 443)
    assert got[4]["rejected_fields"].startswith("timestamp,src_ip")


@pytest.mark.parametrize("text,expected", [
    ("2026-02-19T12:00:00+00:00", "2026-02-19 12:00:00"),
    ("2026-02-19T23:30:00-05:00", "2026-02-20 04:30:00"),
    ("2026-02-19T12:00:00.250000Z", "2026-02-19 12:00:00.25"),
    ("2026-02-19 12:00", "2026-02-19 12:00:00"),
    ("2026-02-19T12", "2026-02-19 12:00:00"),
    ("20260219T120000", "2026-02-19 12:00:00"),
    ("20260219T120000+0530", "2026-02-19 06:30:00"),
    ("2026-02-19", "2026-02-19 00:00:00"),
    ("2026", "2000-01-01 00:00:00"), ("not-a-time", "2000-01-01 00:00:00"),
    ("2026-13-45T00:00:00", "2000-01-01 00:00:00"), (None, "2000-01-01 00:00:00")])
def test_timestamps(spark, text, expected):
    fallback = F.lit("2000-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(C.parse_timestamp(F.col("t"), fallback).cast("string")).first()[0]
    assert got == expected


def test_enrichment(spark):
    rows = [("2026-02-19T12:00:00+00:00", "10.0.0.50", "203.0.113.50", "TCP", "connection", "INFO"),
            ("2026-02-21T00:00:00+00:00", "203.0.113.50", "10.0.1.50", "QUIC", "odd", "odd"),
            ("2026-02-22T23:59:59+00:00", "203.0.113.1", "203.0.113.2", "DNS", "ddos", "CRITICAL"),
            ("2026-02-19T12:00:00+00:00", "172.20.0.1", "172.16.0.1", None, None, None)]
    df = spark.createDataFrame(rows, "timestamp string, src_ip string, dst_ip string, protocol string, "
                                     "event_type string, log_level string").withColumn("extra", F.lit("kept"))
    got = enrich.enrich_logs(df).collect()
    shown = [(r["hour_of_day"], r["is_weekend"], r["protocol_code"], r["event_type_code"],
              r["log_level_code"], r["traffic_direction"], r["extra"]) for r in got]
    assert shown == [(12, 0, 0, 0, 1, "outbound", "kept"), (0, 1, 0, 0, 1, "inbound", "kept"),
                     (23, 1, 4, 7, 4, "internal", "kept"), (12, 0, 0, 0, 1, "inbound", "kept")]
    assert got[0]["timestamp_utc"] == "2026-02-19T12:00:00+00:00"


@pytest.mark.parametrize("text,risk,points", [
    ("normal traffic", 0, 0), (None, 0, 0), ("", 0, 0), ("unauthorized sudo exploit", 14, 14),
    ("Unauthorized sudo access: user gained root via exploit payload", 22, 15),
    ("SCAN scan scanning", 3, 3),
    ("unauthorized exploit malware injection overflow exfiltration", 25, 15),
    ("x" * 200_000 + " sudo", 4, 4)])
def test_keywords(spark, text, risk, points):
    df = spark.createDataFrame([(text,)], "m string")
    assert tuple(df.select(C.keyword_points(F.col("m"), 25), C.keyword_points(F.col("m"), 15)).first()) == (risk, points)


def test_feature_vectors(spark):
    df = spark.createDataFrame([("500", "TCP", "sudo"), ("n/a", "DNS", "ok")],
                               "bytes_sent string, protocol string, message string")
    vectors = [r["features"] for r in features.with_features(df).collect()]
    assert vectors[0] == [0, 0, 500, 0, 0, 0, 0, 1, 4, 12, 0] and vectors[1] is None
    assert features.feature_matrix(df).count() == 1
    wide = features.with_features(df, 21).first()["features"]
    assert wide[11:] == [1, 1, 0, 1, 1, 1, 0.5, 0, 0, 0]
    assert len(features.with_features(df, 15).first()["features"]) == 15
    assert features.feature_matrix(df.limit(0)).count() == 0


def test_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.5,)], "x double")
    assert [r[0] for r in df.select(features.finite(F.col("x"))).collect()] == [0, 1e6, -1e6, 0, 2.5]


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({**GOOD, "id": "7", "other": 1}) + "\n" + json.dumps(without("src_ip")))
    rows = read_log_json(spark, str(tmp_path)).collect()
    assert {r["id"] for r in rows} == {"7", None} and "other" not in rows[0].asDict()
    assert validate.parse_logs(read_log_text(spark, str(tmp_path))).filter("reason = 'OK'").count() == 1
