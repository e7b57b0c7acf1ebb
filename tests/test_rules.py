import pytest
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.operators import context, response, scoring

CONTEXT = "hour_of_day int, src_ip string, dst_ip string, bytes_sent double, event_type string, " \
          "traffic_direction string, is_anomaly boolean, anomaly_score double, confidence double"


def judge(spark, *rows):
    return context.evaluate_context(spark.createDataFrame(list(rows), CONTEXT)).collect()


def test_context_goldens(spark):
    ext, internal = "203.0.113.50", "10.0.1.50"
    got = judge(
        spark,
        (10, "10.0.0.50", ext, 500.0, "connection", "outbound", False, 0.1, 0.0),
        (3, "10.0.0.50", ext, 500.0, "connection", "outbound", True, -0.2, 0.3),
        (10, "10.0.0.1", internal, 500.0, "connection", "internal", True, -0.15, 0.4),
        (12, ext, internal, 500.0, "port_scan", "inbound", True, -0.5, 0.8),
        (3, "10.0.0.1", "10.0.1.5", 500.0, "connection", "internal", True, -0.15, 0.3))
    shown = [(r["suppress"], r["context_flags"], r["context_reason"], r["adjusted_score"], r["rule_hits"]) for r in got]
    assert shown == [
        (False, [], "Not an anomaly", 0.1, 0),
        (True, ["maintenance_window"], K.REASON_MAINTENANCE, -0.2, 1),
        (True, ["whitelisted_ip", "peak_hours"], K.REASON_WHITELIST, -0.105, 1),
        (False, ["peak_hours"], K.REASON_CONFIRMED, -0.35, 0),
        (True, ["maintenance_window", "whitelisted_ip", "internal_traffic"], K.REASON_INTERNAL, -0.15, 3)]


def test_context_boundaries(spark):
    def row(hour, dst="8.8.8.8", sent=1.0, event="ddos", confidence=0.3):
        return (hour, "9.9.9.9", dst, sent, event, "outbound", True, -0.2, confidence)
    got = judge(spark, row(2), row(5), row(9), row(17), row(20, "10.0.100.7", 50000.0), row(20, "10.0.100.7", 50001.0),
                row(20, "10.0.100.7", 50001.0, "brute_force"), row(3, confidence=0.5))
    assert [(r["suppress"], r["context_flags"]) for r in got] == [
        (True, ["maintenance_window"]), (False, []), (False, ["peak_hours"]), (False, []),
        (False, ["backup_traffic"]), (True, ["backup_traffic"]), (False, ["backup_traffic"]),
        (False, ["maintenance_window"])]


def test_suppression_stats_count_hits_and_rows(spark):
    df = context.evaluate_context(spark.createDataFrame(
        [(3, "10.0.0.1", "10.0.1.5", 1.0, "x", "internal", True, -0.15, 0.3)], CONTEXT))
    assert context.suppression_stats(df).first().asDict() == {
        "total_evaluated": 1, "suppressed": 3, "suppressed_rows": 1, "adjusted": 0, "suppression_rate": 300.0}
    assert context.suppression_stats(df.limit(0)).first()["suppression_rate"] == 0.0


SCORE = "id long, ts timestamp, src_ip string, dst_ip string, dst_port int, bytes_sent double, duration double, " \
        "log_level string, event_type string, message string, is_anomaly boolean, anomaly_score double, " \
        "confidence double, suppress boolean, context_reason string, context_flags array<string>"


def scored(spark, *rows):
    from datetime import datetime, timedelta, timezone
    base = datetime(2024, 1, 1, 1, 0, 0, tzinfo=timezone.utc)
    data = [(i, base + timedelta(seconds=r[0]), *r[1:]) for i, r in enumerate(rows)]
    return scoring.threat_score(spark.createDataFrame(data, SCORE))


def exfiltration(at, flags=()):
    return (at, "203.0.113.50", "10.0.1.100", 4444, 200000.0, 0.005, "CRITICAL", "data_exfiltration",
            "unauthorized exfiltration exploit", True, -0.7, 0.9, False, "", list(flags))


def scan(at):
    return (at, "1.2.3.4", "10.0.1.1", 80, 100.0, 1.0, "WARNING", "port_scan", "scan detected",
            True, -0.3, 0.5, False, "", [])


def test_score_goldens(spark):
    got = scored(spark, exfiltration(0), exfiltration(4000, ["peak_hours"])).orderBy("id").collect()
    assert [(r["threat_score"], r["severity"]) for r in got] == [(81, "CRITICAL"), (68, "HIGH")]
    f = got[1]["factors"]
    assert (f["ml_anomaly_base"], f["feature_modifiers"], f["keyword_risk"], f["event_correlation"],
            f["attack_pattern_bonus"], f["peak_hours_reduction"]) == (31, 25, 15, 0, 10, True)
    assert (f["high_bytes_sent"], f["suspicious_port"], f["rapid_connection"]) == (200000.0, 4444, 0.005)


def test_correlation_goldens(spark):
    got = scored(spark, *[scan(60 * i) for i in range(5)]).orderBy("id").collect()
    assert [(r["threat_score"], r["severity"]) for r in got] == [
        (25, "LOW"), (30, "MEDIUM"), (35, "MEDIUM"), (35, "MEDIUM"), (40, "MEDIUM")]


def test_gap_boundary(spark):
    got = scored(spark, scan(0), scan(300), scan(601)).orderBy("id").collect()
    assert [r["repeat_count"] for r in got] == [1, 2, 1]


def test_quiet_rows(spark):
    suppressed = scan(0)[:12] + (True, "why", [])
    normal = scan(0)[:9] + (False, 0.1, 0.0, False, "", [])
    got = scored(spark, suppressed, normal).orderBy("id").collect()
    assert [(r["threat_score"], r["severity"], r["factors"]["reason"]) for r in got] == [
        (0, "SUPPRESSED", "why"), (0, "NORMAL", None)]


@pytest.mark.parametrize("score,level", [(0, "LOW"), (25, "LOW"), (26, "MEDIUM"), (50, "MEDIUM"),
                                         (51, "HIGH"), (75, "HIGH"), (76, "CRITICAL"), (100, "CRITICAL")])
def test_severity(spark, score, level):
    assert spark.range(1).select(scoring.severity_of(F.lit(score))).first()[0] == level


@pytest.mark.parametrize("severity,kinds", [
    ("LOW", ["log_event"]), ("MEDIUM", ["generate_alert", "increase_monitoring"]),
    ("HIGH", ["generate_alert", "block_ip", "notify_soc"]),
    ("CRITICAL", ["generate_alert", "block_ip", "isolate_node", "escalate"]), ("NORMAL", [])])
def test_actions(spark, severity, kinds):
    df = spark.createDataFrame([(severity, "1.1.1.1", "2.2.2.2")], "severity string, src_ip string, dst_ip string")
    actions = df.select(response.response_actions().alias("a")).first()["a"]
    assert [a["type"] for a in actions] == kinds
    targets = {a["type"]: a["target"] for a in actions}
    assert targets.get("isolate_node", "2.2.2.2") == "2.2.2.2"
    assert targets.get("escalate", "SOC_LEAD") == "SOC_LEAD" and targets.get("notify_soc", "SOC_TEAM") == "SOC_TEAM"


def test_alert_page_limits(spark):
    with pytest.raises(ValueError):
        response.recent_alerts(spark.range(1), 0)
    with pytest.raises(ValueError):
        response.recent_alerts(spark.range(1), 501)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_whitelist_table(spark, limit):
    from tidewatch.operators.whitelist import with_listed
    table = spark.createDataFrame([(e,) for e in (
        "10.0.0.7", " 10.0.0.8 ", "10.9.", "172.16.4.", "192.168.128.0/17", "8.8.8.8/32", "0.0.0.0/33", "", None, "host-a",
        "10.0.0.7", "11.0.0.0/08")], "entry string")
    rows = [("10.0.0.7", "x", True), ("10.0.0.70", "x", False), ("x", "10.0.0.8", True), ("10.9.255.1", None, True),
            ("10.90.1.1", "172.16.4.3", True), ("172.16.40.3", "172.16.4", False), ("192.168.127.255", "192.168.128.0", True),
            ("192.168.255.255", None, True), ("192.168.127.1", "", False), ("8.8.8.8", "10.9.1.1", True), (None, None, False),
            ("host-a", "", True), ("192.168.300.1", "192.168.128.01", False), ("", "", False)]
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows * 2)],
                                  "id int, src_ip string, dst_ip string, want boolean")
    found = with_listed(frame, table, broadcast_entries=limit)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (limit == 0) and ("BroadcastHashJoin" in plan) == (limit > 0)
    got = found.collect()
    assert len(got) == 2 * len(rows) and [r for r in got if r["_listed"] != r["want"]] == []
    empty = with_listed(frame, table.limit(0), broadcast_entries=limit)
    assert empty.filter("_listed").count() == 0 and empty.count() == 2 * len(rows)
