"""A stream cut into several batches, out of order inside the delay, gives the batch result."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row, functions as F

from tidewatch.operators import context, enrich, scoring, validate
from tidewatch.operators.correlation import gap_sessions, stream_session_counts
from tidewatch.plans import detection
from tidewatch.sources.logs import read_log_text, stream_log_text
from tidewatch.operators.response import alert_retention, create_alerts
from tidewatch.sources import sinks
from tidewatch.streaming import flow, progress, retention
from tidewatch.streaming.processor import AddressProcessor, AddressState
from verification import queries

BASE = datetime(2024, 1, 1, 20, 0, tzinfo=timezone.utc)
FAR = datetime(2024, 1, 9, tzinfo=timezone.utc)


def line(i, at, ip, score):
    kinds = ["port_scan", "brute_force", "ddos", "data_exfiltration", "connection"]
    stamp = at.isoformat()
    return json.dumps({
        "id": str(i), "timestamp": stamp, "src_ip": ip, "dst_ip": "10.0.1.9", "src_port": 50000 + i % 9,
        "dst_port": [4444, 22, 443][i % 3], "protocol": "TCP", "bytes_sent": 100 * (i % 2000),
        "bytes_recv": 1, "duration": 0.001 * (i % 30), "event_type": kinds[i % 5],
        "log_level": ["INFO", "ERROR", "CRITICAL"][i % 3], "message": f"scan from score={score}"})


def write_files(root, n, files):
    """Events in rising time, shuffled inside short stretches, plus broken lines and a closing event."""
    rng = random.Random(5)
    at, events = BASE, []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 5, 20, 90]))
        ip = "203.0.113.50" if rng.random() < 0.5 else f"198.51.100.{rng.randrange(6)}"
        events.append((at, line(i, at, ip, rng.choice([-0.3, -0.1, -0.45, 0.1]))))
    for start in range(0, n, 4):
        part = events[start:start + 4]
        if part[-1][0] - part[0][0] < timedelta(seconds=100):
            rng.shuffle(part)
            events[start:start + 4] = part
    lines = [text for _, text in events]
    lines.insert(3, "{broken")
    size = -(-len(lines) // files)
    root.mkdir()
    for f in range(files):
        (root / f"part-{f:03}.txt").write_text("\n".join(lines[f * size:(f + 1) * size]) + "\n")
    # moves the watermark past everything else; stays buffered itself
    (root / f"part-{files:03}.txt").write_text(line(n, FAR, "192.0.2.1", -0.4) + "\n")
    import os
    for f in range(files + 1):
        os.utime(root / f"part-{f:03}.txt", (1_700_000_000 + f, 1_700_000_000 + f))


def predicted(logs):
    """Stand-in for the model: the score written in the message."""
    score = F.regexp_extract("message", r"score=(-?[0-9.]+)", 1).cast("double")
    return logs.withColumns({
        "anomaly_score": score, "is_anomaly": score < 0,
        "confidence": F.when(score < 0, F.round(F.least(-score / 0.5, F.lit(1.0)), 4)).otherwise(0.0)})


def batch_run(spark, path):
    valid, _ = validate.split_valid(validate.parse_logs(read_log_text(spark, path)))
    logs = predicted(enrich.enrich_logs(valid)).filter(F.col("ts") < F.lit(FAR))
    logs = logs.withColumn("id", F.col("id").cast("int"))
    return detection.detect(logs, staged=False, blocks=5)


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    write_files(source, 400, 5)
    raw = stream_log_text(spark, str(source), max_files=1)
    scored = flow.score_stream(predicted(flow.enriched_stream(raw)), delay="200 seconds")
    out = str(tmp_path / "out")
    flow.start(scored, out, str(tmp_path / "state")).awaitTermination()

    run = batch_run(spark, str(source))
    want = {(r["log_id"], r["severity"], r["threat_score"], r["factors"]["repeat_count"])
            for r in run.alerts().collect()}
    got = [(int(r["log_id"]), r["severity"], r["threat_score"], r["factors"]["repeat_count"])
           for r in spark.read.parquet(f"{out}/alerts").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    logs = {(int(r["id"]), r["severity"], r["threat_score"]) for r in spark.read.parquet(f"{out}/logs").collect()}
    assert logs == {(r["id"], r["severity"], r["threat_score"]) for r in run.scored().collect()}
    total = spark.read.parquet(f"{out}/stats").agg(F.sum("logs"), F.sum("alerts")).first()
    assert tuple(total) == (400, len(want))


def test_shared_logs_are_parsed_once(spark, tmp_path):
    """Live and quiet rows come from one reading of the lines, and are the same rows."""
    source = tmp_path / "in"
    write_files(source, 120, 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        logs = predicted(flow.enriched_stream(read_log_text(spark, str(source)), F.lit(BASE), shared=True))
        evaluated = context.evaluate_context(logs)
        both = scoring.live_rows(evaluated).unionByName(scoring.quiet_rows(evaluated), allowMissingColumns=True)
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan text") == 1 and "ReusedExchange" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = []
    for shared in (False, True):
        raw = stream_log_text(spark, str(source), max_files=1)
        out = str(tmp_path / f"out-{shared}")
        query = flow.start(flow.score_stream(predicted(flow.enriched_stream(raw, shared=shared)), "200 seconds"), out,
                           str(tmp_path / f"state-{shared}"))
        query.awaitTermination()
        assert sum(told["numInputRows"] for told in query.recentProgress) > 0
        found.append(sorted(tuple(r) for r in spark.read.parquet(f"{out}/logs").drop("batch_id").collect()))
    assert found[0] == found[1] and len(found[0]) == 120


def test_equal_rows_without_id_are_all_kept(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    same = json.loads(line(0, BASE, "203.0.113.9", -0.3))
    del same["id"]
    other = dict(same, dst_port=23)
    (source / "a.txt").write_text("\n".join(map(json.dumps, [same, same, other, same])) + "\n")
    (source / "b.txt").write_text(json.dumps(same) + "\n")
    (source / "c.txt").write_text(line(8, FAR, "192.0.2.1", -0.3) + "\n")
    import os
    for n, name in enumerate("abc"):
        os.utime(source / f"{name}.txt", (1_700_000_000 + n, 1_700_000_000 + n))
    scored = flow.score_stream(predicted(flow.enriched_stream(stream_log_text(spark, str(source), 1))), "200 seconds")
    out = str(tmp_path / "out")
    flow.start(scored, out, str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(f"{out}/logs").filter("src_ip = '203.0.113.9'").collect()
    assert len(rows) == 5 and {r["id"] for r in rows} == {""}
    assert spark.read.parquet(f"{out}/alerts").count() >= 1


def test_running_counters(spark, tmp_path):
    source = tmp_path / "in"
    write_files(source, 60, 3)
    evaluated = context.evaluate_context(predicted(flow.enriched_stream(stream_log_text(spark, str(source), 1))))
    (flow.stream_stats(evaluated).writeStream.outputMode("complete").format("memory").queryName("counters")
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
    row = spark.table("counters").first()
    assert row["total_logs"] == 61 and 0 < row["anomalies"] < 61


def test_session_window_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    write_files(source, 200, 4)
    logs = flow.enriched_stream(stream_log_text(spark, str(source), 1))
    counts = stream_session_counts(logs.select("src_ip", "ts").withWatermark("ts", "200 seconds"))
    (counts.writeStream.outputMode("append").format("memory").queryName("sessions")
           .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
    got = sorted((r["src_ip"], r["start"], r["events"]) for r in
                 spark.table("sessions").selectExpr("src_ip", "unix_micros(session.start) start", "events").collect())
    valid, _ = validate.split_valid(validate.parse_logs(read_log_text(spark, str(source))))
    events = enrich.enrich_logs(valid).filter(F.col("ts") < F.lit(FAR)).select("id", "src_ip", "ts")
    want = sorted((r["src_ip"], r["start"], r["events"]) for r in
                  gap_sessions(events).selectExpr("src_ip", "unix_micros(first_ts) start", "events").collect())
    assert got == want


def test_state_step():
    state = AddressState()
    steps = [state.step(int(t * 1e6), 25, False) for t in (0, 300, 601, 661, 721)]
    # LOW waits 300 s, two events in a session make it MEDIUM and wait 120 s
    assert steps == [(1, True), (2, True), (1, True), (2, False), (3, True)]


def write_lines(source, groups):
    """One file, so one batch, per group of lines."""
    import os
    source.mkdir()
    for n, group in enumerate(groups):
        path = source / f"{n:03}.txt"
        path.write_text("\n".join(group) + "\n")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def run_flow(spark, tmp_path, delay):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    flow.start_intake(stream_log_text(spark, source, 1), out, str(tmp_path / "intake")).awaitTermination()
    scored = flow.score_stream(predicted(flow.enriched_stream(stream_log_text(spark, source, 1))), delay)
    flow.start(scored, out, str(tmp_path / "state")).awaitTermination()
    return out


def test_late_rows_are_kept_apart(spark, tmp_path):
    at = [line(n, BASE + timedelta(seconds=t), "203.0.113.9", -0.3) for n, t in enumerate((0, 1000, 2000))]
    late = line(7, BASE + timedelta(seconds=10), "203.0.113.9", -0.3)
    more = [[line(20 + n, BASE + timedelta(seconds=2500 + 500 * n), "203.0.113.9", -0.3)] for n in range(3)]
    write_lines(tmp_path / "in", [[at[0]], [at[1]], [at[2]], [late, late, "{broken"], *more,
                                  [line(8, FAR, "192.0.2.1", -0.3)]])
    out = run_flow(spark, tmp_path, "60 seconds")
    ids = sorted(r["id"] for r in spark.read.parquet(f"{out}/logs").filter("src_ip = '203.0.113.9'").collect())
    assert ids == ["0", "1", "2", "20", "21", "22"]
    assert [(r["id"], r["copies"]) for r in flow.late_rows(spark, out).collect()] == [("7", 2)]
    assert spark.read.parquet(f"{out}/received").count() == 9
    assert [r["value"] for r in spark.read.parquet(f"{out}/rejected").collect()] == ["{broken"]


def test_bad_and_future_times_do_not_make_others_late(spark, tmp_path):
    def stamped(i, stamp):
        return json.dumps(dict(json.loads(line(i, BASE, "203.0.113.9", -0.3)), timestamp=stamp))
    groups = [[line(0, BASE, "203.0.113.9", -0.3)], [stamped(1, "no time"), stamped(2, "2999-01-01T00:00:00Z")]]
    groups += [[line(10 + n, BASE + timedelta(seconds=400 * n), "203.0.113.9", -0.3)] for n in range(1, 7)]
    write_lines(tmp_path / "in", [*groups, [line(8, FAR, "192.0.2.1", -0.3)]])
    out = run_flow(spark, tmp_path, "60 seconds")
    ids = {r["id"] for r in spark.read.parquet(f"{out}/logs").filter("src_ip = '203.0.113.9'").collect()}
    assert ids == {"0", *(str(10 + n) for n in range(1, 7))}  # the other two wait for their time to come
    assert flow.late_rows(spark, out).count() == 0
    totals = spark.read.parquet(f"{out}/totals")
    last = totals.filter(F.col("batch_id") == totals.agg(F.max("batch_id")).first()[0])
    stats = spark.read.parquet(f"{out}/stats")
    names = ["logs", "alerts", "actions", "in_cooldown", "rule_hits"]
    assert last.agg(*[F.sum(n) for n in names]).first() == stats.agg(*[F.sum(n) for n in names]).first()
    assert last.agg(F.sum("actions")).first()[0] == spark.read.parquet(f"{out}/actions").count() > 0


class FakeState:
    """State of one address in memory, counting what is read."""

    def __init__(self):
        self.maps, self.values, self.timers, self.reads = {}, {}, set(), 0

    def getMapState(self, name, *_):
        owner, held = self, self.maps.setdefault(name, {})

        class Map:
            def containsKey(self, key):
                return key in held

            def getValue(self, key):
                value = held[key]
                owner.reads += len(value[0]) if isinstance(value[0], list) else 1
                return value

            def updateValue(self, key, value):
                held[key] = value

            def removeKey(self, key):
                del held[key]
        return Map()

    def getValueState(self, name, *_):
        held = self.values

        class Value:
            def exists(self):
                return name in held

            def get(self):
                return held[name]

            def update(self, value):
                held[name] = value

            def clear(self):
                held.pop(name, None)
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def live(us, row_id, clock=True):
    return Row(src_ip="a", clock=us if clock else None, us=us, id=row_id, points=30, peak=False, payload=Row(n=1))


def test_a_timer_reads_released_rows_only():
    state, processor = FakeState(), AddressProcessor("struct<n:int>")
    processor.init(state)
    waiting = [live(10_000_000 + k * 1_000_000, str(k)) for k in range(100_000)]  # a bucket each
    assert not list(processor.handleInputRows(("a",), iter(waiting[50_000:]), Clock(0)))
    assert not list(processor.handleInputRows(("a",), iter(waiting[:50_000]), Clock(0)))
    assert not list(processor.handleInputRows(("a",), iter([live(10_500_000, "x")]), Clock(0)))
    state.reads = 0
    out = list(processor.handleExpiredTimer(("a",), Clock(11_000), Clock(11_000)))
    assert [(r.id, r.repeat_count, r.passed) for r in out] == [("0", 1, True), ("x", 2, False)]
    assert state.reads == 3  # the number of parts, and a row in each of two
    assert len(state.maps["waiting"]) == 99_999


def test_late_rows_and_rows_without_a_clock():
    state, processor = FakeState(), AddressProcessor("struct<n:int>")
    processor.init(state)
    out = list(processor.handleInputRows(("a",), iter(
        [live(4_999_999, "late"), live(5_000_000, "on time"), live(1_000_000, "no clock", False)]), Clock(5000)))
    assert [(r.id, r.late, r.repeat_count) for r in out] == [("late", True, None)]
    out = list(processor.handleExpiredTimer(("a",), Clock(6000), Clock(6000)))
    assert [(r.id, r.us, r.repeat_count) for r in out] == [("no clock", 1_000_000, 1), ("on time", 5_000_000, 2)]
    idle, = state.timers - {6000}
    assert idle % 1000 == 1 and 305_000 < idle < 307_000 and state.values
    list(processor.handleExpiredTimer(("a",), Clock(idle), Clock(idle)))
    assert not state.values


def test_a_batch_counts_when_all_its_sinks_are_written(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    write_files(source, 80, 3)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        raw = stream_log_text(spark, str(source), 1)
        flow.start(flow.score_stream(predicted(flow.enriched_stream(raw)), "200 seconds"), out, state).awaitTermination()

    written, write = [], flow.overwrite_batch

    def failing(rows, path, batch_id):
        if batch_id == 1 and path.endswith("actions"):
            raise RuntimeError("no space")
        written.append((path, batch_id))
        write(rows, path, batch_id)
    monkeypatch.setattr(flow, "overwrite_batch", failing)
    with pytest.raises(Exception, match="no space"):
        run()
    assert (f"{out}/alerts", 1) in written  # written, yet not to be seen
    for sink in ("logs", "alerts"):
        assert {r["batch_id"] for r in sinks.read_committed(spark, out, sink).collect()} <= {0}
    monkeypatch.setattr(flow, "overwrite_batch", write)
    run()
    logs, alerts = (sinks.read_committed(spark, out, sink) for sink in ("logs", "alerts"))
    assert logs.count() == 80 == logs.select("id").distinct().count()
    assert sinks.read_committed(spark, out, "actions").select("alert_id").distinct().count() == alerts.count() > 0


def test_retention_takes_new_batches_only(spark, tmp_path):
    root = str(tmp_path)
    rows = [(i, f"10.0.0.{i % 9}", BASE + timedelta(seconds=i * 7 % 101), ["LOW", "HIGH"][i % 2]) for i in range(60)]
    alerts = create_alerts(spark.createDataFrame(rows, "id long, src_ip string, ts timestamp, severity string").selectExpr(
        "*", "1 threat_score", "src_ip dst_ip", "'x' event_type", "'' message", "0D anomaly_score", "0D confidence",
        "named_struct('a', 1) factors")).cache()

    def batch(n):
        sinks.overwrite_batch(alerts.filter(f"log_id % 4 = {n}"), f"{root}/alerts", n)

    def kept():
        return [r["log_id"] for r in retention.kept_alerts(spark, root).orderBy(F.desc("ts"), F.desc("log_id")).collect()]

    def want(batches):
        held = alerts.filter(F.col("log_id") % 4 < batches)
        return [r["log_id"] for r in alert_retention(held, 20).collect()]

    for n in range(4):
        batch(n)
        sinks.commit_batch(spark, root, n, flow.SINKS)
        assert retention.retain_alerts(spark, root, 20) == n
        assert kept() == want(n + 1)
    batch(2)  # a repeated batch
    sinks.commit_batch(spark, root, 2, flow.SINKS)
    assert retention.retain_alerts(spark, root, 20) == 3 and kept() == want(4)
    alerts.limit(0).write.parquet(f"{root}/kept/upto=4")  # left by a step that failed before its log
    batch(0)
    sinks.overwrite_batch(alerts.limit(0), f"{root}/alerts", 4)
    sinks.commit_batch(spark, root, 4, flow.SINKS)
    assert retention.retain_alerts(spark, root, 20) == 4 and kept() == want(4)


def test_progress_becomes_a_table(spark, tmp_path):
    source = tmp_path / "in"
    write_files(source, 30, 4)
    told = progress.ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(told)
    try:
        query = flow.start_intake(stream_log_text(spark, str(source), 1), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        assert told.wait(query)
    finally:
        spark.streams.removeListener(told)
    rows = progress.progress_rows(spark, str(tmp_path / "progress"))
    found = sorted((r["batch_id"], r["input_rows"]) for r in rows.collect())
    assert [n for n, _ in found] == list(range(5)) and sum(n for _, n in found) == 32
    summary, bins = progress.latency(rows, 10)
    times = sorted(r["batch_ms"] for r in rows.collect())
    assert times[0] <= summary.first()["mean"] <= times[-1] and bins.agg(F.sum("n")).first()[0] == 5


def test_long_buckets_and_payload_as_text_give_the_same_rows(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    write_files(source, 80, 3)
    seen = []
    monkeypatch.setattr("tidewatch.streaming.processor.AddressProcessor", lambda payload, bucket_ms: (
        seen.append((payload, bucket_ms)), AddressProcessor(payload, bucket_ms))[1])
    found = []
    for bucket_ms in (1000, 600_000):
        out = str(tmp_path / f"out{bucket_ms}")
        stream = predicted(flow.enriched_stream(stream_log_text(spark, str(source), 1)))
        flow.start(flow.score_stream(stream, "60 seconds", bucket_ms=bucket_ms), out,
                   str(tmp_path / f"state{bucket_ms}")).awaitTermination()
        found.append(sorted((r["id"], r["timestamp"], r["message"], r["severity"], r["threat_score"])
                            for r in spark.read.parquet(f"{out}/logs").collect()))
    assert found[0] == found[1] and len(found[0]) > 40
    assert seen == [("string", 1000), ("string", 600_000)]  # a row's other columns are one text in the state


def test_a_given_ingest_time_behind_the_watermark_is_late(spark, tmp_path):
    broken = json.dumps(dict(json.loads(line(7, BASE, "203.0.113.9", -0.3)), timestamp="no time"))
    write_lines(tmp_path / "in", [[line(0, BASE + timedelta(seconds=2000), "203.0.113.9", -0.3)], [broken],
                                  [line(8, FAR, "192.0.2.1", -0.3)]])
    logs = predicted(flow.enriched_stream(stream_log_text(spark, str(tmp_path / "in"), 1), F.lit(BASE)))
    out = str(tmp_path / "out")
    flow.start(flow.score_stream(logs, "60 seconds"), out, str(tmp_path / "state")).awaitTermination()
    assert [(r["id"], r["copies"]) for r in flow.late_rows(spark, out).collect()] == [("7", 1)]
    assert "7" not in {r["id"] for r in spark.read.parquet(f"{out}/logs").collect()}


def test_lines_are_cut_into_stretches_without_validation(spark, tmp_path, monkeypatch):
    """All lines are there once, by rising time; only the stream itself validates them."""
    kinds = ["click", "view", "signup", "purchase", "error"]
    events = [(i, datetime(2024, 1, 1) + timedelta(minutes=37 * (i % 251)), i % 40, kinds[i % 5], 1.5) for i in range(400)]
    spark.createDataFrame([*events, *events[:9]], "event_id long, ts timestamp, user_id long, event_type string, value double") \
        .write.parquet(str(tmp_path / "events.parquet"))
    inputs = queries.Inputs(spark, str(tmp_path))
    raw = Counter(r.value for r in inputs.raw.select("value").collect())
    monkeypatch.setattr(validate, "parse_logs", lambda *_: 1 / 0)
    *stretches, closing = [[r.value for r in part.collect()] for part in queries._stretches(inputs)]
    assert Counter(line for part in stretches for line in part) == raw and len(closing) == 1
    plain = [{json.loads(line)["timestamp"][:19].replace("T", " ") for line in part if '+00:00"' in line} for part in stretches]
    assert all(max(a) < cut <= min(b) for a, cut, b in zip(plain, queries._CUTS, plain[1:]))
