"""Correlation and cooldown against step-by-step replays, with one very frequent address."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.operators import cooldown
from tidewatch.operators.blocks import with_blocks
from tidewatch.operators.cooldown import alert_cooldown
from tidewatch.operators.correlation import correlate, gap_sessions, ip_history_size

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id long, src_ip string, ts timestamp, severity string"


def history(seed, n, hot_share, step, digits=0):
    """Random events; one address takes ``hot_share`` of them."""
    rng = random.Random(seed)
    clock, rows = {}, []
    for i in range(n):
        ip = "hot" if rng.random() < hot_share else f"ip{rng.randrange(12)}"
        scale = step if ip == "hot" else step * 60
        clock[ip] = clock.get(ip, rng.uniform(0, 3000)) + rng.choice([0, 0.2, 1, 1, 2, 5]) * scale
        rows.append((i, ip, round(clock[ip], digits), rng.choice(list(K.COOLDOWN_SECONDS))))
    rng.shuffle(rows)
    return rows


def replay(rows):
    """Plain replay in (time, id) order: repeat counts and passed ids."""
    repeat, passed, seen, last = {}, set(), {}, {}
    for i, ip, t, severity in sorted(rows, key=lambda r: (r[2], r[0])):
        us = round(t * 1e6)
        count, before = seen.get(ip, (0, None))
        if before is not None and us - before > 300e6:
            count = 0
        seen[ip] = (count + 1, us)
        repeat[i] = count + 1
        if ip not in last or us - last[ip] >= K.COOLDOWN_SECONDS[severity] * 1e6:
            last[ip] = us
            passed.add(i)
    return repeat, passed, sum(c for c, _ in seen.values())


def frame(spark, rows, partitions=4):
    data = [(i, ip, BASE + timedelta(microseconds=round(t * 1e6)), s) for i, ip, t, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


@pytest.mark.parametrize("seed,n,hot,step,digits,blocks,fan", [
    (1, 4000, 0.4, 9, 0, 4, 5), (2, 4000, 0.9, 3, 0, 24, 2), (3, 3000, 0.5, 40, 3, 16, 5),
    (4, 3000, 0.34, 0.4, 6, 40, 5), (5, 2000, 1.0, 17, 2, 13, 1), (6, 3000, 0.95, 0.02, 3, 16, 2)])
def test_sessions_and_cooldown_match_replay(spark, seed, n, hot, step, digits, blocks, fan):
    rows = history(seed, n, hot, step, digits)
    repeat, passed, open_events = replay(rows)
    df = frame(spark, rows)
    counted = correlate(df, blocks)
    assert {r["id"]: r["repeat_count"] for r in counted.select("id", "repeat_count").collect()} == repeat
    assert ip_history_size(counted).first()[0] == open_events
    got = [r["id"] for r in alert_cooldown(df, blocks, fan).select("id").collect()]
    assert len(got) == len(set(got)) and set(got) == passed


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4000), st.sampled_from(list(K.COOLDOWN_SECONDS))), min_size=1, max_size=60),
       st.sampled_from([1, 5, 20]))
def test_cooldown_property(spark, events, blocks):
    rows = [(i, "a" if i % 3 else "b", float(t), s) for i, (t, s) in enumerate(events)]
    _, passed, _ = replay(rows)
    assert {r["id"] for r in alert_cooldown(frame(spark, rows), blocks, 2).select("id").collect()} == passed


def test_cooldown_golden(spark):
    by_wait = {300: "LOW", 120: "MEDIUM", 60: "HIGH", 30: "CRITICAL"}
    table = [("a", 0, 60), ("a", 30, 30), ("a", 59, 60), ("a", 60, 300), ("a", 120, 60), ("b", 5, 30), ("b", 35, 30)]
    rows = [(i, ip, float(t), by_wait[w]) for i, (ip, t, w) in enumerate(table)]
    got = {r["id"] for r in alert_cooldown(frame(spark, rows)).collect()}
    assert got == {0, 1, 4, 5, 6}


def test_result_does_not_depend_on_partitions_or_blocks(spark):
    rows = history(9, 1500, 0.5, 25)
    results = {tuple(sorted(r["id"] for r in alert_cooldown(frame(spark, rows, p), blocks).select("id").collect()))
               for p, blocks in ((1, None), (7, 1), (32, 30))}
    assert len(results) == 1


def burst(n):
    """Nine tenths of all rows on one address within one second, the rest of it a row a second, and other addresses."""
    rng = random.Random(7)
    rows = [(i, "hot", 5000 + rng.randrange(10**6) / 1e6, rng.choice(list(K.COOLDOWN_SECONDS))) for i in range(n * 9 // 10)]
    rows += [(n + i, "hot", float(4000 + i), "CRITICAL") for i in range(n // 20)]
    return rows + [(2 * n + i, f"ip{i % 40}", rng.uniform(0, 9000), "HIGH") for i in range(n // 20)]


def test_burst_of_one_address(spark):
    rows, blocks = burst(20_000), 16
    repeat, passed, _ = replay(rows)
    laid = with_blocks(frame(spark, rows), blocks)
    share = max(r["count"] for r in laid.groupBy("_block").count().collect()) / len(rows)
    assert share < 3 / blocks  # of the rows; the cut points are sampled
    assert {r["id"]: r["repeat_count"] for r in correlate(laid).select("id", "repeat_count").collect()} == repeat
    assert {r["id"] for r in alert_cooldown(laid).select("id").collect()} == passed
    ready = laid.withColumn("_ready", F.col("_us") - cooldown.cooldown_seconds(F.col("severity")) * 1_000_000)
    steps = cooldown._last_before(cooldown._candidates(ready), 5)  # the tree sees few of the candidates
    assert steps.count() < 3 * blocks
    mine = cooldown._candidates(ready).select("_key", "_block", "_us", "_ready")
    kept = (mine.withColumns({"_earlier": F.lit(0).cast("long"), "_own": F.lit(True)}).unionByName(
        cooldown._led_to(mine).drop("_slot").withColumns({"_ready": F.lit(0).cast("long"), "_own": F.lit(False)}))
        .groupBy("_key", "_block").applyInPandas(cooldown._block_steps, cooldown._STEPS))
    assert mine.filter("_key = 'hot'").count() > 3000 > 10 * kept.filter("_key = 'hot'").count()


def test_equal_rows_are_cut_too(spark):
    rows = [(None, "a", 100.0, "LOW")] * 3000 + [(1, "b", 5.0, "LOW")]
    laid = with_blocks(frame(spark, rows), 8)
    assert max(r["count"] for r in laid.groupBy("_block").count().collect()) < 1500
    assert sorted(r["repeat_count"] for r in correlate(laid).filter("src_ip = 'a'").collect()) == list(range(1, 3001))
    assert alert_cooldown(laid).count() == 2


@pytest.mark.parametrize("first,second", [(1, 2), (3, 4), (5, 6)])
def test_step_functions_compose(first, second):
    def made(seed):
        rng = np.random.default_rng(seed)
        upto = np.unique(rng.integers(0, 400, 30))
        return cooldown.Steps(upto, upto + rng.integers(1, 90, len(upto)))
    one, other, third = made(first), made(second), made(first + second)
    last = np.arange(-5, 600)
    assert (one.then(other)(last) == other(one(last))).all()
    assert (one.then(other).then(third)(last) == one.then(other.then(third))(last)).all()


@pytest.mark.parametrize("batch_rows", [1, 7, 100])
def test_blocks_cut_by_batches(spark, batch_rows):
    """State is carried between Arrow batches, however small they are."""
    rows = history(11, 1200, 0.7, 2)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, batch_rows)
    try:
        got = {r["id"] for r in alert_cooldown(frame(spark, rows), 6).select("id").collect()}
    finally:
        spark.conf.set(setting, before)
    assert got == replay(rows)[1]


def test_unknown_severity_and_missing_address(spark):
    df = spark.createDataFrame([(1, None, BASE, "ODD"), (2, None, BASE + timedelta(seconds=119), "ODD"),
                                (3, None, BASE + timedelta(seconds=120), "ODD")], SCHEMA)
    assert {r["id"] for r in alert_cooldown(df).collect()} == {1, 3}


def test_gap_sessions(spark):
    rows = [(i, "a", float(t), "LOW") for i, t in enumerate([0, 300, 601, 3599, 3700, 9000])]
    got = sorted((r["first_ts"].timestamp() - BASE.timestamp() if r["first_ts"].tzinfo else
                  (r["first_ts"] - datetime(2024, 1, 1)).total_seconds(), r["events"])
                 for r in gap_sessions(frame(spark, rows)).collect())
    assert got == [(0, 2), (601, 1), (3599, 2), (9000, 1)]
