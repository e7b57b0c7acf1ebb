"""Continuous log processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.columns import compute_once, parse_timestamp
from tidewatch.operators.context import evaluate_context
from tidewatch.operators.correlation import correlation_points
from tidewatch.operators.enrich import enrich_logs
from tidewatch.operators.response import action_rows, create_alerts, response_actions
from tidewatch.operators.scoring import finish_live, live_rows, quiet_rows
from tidewatch.operators.validate import parse_logs, split_valid
from tidewatch.plans.feeds import log_payload
from tidewatch.session import use_rocksdb_state
from tidewatch.sources.datasets import path_exists
from tidewatch.sources.sinks import commit_batch, overwrite_batch
from tidewatch.streaming.processor import BUCKET_MS, follow_addresses

# stays ahead of disorder between sources; live rows later than this are set apart unscored, see late_rows
DEFAULT_DELAY = "60 seconds"
SINKS = ["late", "logs", "alerts", "actions", "stats", "totals"]
_CLOCK = "_clock"
_SHOWN = ["id", "timestamp", "src_ip", "dst_ip", "event_type", "log_level", "message", "ts"]


def enriched_stream(raw: DataFrame, ingest_ts: Column | None = None, shared: bool = False) -> DataFrame:
    """Raw JSON lines to enriched logs; invalid lines are left out (``start_intake`` keeps them).

    A flow that takes the logs apart again, as ``score_stream`` does, reads
    them once per part.  ``shared`` logs are parsed once for all parts: they
    go through one exchange, which the parts have in common as no filter gets
    below it.
    """
    valid, _ = split_valid(parse_logs(raw))
    logs = enrich_logs(valid, ingest_ts)
    if not shared:
        return logs
    spread = logs.repartition("id", "ts", "src_port")  # ids may be missing
    return compute_once(spread, {name: F.col(name) for name in spread.columns})


def score_stream(predicted: DataFrame, delay: str = DEFAULT_DELAY, now: Column | None = None,
                 bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Every log with its score; live rows follow once the watermark has passed them.

    ``passed`` marks the rows that raise an alert.  Only readable timestamps
    that are not ahead of ``now`` (by default the time of the batch) move the
    watermark, so a log with a broken or future time cannot make others late.
    ``late`` marks live rows whose event time is behind the watermark when
    they arrive; they come out at once, without score, severity and factors.
    That holds for an ingest time too that stands for a broken one, if it was
    given; the time of arrival never is behind.

    A live row is released when the watermark has passed the ``bucket_ms`` it
    lies in.  State is read and written by bucket: a flow that catches up with
    stored logs takes them long, one that alerts as logs arrive short.
    """
    use_rocksdb_state(predicted.sparkSession)
    evaluated = evaluate_context(predicted)
    told = parse_timestamp(F.col("timestamp"), F.lit(None).cast("timestamp"))
    clock = F.when(told <= (F.current_timestamp() if now is None else now), told)
    live = live_rows(evaluated).withColumn(_CLOCK, clock).withWatermark(_CLOCK, delay)
    followed = follow_addresses(live, _CLOCK, bucket_ms)
    scored = finish_live(followed.withColumn(
        "correlation_points", correlation_points(F.col("repeat_count"))))
    scored = scored.withColumns({name: F.when(~F.col("late"), F.col(name))
                                 for name in ("correlation_points", "threat_score", "severity", "factors")})
    quiet = quiet_rows(evaluated).withColumns({"passed": F.lit(False), "late": F.lit(False)})
    return scored.unionByName(quiet)


def _totals(spark: SparkSession, counters: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Running totals: those of the batch before plus this one's counters, a row per severity."""
    before = f"{root}/totals/batch_id={batch_id - 1}"
    if batch_id > 0 and path_exists(spark, before):
        counters = counters.unionByName(spark.read.parquet(before))
    return counters.groupBy("severity").agg(*[F.sum(n).alias(n) for n in counters.columns if n != "severity"])


def fan_out(root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` target: logs, alerts, audit rows, late rows, and counters as changes and as running totals.

    The batch is committed when all of them are written; ``read_committed``
    shows whole batches only, also after a failure between two sinks.
    """
    def write(everything: DataFrame, batch_id: int) -> None:
        everything = everything.persist()
        batch = everything.filter(~F.col("late"))
        try:
            shown = [F.col(n).cast("string") if n == "id" else F.col(n) for n in _SHOWN]
            overwrite_batch(everything.filter("late").select(*shown), f"{root}/late", batch_id)
            overwrite_batch(log_payload(batch), f"{root}/logs", batch_id)
            alerts = create_alerts(batch.filter("passed"))
            overwrite_batch(alerts, f"{root}/alerts", batch_id)
            overwrite_batch(action_rows(alerts), f"{root}/actions", batch_id)
            steps = F.when(F.col("passed"), F.size(response_actions())).otherwise(0)
            counters = batch.groupBy("severity").agg(
                F.count("*").alias("logs"), F.count_if("passed").alias("alerts"),
                F.sum(steps).cast("long").alias("actions"),
                F.count_if(~F.col("passed") & ~F.col("severity").isin("NORMAL", "SUPPRESSED")).alias("in_cooldown"),
                F.sum("rule_hits").cast("long").alias("rule_hits"))
            overwrite_batch(counters, f"{root}/stats", batch_id)
            stored = batch.sparkSession.read.parquet(f"{root}/stats/batch_id={batch_id}")
            overwrite_batch(_totals(batch.sparkSession, stored, root, batch_id), f"{root}/totals", batch_id)
            commit_batch(batch.sparkSession, root, batch_id, SINKS)
        finally:
            everything.unpersist()
    return write


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
         available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start(scored: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run the flow into the tables logs, alerts, actions, stats and totals below ``root``."""
    return _run(scored, fan_out(root), checkpoint, available_now)


def start_intake(raw: DataFrame, root: str, checkpoint: str, ingest_ts: Column | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Keep every line as it arrives: valid logs in ``received``, the others with their reason in ``rejected``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            valid, rejected = split_valid(batch)
            overwrite_batch(enrich_logs(valid, ingest_ts).select(_SHOWN), f"{root}/received", batch_id)
            overwrite_batch(rejected.select("value", "reason"), f"{root}/rejected", batch_id)
        finally:
            batch.unpersist()
    return _run(parse_logs(raw.select("value")), write, checkpoint, available_now)


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Live logs that came too late to be scored, as the flow set them apart; equal ones are counted in ``copies``."""
    return spark.read.parquet(f"{root}/late").groupBy(*_SHOWN).agg(F.count("*").alias("copies"))


def stream_stats(evaluated: DataFrame) -> DataFrame:
    """Running counters of an evaluated stream (complete mode)."""
    return evaluated.groupBy().agg(
        F.count("*").alias("total_logs"),
        F.sum(F.col("is_anomaly").cast("long")).alias("anomalies"),
        F.sum(F.col("rule_hits").cast("long")).alias("suppressed"),
        F.sum(F.col("suppress").cast("long")).alias("suppressed_rows"),
        F.sum(F.col("peak_adjusted").cast("long")).alias("adjusted"))
