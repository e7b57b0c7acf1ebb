"""Per-address state on a stream: correlation count and cooldown timer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, TimestampType

from tidewatch import constants as K

MICROS = 1_000_000
BUCKET_MS = 1000
PART_ROWS = 5000
_GAP = K.CORRELATION_GAP_SECONDS * MICROS


@dataclass
class AddressState:
    """What has to be remembered of one address."""
    count: int = 0
    last_seen: int | None = None
    last_alert: int | None = None

    def step(self, us: int, static_points: int, peak: bool) -> tuple[int, bool]:
        """Take one event in time order; return its repeat count and whether it alerts."""
        if self.last_seen is not None and us - self.last_seen > _GAP:
            self.count = 0
        self.count += 1
        self.last_seen = us
        severity = severity_for(static_points, self.count, peak)
        wait = K.COOLDOWN_SECONDS[severity] * MICROS
        passed = self.last_alert is None or us - self.last_alert >= wait
        if passed:
            self.last_alert = us
        return self.count, passed


def severity_for(static_points: int, repeat_count: int, peak: bool) -> str:
    total = static_points + max((v for least, v in K.CORRELATION_POINTS.items() if repeat_count >= least), default=0)
    if peak:
        total = int(total * K.PEAK_TOTAL_FACTOR)
    total = max(0, min(100, total))
    return max((low, name) for name, (low, _) in K.SEVERITY_RANGES.items() if low <= total)[1]


def _plain(value):
    """Rows as plain tuples, which the state can take."""
    if isinstance(value, tuple):
        return tuple(_plain(v) for v in value)
    return [_plain(v) for v in value] if isinstance(value, list) else value


class AddressProcessor(StatefulProcessor):
    """Buffers rows in buckets of time until the watermark passes them, then takes a bucket in time order.

    Arrival order inside the watermark delay therefore does not matter.  Every
    waiting bucket of an address has a timer of its own, which fires once the
    watermark has passed the whole bucket; only the rows of that bucket are
    read then, whatever else is waiting.  A micro-batch adds parts to a
    bucket and never reads those that are there.

    A row whose clock is behind the watermark is *late*: it is passed on at
    once, marked, and leaves the state alone.  A row without a readable clock
    is never late; if its time lies behind the watermark it counts at the
    watermark.  State is dropped once the address has been idle so long that
    neither session nor cooldown can still matter.
    """

    def __init__(self, payload: str, bucket_ms: int = BUCKET_MS):
        self.payload, self.bucket_ms = payload, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = f"at:bigint,us:bigint,id:string,points:int,peak:boolean,payload:{self.payload}"
        self.waiting = handle.getMapState("waiting", "bucket long, part long", f"rows array<struct<{row}>>")
        self.parts = handle.getMapState("parts", "bucket long", "n long")
        self.memory = handle.getValueState("memory", "count long, last_seen long, last_alert long, idle_ms long")

    def _store(self, buckets: dict[int, list[tuple]]) -> None:
        for bucket, rows in sorted(buckets.items()):
            n = self.parts.getValue((bucket,))[0] if self.parts.containsKey((bucket,)) else 0
            self.waiting.updateValue((bucket, n), (rows,))
            self.parts.updateValue((bucket,), (n + 1,))
            if not n:
                self.handle.registerTimer((bucket + 1) * self.bucket_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        buckets, held = {}, 0
        for row in rows:
            if row.clock is not None and row.clock < watermark:
                yield Row(src_ip=key[0], us=row.us, id=row.id, payload=row.payload, repeat_count=None, passed=False,
                          late=True)
                continue
            at = max(row.us, watermark)
            buckets.setdefault(at // (self.bucket_ms * 1000), []).append(
                (at, row.us, row.id, row.points, row.peak, _plain(row.payload)))
            held += 1
            if held >= PART_ROWS:
                self._store(buckets)
                buckets, held = {}, 0
        self._store(buckets)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        stored = self.memory.get() if self.memory.exists() else None
        if due % self.bucket_ms:  # the address has been idle
            if stored and stored[3] == due:
                self.memory.clear()
            return
        state = AddressState(*stored[:3]) if stored else AddressState()
        for row in sorted(self._released(due // self.bucket_ms - 1), key=_row_order):
            at, us, row_id, points, peak, payload = row
            repeat_count, passed = state.step(at, points, peak)
            yield Row(src_ip=key[0], us=us, id=row_id, payload=payload, repeat_count=repeat_count, passed=passed,
                      late=False)
        idle_ms = ((state.last_seen + _GAP) // 1000 // self.bucket_ms + 1) * self.bucket_ms + 1  # never a bucket's end
        if not stored or stored[3] != idle_ms:
            if stored:
                self.handle.deleteTimer(stored[3])
            self.handle.registerTimer(idle_ms)
        self.memory.update((state.count, state.last_seen, state.last_alert, idle_ms))

    def _released(self, bucket: int) -> list[tuple]:
        """Take the rows of one bucket out of the state."""
        rows = []
        for part in range(self.parts.getValue((bucket,))[0]):
            rows.extend(self.waiting.getValue((bucket, part))[0])
            self.waiting.removeKey((bucket, part))
        self.parts.removeKey((bucket,))
        return rows

    def close(self) -> None:
        pass


def _row_order(row: tuple):
    """Time, then id; rows without an id by their content, so that a repeated batch takes them alike."""
    return row[0], id_order(row[2] or ""), "" if row[2] else repr(row)


def id_order(row_id: str):
    """Ids that are numbers keep their numeric order."""
    return (0, int(row_id), "") if row_id.isdigit() else (1, 0, row_id)


def follow_addresses(live: DataFrame, clock: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Add ``repeat_count``, ``passed`` and ``late`` to a stream of live rows with a watermark on ``clock``.

    Late rows carry no count.  Rows with a null ``clock`` are late by their
    ``ts``; ahead of the watermark they wait for it like all others.  Columns
    that the state does not look at pass through it as one JSON text: a row
    then crosses between Spark and Python as six values, however wide it is.
    """
    fields = [f for f in live.schema.fields if f.name not in ("src_ip", "ts", "id", clock)]
    times = {f.name for f in fields if isinstance(f.dataType, TimestampType)}  # kept as numbers in the state

    def stored(name: str):
        return F.unix_micros(name).alias(name) if name in times else F.col(name)

    points = F.col("ml_points") + F.col("feature_points") + F.col("keyword_points") + F.col("bonus_points")
    rows = live.select(
        F.coalesce("src_ip", F.lit("unknown")).alias("src_ip"),
        # a number, not the watermarked column itself: late rows must get here
        F.unix_micros(F.coalesce(clock, "ts")).alias("clock"), F.unix_micros("ts").alias("us"), F.col("id").cast("string").alias("id"),
        points.cast("int").alias("points"),
        F.coalesce(F.array_contains("context_flags", "peak_hours"), F.lit(False)).alias("peak"),
        F.struct(*[stored(f.name) for f in fields]).alias("payload"))
    payload = rows.schema["payload"].dataType
    output = StructType.fromDDL("src_ip string, us long, id string, payload string, repeat_count long, passed boolean, late boolean")
    followed = rows.withColumn("payload", F.to_json("payload")).groupBy("src_ip").transformWithState(
        AddressProcessor("string", bucket_ms), output, "Append", "EventTime")
    followed = followed.withColumn("payload", F.from_json("payload", payload))

    def shown(name: str):
        value = F.col(f"payload.{name}")
        return (F.timestamp_micros(value) if name in times else value).alias(name)

    return followed.select(
        "src_ip", F.timestamp_micros("us").alias("ts"), F.col("id").cast(live.schema["id"].dataType).alias("id"),
        *[shown(f.name) for f in fields], "repeat_count", "passed", "late")
