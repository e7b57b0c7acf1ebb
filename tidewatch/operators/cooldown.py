"""Per-address alert cooldown, split over blocks of equal count.

An alert passes when the time since the last passed alert of its address has
reached the cooldown of its own severity, so each decision depends on
earlier ones.  Three facts make it parallel and exact:

* with ``ready = time - cooldown``, the alert following one passed at ``t`` is
  the first row whose ``ready`` is at least ``t``; such a row is always a new
  running maximum of ``ready``, so all other rows can be dropped by a window;
* a block acts on what lies before it only through one number, the time of
  the last pass, and as a *step function* of it: "last passed before" to
  "last passed inside".  Step functions compose, and composition is
  associative;
* a step matters only if an earlier row of the address has a time that leads
  to it, and only within the longest cooldown before the block.

So every block of an address that crosses blocks becomes a step function, the
functions are composed in a tree whose nodes take ``FAN`` neighbours each, the
tree is walked down again to find the last pass before every block, and then
all blocks decide their rows in parallel.  Addresses inside one block need
none of that.  A node holds the steps of at most ``FAN`` nodes below it, after
those that no earlier row leads to are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.functions.columns import lookup
from tidewatch.operators.blocks import (BLOCK_COLUMNS, MICROS, before, block_order, crossing, only, with_block_value,
                                        with_blocks)
from tidewatch.session import stage

FAN_BITS = 5
FAN = 1 << FAN_BITS
_LONGEST = max(K.COOLDOWN_SECONDS.values()) * MICROS
_SLOT = _LONGEST // 1024  # earlier rows are told by their first and last time in such a slot
_NEVER = np.iinfo(np.int64).min
_HELPERS = [*BLOCK_COLUMNS, "_ready", "_first", "_last"]
_STEPS = "_key string, _node long, _upto long, _result long"


def cooldown_seconds(severity: Column) -> Column:
    return lookup(severity, K.COOLDOWN_SECONDS, K.DEFAULT_COOLDOWN_SECONDS)


def _candidates(rows: DataFrame) -> DataFrame:
    """Rows that set a new maximum of ``_ready`` in their block; ``_first`` opens a block of an address."""
    highest = F.max("_ready").over(before(block_order()))
    rows = rows.withColumn("_highest", highest)
    rows = rows.withColumn("_first", F.col("_highest").isNull())
    return rows.filter(F.col("_first") | (F.col("_ready") > F.col("_highest"))).drop("_highest")


class Steps:
    """Step function of the last pass: entered with ``last``, the first step whose ``upto`` reaches it tells the result.

    Beyond the last step nothing passes, and ``last`` stays.
    """

    def __init__(self, upto: np.ndarray, result: np.ndarray):
        # neighbouring steps with one result are one step
        keep = np.append(result[1:] != result[:-1], True)[:len(result)]
        self.upto, self.result = upto[keep], result[keep]

    def __call__(self, last: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.upto, last)
        inside = np.minimum(at, len(self.upto) - 1)
        return np.where(at < len(self.upto), self.result[inside], last)

    def then(self, later: Steps) -> Steps:
        """Both, one after the other."""
        fresh = later.upto > self.upto[-1]
        return Steps(np.concatenate([self.upto, later.upto[fresh]]),
                     np.concatenate([later(self.result), later.result[fresh]]))

    def frame(self, key: str, node: int) -> pd.DataFrame:
        return pd.DataFrame({"_key": key, "_node": node, "_upto": self.upto, "_result": self.result})


def _jump_to_end(follower: np.ndarray) -> np.ndarray:
    """The last candidate reached from each one; ``follower`` is the candidate itself where none follows."""
    while True:
        further = follower[follower]
        if np.array_equal(further, follower):
            return follower
        follower = further


def _block_steps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The step function of one block, without the steps that no earlier row leads to."""
    mine = rows[rows._own].sort_values("_ready")
    us, ready = mine._us.to_numpy(), mine._ready.to_numpy()
    at = np.searchsorted(ready, us)
    reach = _jump_to_end(np.where(at < len(us), at, np.arange(len(us))))
    since = np.concatenate([[_NEVER], ready[:-1]])  # a step takes what lies behind this, up to ready
    earlier = rows[~rows._own].sort_values("_us")
    low, high = earlier._earlier.to_numpy(), earlier._us.to_numpy()
    slot = np.searchsorted(high, since, side="right")
    reached = slot < len(high)
    reached[reached] = low[slot[reached]] <= ready[reached]
    reached[0] = True  # also taken when nothing has passed before
    return Steps(ready[reached], us[reach[reached]]).frame(key[0], int(key[1]))


def _functions(rows: pd.DataFrame) -> list[tuple[int, Steps]]:
    """The nodes of one group in their order."""
    ordered = rows.sort_values(["_node", "_upto"])
    return [(int(node), Steps(part._upto.to_numpy(), part._result.to_numpy()))
            for node, part in ordered.groupby("_node", sort=True)]


def _composed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    parts = [steps for _, steps in _functions(rows)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.then(part)
    return whole.frame(key[0], int(key[1]))


def _walked(key: tuple, entered: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The last pass before each node of a group, given the one before the group (none for an address's first)."""
    last = np.array([entered._last.iloc[0] if len(entered) else _NEVER], np.int64)
    out = []
    for node, steps in _functions(rows) if len(rows) else []:
        if last[0] != _NEVER:
            out.append((key[0], node, int(last[0])))
        last = steps(last)
    return pd.DataFrame(out, columns=["_key", "_node", "_last"])


def _led_to(candidates: DataFrame) -> DataFrame:
    """Times of earlier rows that can matter to each block, as ``_earlier`` to ``_us`` of a slot."""
    starts = candidates.groupBy("_key", "_block").agg(F.min("_us").alias("_start"))  # two rows per block at most
    window = F.floor(F.col("_us") / _LONGEST)
    slots = (candidates.groupBy("_key", F.floor(F.col("_us") / _SLOT).alias("_slot"), window.alias("_window"), "_block")
             .agg(F.min("_us").alias("_earlier"), F.max("_us").alias("_us")))
    place = F.floor(F.col("_start") / _LONGEST)
    wanted = starts.select("_key", F.col("_block").alias("_for"), "_start", F.explode(F.array(place - 1, place)).alias("_window"))
    return (slots.join(F.broadcast(wanted), ["_key", "_window"])
            .filter((F.col("_block") < F.col("_for")) & (F.col("_us") > F.col("_start") - _LONGEST))
            .groupBy("_key", F.col("_for").alias("_block"), "_slot")
            .agg(F.min("_earlier").alias("_earlier"), F.max("_us").alias("_us")))


def _last_before(candidates: DataFrame, fan_bits: int) -> DataFrame:
    """``_last``, the time of the last pass before a block, for (address, block) where there is one."""
    mine = candidates.select("_key", "_block", "_us", "_ready")
    unused = F.lit(0).cast("long")
    both = mine.withColumns({"_earlier": unused, "_own": F.lit(True)}).unionByName(
        _led_to(mine).drop("_slot").withColumns({"_ready": unused, "_own": F.lit(False)}))
    levels = [stage(both.groupBy("_key", "_block").applyInPandas(_block_steps, _STEPS), "steps")]
    top = levels[0].agg(F.max("_node")).first()[0]
    group = F.shiftright("_node", fan_bits).alias("_node")
    while top >> fan_bits:
        top >>= fan_bits
        levels.append(stage(levels[-1].groupBy("_key", group).applyInPandas(_composed, _STEPS), "steps"))
    entered = candidates.sparkSession.createDataFrame([], "_key string, _node long, _last long")
    for level in reversed(levels):
        entered = entered.groupBy("_key", "_node").cogroup(level.groupBy("_key", group)).applyInPandas(
            _walked, "_key string, _node long, _last long")
    return stage(entered.withColumnRenamed("_node", "_block"), "entered")


class _Batch:
    """Array view of one Arrow batch of candidates: which follows which inside the batch.

    Segment 0 continues the block of the batch before; every ``_first`` row
    opens the next segment.
    """

    def __init__(self, batch: pa.RecordBatch):
        def array(name: str) -> np.ndarray:
            return batch.column(name).to_numpy(zero_copy_only=False)

        self.first = array("_first").astype(bool)
        self.us, self.ready = array("_us"), array("_ready")
        self.segment = np.cumsum(self.first)
        self.continues = not self.first[0]
        self.final = self.segment == self.segment[-1]
        self._levels = np.unique(self.ready)
        self._line = self._place(self.segment, self.ready)
        self.follower = self.first_ready(self.segment, self.us, np.arange(len(self.us)))

    def _place(self, segment: np.ndarray, time: np.ndarray) -> np.ndarray:
        """Numbers in the order of (segment, time)."""
        return segment * (len(self._levels) + 1) + np.searchsorted(self._levels, time)

    def first_ready(self, segment, time, otherwise) -> np.ndarray:
        """Index of the segment's first candidate ready at ``time``, else ``otherwise``."""
        at = np.searchsorted(self._line, self._place(segment, time))
        inside = np.minimum(at, len(self.us) - 1)
        found = (at < len(self.us)) & (self.segment[inside] == segment)
        return np.where(found, inside, otherwise)

    def passed(self, opening: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Mask of passed candidates; segments begin at ``opening`` with ``last`` passed before."""
        at = self.first_ready(self.segment[opening], last, np.full(len(opening), -1))
        at = at[at >= 0]
        mask = np.zeros(len(self.us), dtype=bool)
        while len(at):
            mask[at] = True
            after = self.follower[at]
            at = after[after != at]
        return mask


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with the last pass before their block -> passed rows, batch by batch."""
    last = _NEVER
    for record in batches:
        if not record.num_rows:
            continue
        batch = _Batch(record)
        opening = np.flatnonzero(batch.first)
        earlier = record.column("_last").to_numpy()[opening]
        if batch.continues:
            opening, earlier = np.append(0, opening), np.append(last, earlier)
        mask = batch.passed(opening, earlier)
        recent = batch.us[mask & batch.final]
        last = int(recent[-1]) if len(recent) else int(earlier[-1])
        yield record.filter(pa.array(mask))


def alert_cooldown(alerts: DataFrame, blocks: int | None = None, fan_bits: int = FAN_BITS) -> DataFrame:
    """Rows of ``alerts`` that pass the cooldown of their address.

    ``alerts`` needs ``src_ip``, ``ts``, ``id`` and ``severity``; all of its
    columns are kept.  Ties in time are ordered by ``id``.
    """
    rows = with_blocks(alerts, blocks).withColumn(
        "_ready", F.col("_us") - cooldown_seconds(F.col("severity")) * F.lit(MICROS))
    keys = crossing(rows)
    candidates = _candidates(rows)
    if keys is None:
        candidates = candidates.withColumn("_last", F.lit(_NEVER))
    else:
        entered = _last_before(_candidates(only(rows.select("_key", "_block", "_us", "_ready", "id"), keys)), fan_bits)
        candidates = with_block_value(candidates, entered).withColumn("_last", F.coalesce("_last", F.lit(_NEVER)))
    return candidates.mapInArrow(_decide, candidates.schema).drop(*_HELPERS)
