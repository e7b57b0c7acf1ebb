"""Event correlation: position of each event in its address's gap session.

A session ends when more than 300 s pass without an event.  The count is
exact and needs no per-address task over raw rows:

1. per (address, block): local sessions by window functions;
2. for addresses that cross blocks, one summary row per block, folded over the
   blocks of an address to learn how many events of a still open session
   precede the block;
3. that carry is added to the rows of the block's first local session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import constants as K
from tidewatch.operators.blocks import (BLOCK_COLUMNS, MICROS, block_order, crossing, gap_exceeds, only, so_far,
                                        with_block_value, with_blocks)

_HELPERS = ["_row", "_open", "_breaks", "_carry"]


def _local_sessions(rows: DataFrame) -> DataFrame:
    order = block_order()
    rows = rows.withColumns({
        "_row": F.row_number().over(order),
        "_breaks": gap_exceeds(order, K.CORRELATION_GAP_SECONDS)})
    # row number at which the current local session began
    opened = F.max(F.when(F.col("_breaks"), F.col("_row"))).over(so_far(order))
    return rows.withColumn("_open", F.coalesce(opened, F.lit(1)))


def _carried(rows: DataFrame) -> DataFrame:
    """(address, block, events of the open session before the block), non-zero only."""
    blocks = rows.groupBy("_key", "_block").agg(
        F.count("*").alias("_n"), F.min("_us").alias("_from"), F.max("_us").alias("_to"),
        F.max("_open").alias("_tail_open"))
    order = Window.partitionBy("_key").orderBy("_block")
    joins = F.coalesce(
        F.col("_from") - F.lag("_to").over(order) <= K.CORRELATION_GAP_SECONDS * MICROS,
        F.lit(False))
    blocks = blocks.withColumn("_joins", joins).withColumn(
        "_add", F.col("_n") - F.col("_tail_open") + 1)
    starts_new = ~F.col("_joins") | (F.col("_tail_open") > 1)
    blocks = blocks.withColumn("_sum", F.sum("_add").over(so_far(order)))
    floor = F.max(F.when(starts_new, F.col("_sum") - F.col("_add"))).over(so_far(order))
    blocks = blocks.withColumn("_tail", F.col("_sum") - floor)
    carry = F.when(F.col("_joins"), F.lag("_tail").over(order))
    return (blocks.withColumn("_carry", carry)
                  .filter(F.col("_carry") > 0).select("_key", "_block", "_carry"))


def correlation_points(repeat_count: Column) -> Column:
    points = F.lit(0)
    for least, value in sorted(K.CORRELATION_POINTS.items()):
        points = F.when(repeat_count >= least, value).otherwise(points)
    return points


def correlate(events: DataFrame, blocks: int | None = None, keep_blocks: bool = False) -> DataFrame:
    """Add ``repeat_count`` and ``correlation_points`` to scored events.

    ``events`` needs ``src_ip``, ``ts`` and ``id`` and should hold only
    anomalous, unsuppressed rows.  ``keep_blocks`` leaves the block columns
    for a cooldown over the same layout.
    """
    events = with_blocks(events, blocks)
    keys = crossing(events)
    rows = _local_sessions(events)
    if keys is None:
        rows = rows.withColumn("_carry", F.lit(None).cast("long"))
    else:
        rows = with_block_value(rows, _carried(_local_sessions(only(events, keys))))
    position = F.col("_row") - F.col("_open") + 1
    carry = F.when(F.col("_open") == 1, F.coalesce(F.col("_carry"), F.lit(0))).otherwise(0)
    rows = rows.withColumn("repeat_count", (position + carry).cast("long"))
    rows = rows.withColumn("correlation_points", correlation_points(F.col("repeat_count")))
    return rows.drop(*_HELPERS, *([] if keep_blocks else BLOCK_COLUMNS))


def ip_history_size(correlated: DataFrame) -> DataFrame:
    """Events held in the latest session of every address, as one number."""
    latest = correlated.groupBy("src_ip").agg(
        F.max_by("repeat_count", F.struct("ts", "id")).alias("_n"))
    return latest.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("ip_history_size"))


def gap_sessions(events: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per gap session: src_ip, first_ts, last_ts, events.

    Sessions are first formed inside blocks.  Only the first and the last one
    of a block can go on in another, so the step that joins them sees inner
    sessions of an address as finished rows.
    """
    local = _local_sessions(with_blocks(events, blocks)).groupBy("_key", "_block", "_open").agg(
        F.min("_us").alias("_from"), F.max("_us").alias("_to"), F.count("*").alias("_n"))
    order = Window.partitionBy("_key").orderBy("_block", "_from")
    apart = F.coalesce(
        F.col("_from") - F.lag("_to").over(order) > K.CORRELATION_GAP_SECONDS * MICROS, F.lit(False))
    numbered = local.withColumn("_apart", apart.cast("int")).withColumn(
        "_session", F.sum("_apart").over(so_far(order)))
    return numbered.groupBy("_key", "_session").agg(
        F.timestamp_micros(F.min("_from")).alias("first_ts"),
        F.timestamp_micros(F.max("_to")).alias("last_ts"), F.sum("_n").alias("events"),
    ).select(F.col("_key").alias("src_ip"), "first_ts", "last_ts", "events")


def stream_session_counts(events: DataFrame) -> DataFrame:
    """The same sessions on a watermarked stream; an event exactly one gap later still merges."""
    gap = f"{K.CORRELATION_GAP_SECONDS} seconds"
    return events.groupBy("src_ip", F.session_window("ts", gap).alias("session")).agg(
        F.count("*").alias("events"))
