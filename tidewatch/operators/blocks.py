"""Splitting the histories of all addresses into blocks of equal count.

Correlation and cooldown follow each source address through time, and one
address may own nearly all rows, even within a second.  So rows are laid out
by (address, time, id) and cut into *blocks* at points that Spark samples,
each with about the same number of rows.  No step keys a shuffle on the
address alone: rows are keyed by (address, block), and an address goes on from
one block to the next at no more places than there are blocks.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidewatch.session import stage

MICROS = 1_000_000
BLOCK_COLUMNS = ["_key", "_us", "_block"]


def with_blocks(df: DataFrame, blocks: int | None = None, tie: str = "id") -> DataFrame:
    """Add ``_key`` (address), ``_us`` (event time) and ``_block`` (number of its block), and stage the rows.

    ``blocks`` is their number, by default that of shuffle partitions.  Rows
    equal in address, time and id are cut by their place in the input, so
    they need not meet in one block either.  Columns already there are kept:
    steps that follow each other share one layout.
    """
    if set(BLOCK_COLUMNS) <= set(df.columns):
        return df
    rows = df.withColumns({"_key": F.coalesce(F.col("src_ip"), F.lit("unknown")), "_us": F.unix_micros("ts"),
                           "_place": F.monotonically_increasing_id()})
    order = ["_key", "_us", tie, "_place"]
    laid = rows.repartitionByRange(blocks, *order) if blocks else rows.repartitionByRange(*order)
    return stage(laid.drop("_place").withColumn("_block", F.spark_partition_id()), "blocks")


def crossing(rows: DataFrame) -> DataFrame | None:
    """Addresses with rows in several blocks, as ``_key``; none gives null.

    Only the last address of a block can go on in the next one, so there are
    fewer of them than blocks.
    """
    ends = rows.groupBy("_block").agg(F.min("_key").alias("low"), F.max("_key").alias("high")).orderBy("_block").collect()
    keys = sorted({one["high"] for one, other in pairwise(ends) if one["high"] == other["low"]})
    return rows.sparkSession.createDataFrame([(key,) for key in keys], "_key string") if keys else None


def only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of some addresses, of which there are at most as many as blocks."""
    return rows.join(F.broadcast(keys), "_key", "left_semi")


def with_block_value(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Join a value per (address, block) of the crossing addresses: at most two rows per block, hence broadcast."""
    return rows.join(F.broadcast(values), ["_key", "_block"], "left")


def block_order(tie: str = "id") -> WindowSpec:
    return Window.partitionBy("_key", "_block").orderBy("_us", tie)


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def gap_exceeds(window: WindowSpec, seconds: int) -> Column:
    """True when more than ``seconds`` passed since the previous row (never for the first)."""
    return F.coalesce(F.col("_us") - F.lag("_us").over(window) > seconds * MICROS, F.lit(False))
