"""Mixing sources to target weights by Pfair scheduling.

The rows of every source are cut into blocks of ``block_rows`` rows.  With
integer weights that sum to ``W``, block ``j`` (from 0) of a source of weight
``w`` is released at slot ``floor(j * W / w)`` and due at slot
``ceil((j + 1) * W / w)``.  Serving one block per slot, earliest deadline
first among the released ones, meets every deadline, so after any number of
slots each source is within one block of its exact share.

That schedule repeats after ``W`` slots, so one period is a table of ``W``
entries, whatever the size of the corpus.  When a source has no block left, a
new phase starts with the weights of the remaining ones; every row is placed
exactly once.  Blocks find their slots by arithmetic over that table, in
parallel.

Sources without a weight of their own divide one common weight evenly, and
each of them is scheduled by itself.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.rows import numbered
from tidewatch.session import stage

MAX_PERIOD = 10_000
MAX_SOURCES = 100  # sources without a weight that are scheduled by themselves
OTHER = "*"
_RANK_BITS = 33


def edf_period(weights: Mapping[str, int]) -> list[tuple[str, int]]:
    """Source and block number served in each slot of one period, earliest deadline first."""
    total = sum(weights.values())
    waiting = [(0, name, 0) for name in sorted(weights)]  # release, source, block
    heapq.heapify(waiting)
    ready, served = [], []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, name, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * total // weights[name]), name, block))
        _, name, block = heapq.heappop(ready)
        served.append((name, block))
        if block + 1 < weights[name]:
            heapq.heappush(waiting, ((block + 1) * total // weights[name], name, block + 1))
    return served


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[dict]:
    """Per phase and source: the range of blocks, the first slot, and the slots of one period."""
    left = {name: n for name, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        active = {name: weights[name] for name in left}
        total = sum(active.values())
        served = edf_period(active)
        slots = {name: [] for name in active}
        for slot, (name, _) in enumerate(served):
            slots[name].append(slot)
        last = {name: (n - 1) // active[name] * total + slots[name][(n - 1) % active[name]]
                for name, n in left.items()}
        length = min(last.values()) + 1  # ends with the first source that has no block left
        for name in active:
            whole, rest = divmod(length, total)
            n = min(left[name], whole * active[name] + sum(slot < rest for slot in slots[name]))
            out.append({"grp": name, "first": done[name], "upto": done[name] + n, "start": start,
                        "period": total, "weight": active[name], "slots": slots[name]})
            done[name] += n
            left[name] -= n
        left = {name: n for name, n in left.items() if n}
        start += length
    return out


def shares(weights: Mapping[str, int], other: int, found: Iterable[str]) -> dict[str, int]:
    """Integer weights of all groups, where the groups ``found`` divide ``other`` among them.

    All weights are multiplied so that the division is even.  Where that would
    make a period longer than ``MAX_PERIOD``, they are multiplied as far as
    that allows, and the first of ``found`` get one part more than the last.
    """
    found = list(found)
    if not found:
        return dict(weights)
    total, even = sum(weights.values()) + other, len(found) // math.gcd(len(found), other)
    times = even if total * even <= MAX_PERIOD else MAX_PERIOD // total
    part, more = divmod(other * times, len(found))
    if not part:
        raise ValueError(f"a weight of {other} cannot be divided among {len(found)} sources")
    return {**{name: weight * times for name, weight in weights.items()},
            **{name: part + (k < more) for k, name in enumerate(found)}}


def _placed(keys: DataFrame, weights: Mapping[str, int], other: int, block_rows: int, max_sources: int) -> DataFrame:
    """The place of every row of ``keys``: a stored table of ``row`` (a number of its own), ``doc_id`` and ``source``."""
    if min([other, *weights.values()]) < 1 or sum(weights.values()) + other > MAX_PERIOD:
        raise ValueError(f"weights must be positive and sum to at most {MAX_PERIOD}")
    if OTHER in weights:
        raise ValueError("'*' stands for the sources not named")
    spark = keys.sparkSession
    unnamed = F.col("source").isNotNull() & (F.col("source") != OTHER)
    if weights:
        unnamed &= ~F.col("source").isin(*weights)
    own = [row["source"] for row in keys.filter(unnamed).groupBy("source").count()
           .orderBy(F.desc("count"), "source").limit(max_sources).collect()]
    known = [*weights, *own]
    named = F.coalesce(F.col("source").isin(*known), F.lit(False)) if known else F.lit(False)
    rows = keys.withColumn("grp", F.when(named, F.col("source")).otherwise(OTHER))
    # The high bits of the place are the partition, the low ones the rank in it; the row number splits equal ids.
    order = ["grp", "doc_id", "row"]
    ranked = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("at", F.monotonically_increasing_id()), "mix-ranked")
    part, rank = F.shiftright("at", _RANK_BITS), F.col("at").bitwiseAND((1 << _RANK_BITS) - 1)
    runs = (ranked.groupBy(part.alias("part"), "grp").agg(F.count("*").alias("n"), F.min(rank).alias("least"))
            .orderBy("grp", "part").collect())  # a row per range partition, and per group cut by one
    counts: dict[str, int] = {}
    offsets = []
    for run in runs:
        offsets.append((run["part"], run["grp"], counts.get(run["grp"], 0) - run["least"]))
        counts[run["grp"]] = counts.get(run["grp"], 0) + run["n"]
    plan = phases({grp: -(-n // block_rows) for grp, n in counts.items()},
                  shares(weights, other, own + [OTHER] * (OTHER in counts)))
    short = {grp: -n % block_rows for grp, n in counts.items()}  # rows missing from the last block
    gaps = []
    for row in plan:
        if row["upto"] == -(-counts[row["grp"]] // block_rows) and short[row["grp"]]:
            k = row["upto"] - row["first"] - 1
            gaps.append((row["start"] + k // row["weight"] * row["period"] + row["slots"][k % row["weight"]],
                         short[row["grp"]]))
    offset = spark.createDataFrame(offsets, "part long, grp string, shift long")
    table = spark.createDataFrame([tuple(row.values()) for row in plan],
                                  "grp string, first long, upto long, start long, period long, weight long, "
                                  "slots array<long>")
    before = sum((F.when(F.col("slot") > at, n).otherwise(0) for at, n in gaps), F.lit(0))
    turn = "(block - first) div weight * period + get(slots, cast((block - first) % weight as int))"
    # Both tables are small by construction: range partitions, and sources x phases with W slots each.
    return (ranked.withColumn("part", part).join(F.broadcast(offset), ["part", "grp"])
            .withColumn("index", rank + F.col("shift"))
            .withColumn("block", F.expr(f"index div {block_rows}"))
            .join(F.broadcast(table), "grp").filter("block >= first and block < upto")
            .withColumn("slot", F.col("start") + F.expr(turn))
            .select("row", "doc_id", "source", "grp", "block",
                    F.expr("start + (block - first) * period div weight").alias("release"),
                    F.expr("start + ((block - first + 1) * period + weight - 1) div weight").alias("deadline"),
                    "slot", (F.col("slot") * block_rows + F.col("index") % block_rows - before).cast("long")
                    .alias("position")))


def mixed(docs: DataFrame, weights: Mapping[str, int], other: int, block_rows: int,
          max_sources: int = MAX_SOURCES) -> DataFrame:
    """One row per row of ``docs``: its source block, the block's slot, and its place in the mix.

    ``weights`` gives integer parts per source.  The sources found beside them
    divide ``other`` evenly (see ``shares``), and each is a group by itself, so
    that the bound of one block holds for every source.  Rows whose source is
    null or ``*`` form the group ``*``, with a share like one such source.  Of
    more than ``max_sources`` sources without a weight, those with the fewest
    rows join that group; their rows are all placed, but the bound then holds
    for the group.  All weights are positive, their sum at most ``MAX_PERIOD``.

    Inside a group rows go by ``doc_id``, nulls first; rows with equal ids, or
    none, stand in their stored order, and many of them are spread over tasks.
    ``position`` is gapless from 0.  ``release`` and ``deadline`` are those of
    the block's phase, in absolute slots.  An empty table gives no rows; other
    columns and the text, of whatever length, are not read.
    """
    keys = stage(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
                             F.monotonically_increasing_id().alias("row")), "mix-keys")
    return _placed(keys, weights, other, block_rows, max_sources).drop("row")


def in_mixed_order(docs: DataFrame, weights: Mapping[str, int], other: int, block_rows: int,
                   max_sources: int = MAX_SOURCES) -> DataFrame:
    """The rows of ``docs``, with all columns, range-partitioned and sorted by their place in the mix.

    Every row has a place of its own, also where ids are null or repeated.
    """
    rows = numbered(docs)
    keys = rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"),
                       F.col("doc.source").cast("string").alias("source"))
    places = _placed(keys, weights, other, block_rows, max_sources).select("row", "position")
    return rows.join(places, "row").orderBy("position").select("doc.*")
