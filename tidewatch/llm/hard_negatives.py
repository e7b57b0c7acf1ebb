"""Hard negatives by exact integer scores, computed as Kronecker-packed products.

Components become whole numbers.  The candidates of a block are *packed*: for
every dimension, their components are biased to be non-negative and written
into separate fields of one wide integer.  An anchor multiplies each of these
integers by one of its components and adds the products up; the sum then
holds the inner product of the anchor with every candidate, each in a field
wide enough that none can reach into the next.  Scores are exact whatever the
size of the numbers.

Anchors and candidates are dealt into blocks, and every pair of an anchor
block with a candidate block is one unit of work of bounded size.  A first
pass scores rows of the anchor's label and keeps its best as positives, a
second one the rows of other labels, and keeps the best that lie in the
window of each positive.  Only these few rows per anchor leave a unit; they
are merged by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # hundredths of the positive's score
BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 22
MAX_PARTITIONS = 10_000
_LONG = np.iinfo(np.int64)
_FIELDS = (1, 2, 4, 8)  # bytes that have a type of their own


class Packed:
    """Rows of whole numbers, packed for products with anchors whose components are at most ``largest``."""

    def __init__(self, rows: np.ndarray, largest: int):
        self.rows, dims = rows.shape
        self.bias = int(np.abs(rows).max(initial=0))
        # each field holds a sum between 0 and twice this
        self.offset = dims * largest * 2 * self.bias
        size = max(1, -(-(2 * self.offset).bit_length() // 8))
        self.size = next((known for known in _FIELDS if known >= size), size)
        self.columns = [self._pack(rows[:, d]) for d in range(dims)]
        self.base = int.from_bytes(self.offset.to_bytes(self.size, "little") * self.rows, "little")

    def _pack(self, column: np.ndarray) -> int:
        if self.size <= 8:
            fields = (column.astype(np.int64) + self.bias).astype(f"<u{self.size}").tobytes()
        else:
            fields = b"".join((int(x) + self.bias).to_bytes(self.size, "little") for x in column)
        return int.from_bytes(fields, "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products with every row, as 64-bit integers, or as Python integers where fields are wider."""
        total = sum(map(mul, anchor, self.columns), self.base)
        fields = total.to_bytes(self.rows * self.size, "little")
        shift = self.offset + self.bias * sum(anchor)
        if self.size > 8:
            return np.array([int.from_bytes(fields[k:k + self.size], "little") - shift
                             for k in range(0, len(fields), self.size)], object)
        values = np.frombuffer(fields, f"<u{self.size}").astype(np.uint64)
        return (values - np.uint64(shift % (1 << 64))).view(np.int64)  # exact, as scores fit into 64 bits


def whole_numbers(x: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` in double precision, as a double."""
    scaled = x.cast("double") * F.lit(float(scale))
    return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)


def _best(scores: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores among some; ties go by place."""
    values = scores[among]
    if len(among) > n:
        least = np.partition(values, len(values) - n)[-n]
        among, values = among[values >= least], values[values >= least]
    return among[np.argsort(-values, kind="stable")][:n]


def _blocks(unit: pd.DataFrame, by: list[str]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, Packed]]:
    """Anchors, and candidates in the order of ties with their packed numbers, that can be compared."""
    for _, rows in unit.groupby(by, sort=False):
        anchors, others = rows[rows.anchor], rows[~rows.anchor].sort_values(["vec_id", "row"])
        if len(anchors) and len(others):
            numbers = np.stack(others.vec.to_numpy())
            largest = max(int(np.abs(vec).max(initial=0)) for vec in anchors.vec)
            yield anchors, others, Packed(numbers, largest)


def _in_long(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, _LONG.min, _LONG.max).astype(np.int64)


class _Found:
    """Rows that leave a unit, gathered as arrays."""

    def __init__(self, *names: str):
        self.names, self.parts = names, []

    def add(self, *values) -> None:
        """Arrays of one length, and numbers that hold for all of it."""
        n = max((len(x) for x in values if isinstance(x, np.ndarray)), default=0)
        if n:
            self.parts.append([x if isinstance(x, np.ndarray) else np.full(n, x) for x in values])

    def frame(self) -> pd.DataFrame:
        columns = [np.concatenate(x) for x in zip(*self.parts)] or [np.zeros(0, np.int64)] * len(self.names)
        return pd.DataFrame(dict(zip(self.names, columns, strict=True)))


def _positives(n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def find(unit: pd.DataFrame) -> pd.DataFrame:
        found = _Found("row", "anchor_id", "positive_id", "other", "score")
        for anchors, others, packed in _blocks(unit, ["dims", "label"]):
            rows, ids = others.row.to_numpy(), others.vec_id.to_numpy()
            for row, anchor_id, vec in zip(anchors.row, anchors.vec_id, anchors.vec, strict=True):
                scores = packed.scores([int(x) for x in vec])
                best = _best(scores, np.flatnonzero(rows != row), n)
                found.add(row, anchor_id, ids[best], rows[best], _in_long(scores[best]))
        return found.frame()
    return find


def _negatives(n: int, low: int, high: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def find(unit: pd.DataFrame) -> pd.DataFrame:
        found = _Found("row", "positive_score", "negative_id", "other", "score")
        for anchors, others, packed in _blocks(unit, ["dims"]):
            rows, ids, labels = others.row.to_numpy(), others.vec_id.to_numpy(), others.label.to_numpy()
            for label, same in anchors.groupby("label", sort=False):
                differ = np.flatnonzero(labels != label)
                for row, vec, wanted in zip(same.row, same.vec, same.wanted, strict=True):
                    scores = packed.scores([int(x) for x in vec])[differ]
                    for positive in map(int, wanted):
                        least, most = -(-low * positive // 100), high * positive // 100
                        inside = np.flatnonzero((scores >= least) & (scores <= most))
                        best = _best(scores, inside, n)
                        found.add(row, positive, ids[differ[best]], rows[differ[best]], _in_long(scores[best]))
        return found.frame()
    return find


def _units(anchors: DataFrame, points: DataFrame, n_anchors: int, n_points: int, rows: int) -> DataFrame:
    """Every anchor block beside every block of candidates, as the rows of one ``unit``."""
    tall, wide = -(-n_anchors // rows), -(-n_points // rows)
    placed = anchors.withColumns({
        "anchor": F.lit(True), "high": F.pmod(F.xxhash64("row"), F.lit(tall)),
        "low": F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))})
    others = points.withColumns({
        "anchor": F.lit(False), "low": F.pmod(F.xxhash64("row"), F.lit(wide)),
        "high": F.explode(F.sequence(F.lit(0), F.lit(tall - 1)))})
    both = placed.unionByName(others, allowMissingColumns=True)
    unit = (F.col("high").cast("long") * wide + F.col("low")).alias("unit")
    return both.select(unit, *[name for name in both.columns if name not in ("high", "low")]).repartition(
        min(tall * wide, MAX_PARTITIONS), "unit")


def _ranked(found: DataFrame, by: list[str], tie: str, n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), tie, "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """One row per anchor, positive and hard negative.

    ``is_anchor`` marks anchors among the rows of ``vectors`` (``vec_id``,
    ``label``, ``embedding``).  A row's score is its inner product with the
    anchor over ``floor(scale * x)``.  Positives are the best ``positives``
    other rows of the anchor's label; for each, the best ``negatives`` rows of
    other labels are returned whose score lies between ``low`` and ``high``
    hundredths of the positive's.  Ties go to the smaller ``vec_id``.

    Rows without id, label or vector, and vectors with a component that is
    null or not finite (also after scaling), take no part.  Rows meet only if
    their vectors are equally long.  Rows that repeat an id are rows of their
    own: each may be an anchor, and a positive or negative of the others.
    Scores beyond 64 bits are ranked exactly inside a block and returned as
    the nearest 64-bit number.  An empty table, an anchor without positives
    and a positive without negatives give no rows; other columns, texts of
    any length among them, are not read.
    """
    numbers = F.transform("embedding", lambda x: whole_numbers(x, scale))
    unsound = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    points = stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", numbers.alias("vec"),
                                  F.coalesce(is_anchor, F.lit(False)).alias("chosen"))
                   .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
                   .filter(~unsound)
                   .withColumns({"row": F.monotonically_increasing_id(), "dims": F.size("vec")}), "vectors")
    sizes = points.agg(F.count("*").alias("n"), F.count_if("chosen").alias("anchors"), F.max("dims").alias("dims")).first()
    n, n_anchors = max(sizes["n"], 1), max(sizes["anchors"], 1)
    rows = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(sizes["dims"] or 1, 1))))
    anchors, points = points.filter("chosen").drop("chosen"), points.drop("chosen")
    found = _units(anchors, points, n_anchors, n, rows).groupBy("unit").applyInPandas(
        _positives(positives), "row long, anchor_id long, positive_id long, other long, score long")
    best = stage(_ranked(found, ["row"], "positive_id", positives)
                 .select("row", "anchor_id", "positive_id", F.col("score").alias("positive_score")), "positives")
    wanted = best.groupBy("row").agg(F.collect_set("positive_score").alias("wanted"))  # at most ``positives`` each
    inside = _units(anchors.join(wanted, "row"), points, n_anchors, n, rows).groupBy("unit").applyInPandas(
        _negatives(negatives, low, high), "row long, positive_score long, negative_id long, other long, score long")
    chosen = _ranked(inside, ["row", "positive_score"], "negative_id", negatives)
    return best.join(chosen, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
