"""Scaler and isolation forest, fitted and applied on Spark.

Rows are given to trees by hashing, each tree is grown from at most 256 rows
in its own task, and the result is a table of nodes.  Scoring walks the nodes
of all trees for one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, exp, log, log1p, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch import constants as K
from tidewatch.operators.quantiles import FINISH_ROWS, exact_percentile
from tidewatch.session import stage

FOREST_SCHEMA = ("tree_id int, node_id int, feature_idx int, threshold double, "
                 "left int, right int, depth int, n int")
SCALER_SCHEMA = "position int, feature string, mean double, std double"


# ---------------------------------------------------------------------- scaler
def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per feature: mean and population deviation (1 for a constant)."""
    stats = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                      F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
             for i, c in enumerate(columns)]
    rows = df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))
    return rows.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


@dataclass(frozen=True)
class Scaler:
    """Fitted scaler on the driver: two numbers per feature."""
    features: list[str]
    mean: list[float]
    std: list[float]

    @staticmethod
    def from_table(table: DataFrame) -> "Scaler":
        rows = table.orderBy("position").collect()
        return Scaler([r["feature"] for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows])

    def columns(self, raw: Sequence[Column]) -> list[Column]:
        return [(x - F.lit(m)) / F.lit(s) for x, m, s in zip(raw, self.mean, self.std)]


def scale_features(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Replace each feature column by its scaled value."""
    scaled = scaler.columns([F.col(c) for c in scaler.features])
    return df.withColumns(dict(zip(scaler.features, scaled)))


# ----------------------------------------------------------------------- maths
def average_path(n: float) -> float:
    """Expected path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (log(n - 1) + K.EULER_GAMMA) - 2.0 * (n - 1) / n


def score_samples(mean_path: Column, sample_size: int) -> Column:
    """Minus the anomaly score: near -1 for isolated rows, near 0 for deep ones."""
    return -F.pow(F.lit(2.0), -mean_path / F.lit(average_path(sample_size)))


def decision(score: Column, offset: float) -> Column:
    return score - F.lit(offset)


# ------------------------------------------------------------------------- fit
MARGIN = 1.5  # rows offered to a tree, as a multiple of those it needs


def _shares(trees: int, fraction: float) -> list[float]:
    """Probability that a row goes to at most 0, 1, ... ``trees - 1`` trees, each with ``fraction``."""
    if fraction >= 1.0:
        return [0.0] * trees
    odds, out, total = fraction / (1 - fraction), [], 0.0
    chance = exp(trees * log1p(-fraction))
    for k in range(trees):
        total += chance
        out.append(min(total, 1.0))
        chance *= (trees - k) / (k + 1) * odds
    return out


def _tree_samples(df: DataFrame, columns: Sequence[str], trees: int, size: int, seed: int,
                  fraction: float) -> DataFrame:
    """(tree_id, features..., _place): at most ``size`` rows of each tree.

    Every row draws from one hash how many trees it goes to, and from further
    hashes which ones, so a tree sees every row with probability ``fraction``.
    Most rows of a large table draw none and are left behind at once.
    """
    def draw(*salt: Column) -> Column:
        return F.xxhash64("_row_key", *salt)

    uniform = (F.shiftrightunsigned(draw(F.lit(seed)), 11)) / F.lit(float(1 << 53))
    shares = _shares(trees, fraction)
    number = F.size(F.filter(F.array(*[F.lit(s) for s in shares]), lambda share: share <= F.col("_uniform")))
    # few trees: distinct ones among more draws than needed; many: the first of all trees in a drawn order
    draws = F.transform(F.sequence(F.lit(1), F.col("_number") * 4 + 8),
                        lambda turn: F.pmod(draw(F.lit(seed + 1), turn), F.lit(trees)).cast("int"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                                     lambda tree: F.struct(draw(F.lit(seed + 1), tree).alias("rank"),
                                                           tree.alias("tree"))))
    few = F.slice(F.array_distinct(draws), 1, F.col("_number"))
    many = F.transform(F.slice(order, 1, F.col("_number")), lambda drawn: drawn["tree"])
    picked = (df.withColumn("_uniform", uniform).filter(F.col("_uniform") >= shares[0])
              .withColumn("_number", number)
              .withColumn("tree_id", F.explode(F.when(F.col("_number") * 8 <= trees, few).otherwise(many)))
              .select("_row_key", *columns, "tree_id", draw(F.lit(seed + 2), F.col("tree_id")).alias("_rank")))
    # the row limit is applied per map partition before the shuffle, too
    place = Window.partitionBy("tree_id").orderBy("_rank", "_row_key", *columns)
    picked = picked.withColumn("_place", F.row_number().over(place))
    return picked.filter(F.col("_place") <= size).select("tree_id", "_place", *columns)


def _grow(columns: list[str], limit: int, seed: int):
    """Grouped kernel: the rows of one tree -> its node rows."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_place")
        tree_id = int(rows["tree_id"].iloc[0])
        x = rows[columns].to_numpy(dtype=np.float64)
        rng = np.random.default_rng([seed, tree_id])
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        next_id = 1
        while todo:
            node, members, depth = todo.pop()
            low, high = x[members].min(axis=0), x[members].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or len(usable) == 0:
                nodes.append((tree_id, node, -1, 0.0, -1, -1, depth, len(members)))
                continue
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(low[feature], high[feature]))
            goes_left = x[members, feature] <= cut
            if goes_left.all():
                cut = float(low[feature])
                goes_left = x[members, feature] <= cut
            left, right = next_id, next_id + 1
            next_id += 2
            nodes.append((tree_id, node, feature, cut, left, right, depth, len(members)))
            todo.append((right, members[~goes_left], depth + 1))
            todo.append((left, members[goes_left], depth + 1))
        names = [f.split()[0] for f in FOREST_SCHEMA.split(", ")]
        return pd.DataFrame(nodes, columns=names)
    return run


def fit_forest(df: DataFrame, columns: Sequence[str], trees: int = K.LABELLED_TREES,
               size: int = K.FOREST_SAMPLE_SIZE, seed: int = K.FOREST_SEED,
               row_key: Column | None = None, total: int | None = None) -> DataFrame:
    """Node table of an isolation forest over (already scaled) ``columns``.

    ``row_key`` should be unique and makes the forest independent of
    partitioning; row position is used without one.
    """
    columns = list(columns)
    key = row_key if row_key is not None else F.monotonically_increasing_id()
    keyed = df.withColumn("_row_key", key)
    keyed = keyed.select("_row_key", *columns)
    total = total if total is not None else keyed.count()
    if total == 0:
        raise ValueError("no training rows")
    psi = min(size, total)
    limit = ceil(log2(max(psi, 2)))
    fraction = min(1.0, MARGIN * psi / total)
    while True:
        samples = stage(_tree_samples(keyed, columns, trees, psi, seed, fraction), "tree-samples")
        counts = samples.groupBy("tree_id").agg(F.count("*").alias("n"))
        held = counts.agg(F.count("*").alias("trees"), F.min("n").alias("least")).first()
        if fraction >= 1.0 or (held["trees"] == trees and held["least"] >= psi):
            break
        fraction = min(1.0, 2 * fraction)  # a tree came out short: offer more rows to all
    # so few bytes would be merged into one task, but growing trees is work
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    samples = samples.repartition(tasks, "tree_id")
    return samples.groupBy("tree_id").applyInPandas(_grow(columns, limit, seed), FOREST_SCHEMA)


# --------------------------------------------------------------------- scoring
class NodeArrays:
    """All trees as complete binary trees of equal depth, ready to walk.

    A leaf above the last level is repeated down its left side, so a walk is
    the same number of steps for every row and tree.  Size is bounded by
    trees x 2**(depth+1), independent of the data.
    """

    def __init__(self, rows: list):
        trees = sorted({r["tree_id"] for r in rows})
        position = {t: i for i, t in enumerate(trees)}
        self.depth = max(r["depth"] for r in rows)
        slots = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((len(trees), slots), dtype=np.int64)
        self.cut = np.full((len(trees), slots), np.inf)
        self.path = np.zeros((len(trees), slots))
        by_tree: dict[int, dict[int, dict]] = {}
        for r in rows:
            by_tree.setdefault(r["tree_id"], {})[r["node_id"]] = r
        for tree, nodes in by_tree.items():
            t, todo = position[tree], [(0, 0)]
            while todo:
                node, slot = todo.pop()
                r = nodes[node]
                if r["left"] < 0:
                    length = r["depth"] + average_path(r["n"])
                    while slot < slots:
                        self.path[t, slot] = length
                        slot = 2 * slot + 1
                else:
                    self.feature[t, slot], self.cut[t, slot] = r["feature_idx"], r["threshold"]
                    todo += [(r["left"], 2 * slot + 1), (r["right"], 2 * slot + 2)]

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
        base = rows * width
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            slot = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                slot = 2 * slot + 1 + (flat[base + feature[slot]] > cut[slot])
            total += path[slot]
        return total / len(self.feature)


@dataclass(frozen=True)
class Model:
    """Scaler, forest and threshold.  ``forest`` has trees x 511 rows at most."""
    scaler: Scaler
    forest: list
    sample_size: int
    offset: float
    contamination: float
    trees: int
    training_rows: int
    data_source: str = "real"

    @property
    def n_features(self) -> int:
        return len(self.scaler.features)


def path_length_udf(spark: SparkSession, forest: list):
    """Column function over scaled features: mean path length over all trees."""
    shared = spark.sparkContext.broadcast(NodeArrays(forest))

    @F.pandas_udf("double")
    def mean_path(*features: pd.Series) -> pd.Series:
        x = np.column_stack([f.to_numpy(dtype=np.float64) for f in features])
        return pd.Series(shared.value.mean_path(x))

    return mean_path


def with_raw_score(df: DataFrame, raw_features: Sequence[Column], model: Model,
                   name: str = "raw_score") -> DataFrame:
    """Add the unrounded score of every row (before subtracting the offset)."""
    walk = path_length_udf(df.sparkSession, model.forest)
    scaled = model.scaler.columns(list(raw_features))
    df = df.withColumn("_path", walk(*scaled))
    return df.withColumn(name, score_samples(F.col("_path"), model.sample_size)).drop("_path")


def contamination_threshold(scores: DataFrame, column: str, contamination: float,
                            finish_rows: int = FINISH_ROWS) -> float:
    """Score below which the given share of training rows lies."""
    return exact_percentile(scores, column, contamination, finish_rows)


def fit_model(train: DataFrame, columns: Sequence[str], trees: int = K.LABELLED_TREES,
              contamination: float = K.LABELLED_CONTAMINATION, seed: int = K.FOREST_SEED,
              row_key: Column | None = None, data_source: str = "real") -> Model:
    """Scaler, forest and threshold from finite feature columns of normal rows."""
    columns = list(columns)
    total = train.count()
    scaler = Scaler.from_table(fit_scaler(train, columns))
    scaled = scale_features(train, scaler)
    # trees x 511 nodes at most, whatever the size of the training table
    forest = fit_forest(scaled, columns, trees, seed=seed, row_key=row_key, total=total).collect()
    size = min(K.FOREST_SAMPLE_SIZE, total)
    unset = Model(scaler, forest, size, 0.0, contamination, trees, total, data_source)
    # the walk is the costly part: its scores are written once and then ranked
    scored = with_raw_score(train, [F.col(c) for c in columns], unset).select("raw_score")
    scored = stage(scored, "training-scores")
    offset = contamination_threshold(scored, "raw_score", contamination)
    return Model(scaler, forest, size, offset, contamination, trees, total, data_source)
