"""Near-duplicate vectors through random-hyperplane sign hashing.

Equal vectors are one *point* with a weight.  ``TABLES`` tables each hash a
point to the signs of ``PLANES`` fixed random projections.  At cosine 0.98 two
points agree in one table with probability 0.265, so they meet in at least one
of 24 with probability 0.9994; closer pairs meet more surely.  Points that
share a bucket are compared by exact cosine in double precision, with matrix
products over blocks of at most ``2 * BLOCK`` points.  A larger bucket is cut
into blocks, and every pair of blocks is one unit of work.  A pair that meets
in several tables counts only in the first of them, so link counts need no
list of pairs; what leaves a block is a count per point and a few edges that
hold its linked points together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.graph import connected_components
from tidewatch.session import stage

THRESHOLD = 0.98
TABLES, PLANES, SEED = 24, 20, 7
BLOCK = 512
BIN_ROWS = 20_000


@lru_cache
def hyperplanes(dims: int, tables: int = TABLES, planes: int = PLANES) -> np.ndarray:
    """Normal vectors of the hyperplanes; the same for every process."""
    return np.random.default_rng([SEED, dims]).standard_normal((dims, tables * planes))


def signatures(vectors: np.ndarray, tables: int = TABLES, planes: int = PLANES) -> np.ndarray:
    """Bucket number of every vector in every table."""
    signs = vectors @ hyperplanes(vectors.shape[1], tables, planes) > 0
    return signs.reshape(len(vectors), tables, planes) @ (1 << np.arange(planes, dtype=np.int64))


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = batch[["point", "mark", "label"]].copy()
        keys = np.empty(len(batch), object)
        for _, rows in batch.groupby(batch.vec.map(len)).indices.items():
            for row, key in zip(rows, signatures(np.stack(batch.vec.iloc[rows]).astype(float)), strict=True):
                keys[row] = key
        out["vec"], out["keys"] = batch.vec, keys
        yield out


def _linked(vectors: np.ndarray, keys: np.ndarray, table: int, side: np.ndarray | None,
            threshold: float) -> np.ndarray:
    """Which pairs of a block link and meet in this table first; ``side`` limits them to pairs across it."""
    cosine = vectors @ vectors.T
    linked = cosine >= threshold
    np.fill_diagonal(linked, False)
    for earlier in range(table):
        if not linked.any():
            break
        linked &= keys[:, earlier][:, None] != keys[:, earlier][None, :]
    if side is not None:
        linked &= side[:, None] != side[None, :]
    return linked


def _local_roots(linked: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Smallest point reachable inside the block."""
    roots = points.copy()
    while True:
        seen = np.minimum(roots, np.where(linked, roots[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (seen == roots).all():
            return roots
        roots = seen


def _compare(threshold: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, table, _, one, other), block in rows.groupby(["label", "tab", "key", "one", "other"], sort=False):
            if len(block) < 2:
                continue
            points, weight = block.point.to_numpy(), block.weight.to_numpy()
            for _, same in block.groupby(block.vec.map(len)).indices.items():
                vectors = np.stack(block.vec.iloc[same]).astype(float)
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
                side = block.part.to_numpy()[same] if one != other else None
                linked = _linked(vectors, np.stack(block["keys"].iloc[same]), int(table), side, threshold)
                if linked.any():
                    found.append(pd.DataFrame({
                        "point": points[same], "mark": block.mark.to_numpy()[same],
                        "root": _local_roots(linked, points[same]), "links": linked @ weight[same]}))
        out = pd.concat(found) if found else pd.DataFrame({"point": [], "mark": [], "root": [], "links": []})
        return out[out.links > 0]
    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: number of vectors linked to it, its component, and whether it stays.

    Vectors link when their labels are equal and not null, their lengths are
    equal and their cosine in double precision reaches ``threshold``.  Null
    and zero vectors, and vectors with a null or non-finite component, link
    with nothing; nor does a row without ``vec_id``, whose component is null
    and which stays.  Equal vectors of one label link with each other.  Rows
    that repeat an id count as vectors of their own.  An empty table gives no
    rows; other columns are ignored.
    """
    vec = F.col("embedding").cast("array<double>")
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull()
             & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
             & F.exists(vec, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding",
                          F.coalesce(sound, F.lit(False)).alias("sound"))
    grouped = stage(rows.filter("sound").groupBy("label", "embedding")
                    .agg(F.min("vec_id").alias("point"), F.count("*").alias("weight"))
                    .withColumn("mark", F.xxhash64("embedding")), "points")
    one = ["point", "mark", "label"]
    kinds = dict(grouped.dtypes)
    signed = stage(grouped.select(*one, F.col("embedding").alias("vec")).mapInPandas(
        _sign, f"point long, mark long, label {kinds['label']}, vec {kinds['embedding']}, keys array<long>"),
        "signatures")
    slots = signed.select(*one, F.posexplode("keys").alias("tab", "key"))
    shared = stage(slots.groupBy("label", "tab", "key").agg(F.count("*").alias("n")).filter("n > 1")
                   .withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")), "shared-buckets")
    work = shared.agg(F.coalesce(F.sum(F.col("n") * F.col("parts")), F.lit(0))).first()[0]
    bins = max(-(-work // BIN_ROWS), vectors.sparkSession.sparkContext.defaultParallelism)
    placed = (slots.join(shared, ["label", "tab", "key"])
              .withColumn("part", F.pmod(F.xxhash64("point", "mark"), F.col("parts")).cast("int"))
              .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select(*one, "tab", "key", "part", F.least("part", "mate").alias("one"),
                      F.greatest("part", "mate").alias("other")))
    full = placed.join(signed, one).join(grouped.select(*one, "weight"), one)
    found = stage(full.groupBy(F.pmod(F.xxhash64("label", "tab", "key", "one", "other"), F.lit(bins)).alias("bin"))
                  .applyInPandas(_compare(threshold), "point long, mark long, root long, links long"), "links")
    roots = connected_components(found.select(F.col("point").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("point", "mark").agg(F.sum("links").alias("others"))
    named = (grouped.join(counts, ["point", "mark"], "left").join(roots, grouped["point"] == roots["node"], "left")
             .select("label", "embedding", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("root", "point").alias("component_id")))
    joined = rows.filter("sound").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    return (joined.unionByName(alone)
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
