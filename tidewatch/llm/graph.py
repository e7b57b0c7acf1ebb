"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.session import stage

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` holds two long columns ``a`` and ``b``, in any direction, with
    repeats and self-loops allowed; rows with a null end are ignored.  Returns
    ``node``, ``root`` for nodes with at least one edge to another node.

    Alternates large-star and small-star steps, which need a number of rounds
    that is logarithmic in the size of a component.  A step is one aggregation
    (combined before the shuffle) and one join, so a node with very many edges
    is never gathered in one task.  Every round is written to the shared
    folder, so a lost executor repeats one round at most; the driver sees only
    a count and a checksum per round.
    """
    edges = (edges.filter("a <> b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = stage(edges, "edges")
    before = _signature(edges)
    for _ in range(MAX_ROUNDS):
        edges = stage(_small_star(_large_star(edges)), "edges")
        after = _signature(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = (edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
