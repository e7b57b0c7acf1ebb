"""Packed products and mined negatives against plain Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import hard_negatives


@pytest.mark.parametrize("largest", [1, 3, 250, 2**20, 2**31, 2**40, 2**70])
def test_packed_products(largest):
    r = random.Random(largest)
    rows = [[r.randint(-largest, largest) for _ in range(7)] for _ in range(50)]
    rows[0], rows[1] = [largest] * 7, [-largest] * 7
    numbers = np.array(rows, object if largest >= 2**53 else float)
    packed = hard_negatives.Packed(numbers, largest)
    for anchor in [rows[0], rows[1], rows[2], [0] * 7]:
        assert packed.scores(anchor).tolist() == [sum(a * b for a, b in zip(anchor, row)) for row in rows]


def plain(rows, anchor_step, n_pos=5, n_neg=3, low=50, high=95):
    """Every anchor against every row, with unbounded integers."""
    usable = []
    for k, (vec_id, label, vec) in enumerate(rows):
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(256 * x) for x in vec):
            continue
        usable.append((k, vec_id, label, [math.floor(256.0 * x) for x in vec]))
    out = []
    for k, vec_id, label, vec in usable:
        if vec_id % anchor_step:
            continue
        scored = [(-sum(a * b for a, b in zip(vec, other)), i, kk, lab) for kk, i, lab, other in usable
                  if kk != k and len(other) == len(vec)]
        same = sorted(s[:3] for s in scored if s[3] == label)[:n_pos]
        for minus, positive, _ in same:
            p = -minus
            fits = sorted(s[:3] for s in scored if s[3] != label and low * p <= -100 * s[0] <= high * p)[:n_neg]
            out += [(vec_id, positive, rank, i, p, -m) for rank, (m, i, _) in enumerate(fits, 1)]
    return out


def odd_rows():
    r = np.random.default_rng(4)
    centers = r.normal(size=(3, 6))
    rows = [(int(k), int(k % 4 % 3), (centers[k % 3] + 0.4 * r.normal(size=6)).round(2).tolist()) for k in range(400)]
    rows += rows[:3] + [(400 + k, 0, rows[0][2]) for k in range(5)]  # repeats and ties
    rows += [(None, 1, [1.0] * 6), (500, None, [1.0] * 6), (510, 1, None), (520, 1, [1.0, None] * 3),
             (530, 1, [float("nan")] * 6), (540, 1, [float("inf")] * 6), (550, 1, [0.0] * 6), (560, 1, []), (570, 2, []),
             (580, 1, [1.0, 2.0]), (590, 2, [0.5, 1.9]), (600, 1, [0.9, 2.1]), (610, 2, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("block", [2048, 64])
def test_mined_rows(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns(
        {name: F.lit("clash") for name in ("row", "vec", "dims", "unit", "anchor", "score", "chosen")})
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()
    want = plain(rows, 10)
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(want)


def test_given_rows(spark, sf):
    from tidewatch.llm.queries import QUERIES
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    moved = [(i, (lab + 1) % 10 if i % 7 == 0 and lab is not None else lab, v) for i, lab, v in rows]
    got = QUERIES["op12_hard_negatives"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(plain(moved, 50)) and got


def test_large_numbers(spark):
    rows = [(k, k % 2, [1e12 + k * 1e9, 3e13, -2e11 * k]) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()
    assert all(r.positive_score == 2**63 - 1 for r in got)  # beyond 64 bits


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 10 == 0).count() == 0
