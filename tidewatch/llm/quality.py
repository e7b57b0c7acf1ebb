"""Quality classification by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled
texts.  A text is compressed with either; the difference of the two sizes,
over the square root of its length, tells which kind of text it resembles (the
evidence grows with the length, its noise with the root).  A logistic curve, fitted on
labelled texts that the dictionaries have not seen, turns the difference into
a probability.  Training a dictionary depends on the order of its samples, so
several orders are tried, and the pair that ranks the unseen texts best is kept.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

SAMPLE_PER_CLASS = 3000  # labelled rows per class that the model is fitted on; every fourth one calibrates
DICTIONARY_BYTES = 112_640
LEVEL = 3
PIECE_BYTES = 512  # texts are handed to the training in pieces of this size
ORDERS = 4
OFFSET = 20  # bytes added to the length, so that very short texts give small differences
BATCH_ROWS = "1000"


def dictionary(texts: list[bytes], order: int = 0) -> bytes:
    """A trained dictionary; the texts themselves where there are too few to train on."""
    texts = random.Random(order).sample(texts, len(texts))
    pieces = [text[at:at + PIECE_BYTES] for text in texts for at in range(0, len(text), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content),
                                    write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float = 0.0
    shift: float = 0.0

    def difference(self, text: str) -> float:
        """Bytes that the good dictionary saves over the bad one, over the root of the length."""
        data = text.encode("utf-8", "replace")
        if not data:
            return 0.0
        saved = len(_compressor(self.bad).compress(data)) - len(_compressor(self.good).compress(data))
        return saved / math.sqrt(len(data) + OFFSET)

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.difference(text) + self.shift))))


def ranking(values: np.ndarray, labels: np.ndarray) -> float:
    """Probability that a good text has a larger value than a bad one; ties count half."""
    bad, good = np.sort(values[labels == 0]), values[labels == 1]
    below = np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")
    return float(below.sum() / (2 * len(bad) * len(good)))


def logistic(values: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the most likely logistic curve, with a weak pull to zero (Newton steps).

    ``counts`` says how many rows each value stands for.
    """
    scale = values.std() or 1.0
    data = np.column_stack([values / scale, np.ones(len(values))])
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ weights, -50, 50)))
        gradient = data.T @ (counts * (labels - p)) - 1e-3 * weights
        curvature = (data * (counts * p * (1 - p))[:, None]).T @ data + 1e-3 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn from ``labels`` (``doc_id``, ``quality`` 0 or 1) and the whole texts of ``docs``.

    Per class the ``SAMPLE_PER_CLASS`` rows that come first in the order of a
    hash of the id are used.  An id with both labels, or none, teaches nothing.
    Without examples of both classes every text scores the share of good ones
    (0.5 without any).
    """
    known = (labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most"))
    draws = [known.filter(F.col("quality") == value).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS)
             for value in (0, 1)]
    chosen = draws[0].unionByName(draws[1]).select("id", "quality")  # at most twice SAMPLE_PER_CLASS rows
    rows = (docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "id").groupBy("id", "quality").agg(F.min("text").alias("text"))
            .orderBy(F.xxhash64("id"), "id").collect())
    by_class = [[row["text"] for row in rows if row["quality"] == value] for value in (0, 1)]
    taught = [[text.encode("utf-8", "replace") for k, text in enumerate(texts) if text and k % 4 < 3]
              for texts in by_class]
    held = [(text, value) for value in (0, 1) for text in by_class[value][3::4]]
    if not all(taught) or len({value for _, value in held}) < 2:
        good, total = len(by_class[1]), len(rows)
        share = (good + 1) / (total + 2)
        return QualityModel(b"-", b"-", 0.0, math.log(share / (1 - share)))
    truth = np.array([value for _, value in held], float)
    best = -1.0
    for order in range(ORDERS):
        tried = QualityModel(dictionary(taught[1], order), dictionary(taught[0], order))
        differences = np.array([tried.difference(text) for text, _ in held])
        if (rank := ranking(differences, truth)) > best:
            best, model, values = rank, tried, differences
    # The sample has as many rows of either class; weigh them back to the labelled rows.
    counts = {row["quality"]: row["n"] for row in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    stands_for = {value: counts[value] / max(1, int((truth == value).sum())) for value in (0, 1)}
    scale = len(truth) / (counts[0] + counts[1])
    model.slope, model.shift = logistic(values, truth, np.array([scale * stands_for[int(v)] for v in truth]))
    return model


def scored(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """``score`` and ``predicted`` for every row and whole text, after its columns named in ``keep``.

    A null or empty text has difference 0.  Repeated rows give repeated rows;
    an empty table gives none.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(text) for text in texts], dtype="float64")

    return (docs.select(*keep, score(F.coalesce("text", F.lit(""))).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def held_out(fold: int = 3):
    """Whether a row is kept from training: CRC-32 of its id as text, modulo ``fold``, is 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % fold == 1


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document, learned from the labels of rows that are not held out."""
    model = fit(docs, labels.filter(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return scored(rows, model, ["doc_id", "held_out"])
