"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed letter trigrams: logarithmic counts times
inverse document frequency, half of the slots with a minus sign and folded onto
the other half, scaled to length one.  Chance collisions so cancel out, and
unrelated texts have a cosine near zero.  Document frequencies are
counted over all training rows.  Per language, a bounded sample of training
rows is clustered into a few centroids (spherical k-means).  A text takes the
language of the centroid with the largest cosine and is rejected when even
that cosine is too small, that is, when it lies far from every language.  How
small is learned: per language and number of letters, from the cosines that
training rows and their beginnings have to the centroids made without them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

DIMS = 16384
FOLDED = DIMS // 2
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 1000  # rows that a language's centroids are fitted on
MAX_LANGUAGES = 10_000
MIN_COSINE = 0.02  # only when no language has enough rows to learn a limit from
LOW, MARGIN = 0.01, 0.5  # the limit is a share of a low quantile of the training rows
FEWEST = 30  # texts that the limit for a number of letters is learned from
BEGINNINGS = 300  # rows per language whose beginnings are taken
BINS = 24  # powers of two of the number of letters
CHUNK_CHARS = 1 << 19
BATCH_ROWS = "500"
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(point).isalpha() for point in range(0x110000)), bool, 0x110000)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the trigram around every code point; -1 where that is no letter.  Ends are padded."""
    letters = _letters()[codes]
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = np.where(letters, codes, 0)
    mixed = (padded[:-2] * np.uint32(2654435761) ^ padded[1:-1] * np.uint32(2246822519)
             ^ padded[2:] * np.uint32(3266489917))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(668265263)
    return np.where(letters, (mixed >> np.uint32(12)).astype(np.int64) & (DIMS - 1), -1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text) + 1
        if size > CHUNK_CHARS or len(group) == 256:
            yield group
            group, size = [], 0
    if group:
        yield group


def gram_counts(texts: list[str]) -> np.ndarray:
    """Trigram counts, a row per text.  A very long text is read in overlapping slices."""
    out = np.zeros((len(texts), DIMS), np.float32)
    at = 0
    for group in _groups(texts):
        long = [text for text in group if len(text) > CHUNK_CHARS]
        joined = _codes("\n".join("" if len(text) > CHUNK_CHARS else text.lower() for text in group))
        owner = np.cumsum(joined == 10)  # a line end inside a text is told apart below
        if "\n" in "".join(text for text in group if len(text) <= CHUNK_CHARS):
            sizes = [0 if len(text) > CHUNK_CHARS else len(text.lower()) for text in group]
            owner = np.repeat(np.arange(len(group)), [size + 1 for size in sizes])[:len(joined)]
        grams = _grams(joined)
        seen = grams >= 0
        counts = np.bincount(owner[seen] * DIMS + grams[seen], minlength=len(group) * DIMS)
        out[at:at + len(group)] = counts.reshape(len(group), DIMS)
        for row, text in enumerate(group):
            if long and len(text) > CHUNK_CHARS:
                out[at + row] = _sliced(text)
        at += len(group)
    return out


def _sliced(text: str) -> np.ndarray:
    total = np.zeros(DIMS, np.int64)
    for begin in range(0, len(text), CHUNK_CHARS):
        codes = _codes(text[max(0, begin - 1):begin + CHUNK_CHARS + 1])
        grams = _grams(codes)[1 if begin else 0:]
        grams = grams[:CHUNK_CHARS] if begin + CHUNK_CHARS < len(text) else grams
        total += np.bincount(grams[grams >= 0], minlength=DIMS)
    return total


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts) * idf
    out = out[:, :FOLDED] - out[:, FOLDED:]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def _bins(counts: np.ndarray) -> np.ndarray:
    """Power of two of the number of letters."""
    return np.clip(np.log2(np.maximum(counts.sum(axis=1, dtype=np.float64), 1)).astype(np.int64), 0, BINS - 1)


def _limits(texts: list[str], data: np.ndarray, nearest: np.ndarray, sums: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Limit per number of letters, from whole texts and their beginnings; NaN when there are too few.

    A text is compared with the centroids as they are without it.
    """
    bins, cosines = [], []
    own = np.arange(len(data))
    for power in (*range(2, 14), None):
        take = slice(None if power is None else BEGINNINGS)
        counts = gram_counts([text if power is None else text[:3 << power - 1] for text in texts[take]])
        part, at, whole = _vectors(counts, idf), nearest[take], data[take]
        rest = sums[at] - whole
        norms = np.linalg.norm(rest, axis=1)
        near = part @ (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).T
        near[own[:len(part)], at] = np.where(norms > 1e-3, (part * rest).sum(axis=1) / np.maximum(norms, 1e-3), -1)
        best = near.max(axis=1)
        seen = counts.any(axis=1) & (best > -1)
        bins.append(_bins(counts)[seen])
        cosines.append(best[seen])
    most = MARGIN * np.quantile(cosines[-1], LOW) if len(cosines[-1]) else 0.0  # whole texts of every length
    bins, cosines = np.concatenate(bins), np.concatenate(cosines)
    out = np.full(BINS, np.nan)
    learned = np.flatnonzero(np.bincount(bins, minlength=BINS) >= FEWEST)
    if not len(learned):
        return out
    for k in learned:
        out[k] = np.clip(MARGIN * np.quantile(cosines[bins == k], LOW), 0, max(0.0, most))
    out[learned[-1]:] = out[learned[-1]]  # what is longer goes by the longest
    out[:learned[0]] = 0  # too short to judge
    return np.fmin.accumulate(out[::-1])[::-1]  # a shorter text never needs more


@dataclass
class LanguageModel:
    names: list[str]  # a language per centroid
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray  # smallest cosine by centroid and number of letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to its nearest centroid, and whether the text is rejected."""
        best = np.zeros(len(texts), np.int64)
        cosine = np.zeros(len(texts))
        letters = np.zeros(len(texts), bool)
        limit = np.zeros(len(texts))
        at = 0
        for group in _groups(texts):
            counts = gram_counts(group)
            rows = slice(at, at + len(group))
            letters[rows] = counts.any(axis=1)
            if len(self.names):
                near = _vectors(counts, self.idf) @ self.centroids.T
                best[rows] = near.argmax(axis=1)
                cosine[rows] = np.clip(near.max(axis=1), 0, 1)
                limit[rows] = self.limits[best[rows], _bins(counts)]
            at += len(group)
        known = letters & bool(self.names)
        names = [self.names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
        cosine[~known] = 0
        return names, cosine, ~known | (cosine < limit)


def _document_frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, rows = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for group in _groups(list(batch.text)):
            total += (gram_counts(group) > 0).sum(axis=0)
            rows += len(group)
    grams = np.append(np.flatnonzero(total), -1)  # -1 counts the rows
    yield pd.DataFrame({"gram": grams, "n": np.append(total[grams[:-1]], rows)})


def _clusters(idf: np.ndarray):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "text"]).head(SAMPLE_PER_LANGUAGE)
        data = _vectors(gram_counts(list(rows.text)), idf)
        usable = data.any(axis=1)
        texts, data = list(rows.text[usable]), data[usable]
        if not len(data):
            return pd.DataFrame({"lang": [], "centroid": [], "limits": []})
        mean = data.mean(axis=0)
        chosen = [int((data @ mean).argmax())]
        while len(chosen) < min(CENTROIDS, len(data)):  # each next start is the text farthest from the others
            chosen.append(int((data @ data[chosen].T).max(axis=1).argmin()))
        centres = data[chosen]
        for _ in range(10):
            nearest = (data @ centres.T).argmax(axis=1)
            sums = np.stack([data[nearest == k].sum(axis=0) for k in range(len(centres))])
            empty = ~sums.any(axis=1)
            sums[empty] = centres[empty]
            centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        nearest = (data @ centres.T).argmax(axis=1)
        sums = np.stack([data[nearest == k].sum(axis=0) for k in range(len(centres))])
        limits = _limits(texts, data, nearest, sums, idf).astype(np.float32)
        return pd.DataFrame({"lang": rows.lang.iloc[0], "centroid": list(centres.astype(np.float32)),
                             "limits": [limits] * len(centres)})
    return fit


def fit(train: DataFrame) -> LanguageModel:
    """Learn from ``doc_id``, ``text`` and ``lang``; rows without a language are left out.

    More than ``MAX_LANGUAGES`` values of ``lang`` are an error.
    """
    spark = train.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    rows = train.filter("lang is not null").select(
        F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
        ((F.xxhash64("doc_id").bitwiseAND(0xFFFFFFF)) / F.lit(float(1 << 28))).alias("draw"))
    seen = (rows.select("text").mapInPandas(_document_frequency, "gram int, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).collect())  # at most DIMS + 1 rows
    frequency = np.zeros(DIMS)
    documents = 0
    for gram, n in seen:
        if gram < 0:
            documents = n
        else:
            frequency[gram] = n
    idf = (np.log((1 + documents) / (1 + frequency)) + 1).astype(np.float32)
    counts = rows.groupBy("lang").agg((SAMPLE_PER_LANGUAGE / F.count("*")).alias("share")).limit(
        MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = spark.createDataFrame(counts, "lang string, share double")
    sample = rows.join(F.broadcast(shares), "lang").filter("draw < share").select("lang", "text", "draw")
    centroids = sample.groupBy("lang").applyInPandas(_clusters(idf), "lang string, centroid array<float>, limits array<float>")
    found = sorted((row["lang"], row["centroid"], row["limits"]) for row in centroids.collect())
    limits = np.array([limit for _, _, limit in found], np.float32).reshape(-1, BINS)
    learned = limits[~np.isnan(limits).any(axis=1)]
    limits = np.where(np.isnan(limits), learned.min(axis=0) if len(learned) else MIN_COSINE, limits)
    return LanguageModel([name for name, _, _ in found],
                         np.array([centre for _, centre, _ in found], np.float32).reshape(-1, FOLDED), idf, limits)


def _told(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``row``, the columns named in ``keep``, and ``said``, what the model says of the text."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, cosine, rejected = held.value.predict(list(texts))
        return pd.DataFrame({"lang_pred": names, "score": cosine, "rejected": rejected})

    return docs.select(F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row"),
                       predict(F.coalesce("text", F.lit(""))).alias("said"))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``lang_pred``, ``score`` and ``rejected`` for every row, after its columns named in ``keep``.

    ``score`` is the cosine to the nearest centroid.  A text that is null or
    has no letter gets ``und``, score 0 and is rejected; so does every text
    when the model has learned no language.  Of equal cosines the language
    that sorts first wins.  Repeated rows give repeated rows; an empty table
    gives none.
    """
    return _told(docs, model, keep).select("row.*", "said.*")


def held_out(fold: int = 5):
    """Whether a row is kept from training: CRC-32 of its id as text, modulo ``fold``, is 0 (no id: held out)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % fold == 0


def languages(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    model = fit(docs.filter(~held_out()))
    return identify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns."""
    model = fit(docs.filter(~held_out()))
    return _told(docs, model, docs.columns).filter("not said.rejected").select("row.*")
