"""Periodic runs of words, found by internal pattern matching.

A *run* is a stretch of consecutive words with smallest period ``q`` that no
neighbouring word extends, at least ``max(SHORTEST, 4 * q)`` words long.  All
runs are found, exactly:

* The *dictionary of factors* names every stretch of ``2**k`` words by the
  place where its class begins in the suffix array (prefix doubling), so two
  stretches are equal if their names are, and the occurrences of a stretch
  are one interval of the suffix array.
* A run of period ``q`` holds an aligned (*dyadic*) block of
  ``block_words(q)`` words, and its copy ``q`` words later.  Every block asks
  for its occurrences in the window of distances that belong to its size, by
  range successor over the wavelet matrix of the suffix array.
* The window is shorter than the block, so three occurrences or more are an
  arithmetic progression and the block has a small period of its own.  Then
  the only candidate for ``q`` is the distance between the ends of the two
  small-period stretches; else the occurrences are the candidates.
* A candidate is a run when its agreement with the text shifted by ``q``,
  read off the dictionary in both directions, is long enough.  Of equal
  stretches the smallest period stays.

Texts are joined into batches of some hundred thousand words, with a mark of
its own after every text, and all steps run over a whole batch at once.  A
longer text is a batch by itself; work is ``O(n log n)`` whatever it repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SHORTEST = 6
REPEATS = 4
BATCH_WORDS = 1 << 17

Words = list[bytes]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def least_length(period):
    return np.maximum(SHORTEST, REPEATS * period)


def block_words(period: int) -> int:
    """Largest power of two so that a run of this period surely holds an aligned block and its next copy."""
    return 1 << ((int(least_length(period)) - period + 1) // 2).bit_length() - 1


def windows(longest: int) -> Iterator[tuple[int, int, int]]:
    """Level, least and greatest period of the blocks of every size that runs of at most ``longest`` words need."""
    low, top = 1, longest // REPEATS
    while low <= top:
        high = low
        while high < top and block_words(high + 1) == block_words(low):
            high += 1
        yield block_words(low).bit_length() - 1, low, high
        low = high + 1


class Factors:
    """Names of all stretches of ``2**k`` words, and the suffix array as far as its order matters."""

    def __init__(self, codes: np.ndarray, levels: int):
        n = len(codes)
        self.order = np.argsort(codes, kind="stable")
        begins = np.append(True, np.diff(codes[self.order]) != 0)
        name = np.empty(n, np.int64)
        name[self.order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        self.names = [name]
        for level in range(levels):
            shared = ~(begins & np.append(begins[1:], True))  # places of classes with several members
            slots = np.flatnonzero(shared)
            if not len(slots):
                break
            members = self.order[slots]
            step = 1 << level
            follow = np.where(members + step < n, name[np.minimum(members + step, n - 1)], -1)
            inner = np.lexsort((follow, name[members]))
            members, follow = members[inner], follow[inner]
            self.order[slots] = members
            apart = np.append(True, (np.diff(name[members]) != 0) | (np.diff(follow) != 0))
            begins = begins.copy()
            begins[slots] = apart
            name = name.copy()
            name[members] = np.maximum.accumulate(np.where(apart, slots, 0))
            self.names.append(name)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that agree from ``a`` and ``b`` on; ``a < b``."""
        return self._agree(a, b, False)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that agree before ``a`` and ``b``."""
        return self._agree(a, b, True)

    def _agree(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            active = np.arange(len(a))
            while len(active):
                shift = -length[active] - step if back else length[active]
                one, other = a[active] + shift, b[active] + shift
                same = (one >= 0) & (name[one] == name[other])
                active = active[same]
                length[active] += step
                if level < len(self.names) - 1:
                    break  # below the top level one step is all there is
        return length


class Wavelet:
    """Wavelet matrix over the suffix array: order statistics of an interval, for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = len(values).bit_length()
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            self.zeros.append(np.append(0, np.cumsum(~ones, dtype=np.int64)).astype(np.int32))
            values = np.concatenate([values[~ones], values[ones]])

    def less(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of ``[low, high)`` are below ``bound``."""
        found = np.zeros(len(low), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (bound >> (self.bits - 1 - level) & 1).astype(bool)
            low0, high0 = zeros[low], zeros[high]
            found += np.where(one, high0 - low0, 0)
            low = np.where(one, zeros[-1] + low - low0, low0)
            high = np.where(one, zeros[-1] + high - high0, high0)
        return found

    def place(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of this rank, from 0, in ``[low, high)``."""
        value = np.zeros(len(low), np.int64)
        for level, zeros in enumerate(self.zeros):
            low0, high0 = zeros[low], zeros[high]
            one = rank >= high0 - low0
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            rank = np.where(one, rank - (high0 - low0), rank)
            low = np.where(one, zeros[-1] + low - low0, low0)
            high = np.where(one, zeros[-1] + high - high0, high0)
        return value


def _candidates(factors: Factors, wavelet: Wavelet, level: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and the periods from ``low`` to ``high`` that their occurrences suggest."""
    name = factors.names[level]
    n = len(name)
    blocks = np.arange(0, n, 1 << level)
    size = np.bincount(name, minlength=n)
    blocks = blocks[size[name[blocks]] > 1]
    first, last = name[blocks], name[blocks] + size[name[blocks]]
    before = wavelet.less(first, last, np.minimum(blocks + low, n))
    upto = wavelet.less(first, last, np.minimum(blocks + high + 1, n))
    hit = upto > before
    blocks, first, last, before, upto = (x[hit] for x in (blocks, first, last, before, upto))
    nearest = wavelet.place(first, last, before)  # the range successor of block + low
    furthest = wavelet.place(first, last, upto - 1)
    count = upto - before
    few, many = count < 3, np.flatnonzero(count >= 3)
    step = (furthest[many] - nearest[many]) // (count[many] - 1)
    ends = [at + step + factors.ahead(at, at + step) for at in (blocks[many], nearest[many])]
    at = np.concatenate([blocks[few], blocks[few], blocks[many]])
    period = np.concatenate([(nearest - blocks)[few], (furthest - blocks)[few], ends[1] - ends[0]])
    sound = (period >= low) & (period <= high)
    return at[sound], period[sound]


def runs_of(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a sequence of word numbers, by start, then period.

    ``longest`` bounds the length of a run.  The last number must occur once.
    """
    none = np.zeros(0, np.int64)
    wanted = list(windows(longest))
    if not wanted:
        return none, none, none
    factors = Factors(codes, wanted[-1][0])
    wavelet = Wavelet(factors.order)
    found = []
    for level, low, high in wanted:
        if level >= len(factors.names):
            break  # no stretch of this size occurs twice
        at, period = _candidates(factors, wavelet, level, low, high)
        ahead = factors.ahead(at, at + period)
        behind = factors.behind(at, at + period)
        length = behind + period + ahead
        runs = np.stack([at - behind, length, period], axis=1)
        found.append(runs[length >= least_length(period)])
    every = np.unique(np.concatenate(found or [np.zeros((0, 3), np.int64)]), axis=0)
    # equal stretches stand together, the smallest period first
    fresh = np.append(True, (np.diff(every[:, 0]) != 0) | (np.diff(every[:, 1]) != 0))[:len(every)]
    every = every[fresh]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def _batches(records: Iterator[pa.RecordBatch], reword) -> Iterator[tuple[list, list[Words]]]:
    """Ids and words of some whole texts at a time."""
    ids, texts, size = [], [], 0
    for record in records:
        for doc, text in zip(record.column(0), record.column(1), strict=True):
            doc, words = doc.as_py(), (text.as_py() or "").encode().split()
            ids.append(doc)
            texts.append(reword(doc, words) if reword else words)
            size += len(texts[-1])
            if size >= BATCH_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _find(texts: list[Words]) -> tuple[pa.Array, list[str]]:
    """Runs of every text, and its words without the repeats, joined by spaces."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)  # behind the mark that closes a text
    starts = ends - sizes - 1
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = list(chain.from_iterable(texts))
    numbers, known = pd.factorize(flat)
    codes = np.empty(int(ends[-1]), np.int64)
    marks = np.zeros(len(codes), bool)
    marks[ends - 1] = True
    codes[~marks] = numbers
    codes[marks] = len(known) + np.arange(len(texts))
    at, length, period = runs_of(codes, int(sizes.max()))
    owner = np.searchsorted(ends, at, side="right")
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    dropped = np.zeros(len(codes) + 1, np.int64)
    np.add.at(dropped, at + period, 1)
    np.add.at(dropped, at + length, -1)
    keep = np.cumsum(dropped) == 0
    kept = [b" ".join(words if bounds[k] == bounds[k + 1] else
                      compress(words, keep[starts[k]:starts[k] + len(words)].tolist())).decode()
            for k, words in enumerate(texts)]
    rows = pa.StructArray.from_arrays([pa.array(at - starts[owner]), pa.array(length), pa.array(period)],
                                      names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows).cast(_RUN_TYPE), kept


def _scan(reword):
    def scan(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(records, reword):
            runs, kept = _find(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), runs, pa.array(kept, pa.string())],
                                             names=["doc_id", "runs", "collapsed"])
    return scan


def periodic_runs(docs: DataFrame, reword: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """One row per document: ``runs``, by start then period, and the ``collapsed`` text.

    Words are what stands between ASCII white space, numbered from 0.
    ``collapsed`` leaves out every word that a run contains after its first
    period, and joins the others by one space.  ``reword`` may replace the
    words of a text, given its id, before they are searched.

    A null or empty text has no run and collapses to an empty text; very long
    texts are searched whole, one at a time.  Rows that repeat an id, or have
    none, are searched one by one; equal texts have equal runs.  An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(reword), f"doc_id long, runs {RUNS}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda run: F.struct(
        run["length"].alias("length"), (-run["start"]).alias("back"), (-run["period"]).alias("fast"))))
    written = F.transform("runs", lambda run: F.concat(
        F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.back")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.fast")).alias("period"),
        F.expr("1000 * longest.length div -longest.fast").alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
