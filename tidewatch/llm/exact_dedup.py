"""Exact duplicates through a bucketed cuckoo-filter index of text digests.

The index is a table of live digests, dealt into buckets by a hash of the
digest.  Every bucket carries a cuckoo filter (four 16-bit fingerprints per
cell, two candidate cells per key) beside its stored keys.  A digest that the
filter does not know is new and is inserted; a digest that it seems to know is
verified against the bucket's stored content (SHA-256 and byte length), so a
false hit costs one look-up and never a wrong answer.  Deleting a digest
removes its fingerprint.  When an insertion finds no free place the filter is
doubled and filled again from the stored keys.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.session import stage

CELL, KICKS = 4, 200
SALTS = 16
BUCKET_KEYS = 2048
INDEX = ("bucket int, kind string, sha binary, octets long, live long, keep_id long, "
         "cells int, filter binary")


class CuckooFilter:
    """Approximate set of 64-bit keys with insertion and deletion."""

    def __init__(self, cells: int = 64, table: np.ndarray | None = None):
        self.cells = cells
        self.table = np.zeros((cells, CELL), np.uint16) if table is None else table
        self._random = random.Random(cells)

    def _places(self, key: int) -> tuple[int, int, int]:
        print_ = (key & 0xFFFF) or 1
        first = (key >> 16) & (self.cells - 1)
        return print_, first, self._other(first, print_)

    def _other(self, cell: int, print_: int) -> int:
        return (cell ^ (print_ * 0x5BD1E995)) & (self.cells - 1)

    def __contains__(self, key: int) -> bool:
        print_, first, second = self._places(key)
        return bool((self.table[first] == print_).any() or (self.table[second] == print_).any())

    def insert(self, key: int) -> bool:
        """False when no place could be freed; the filter then has to be rebuilt larger."""
        print_, cell, second = self._places(key)
        for place in (cell, second):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = print_
                return True
        for _ in range(KICKS):
            slot = self._random.randrange(CELL)
            print_, self.table[cell, slot] = int(self.table[cell, slot]), print_
            cell = self._other(cell, print_)
            free = np.flatnonzero(self.table[cell] == 0)
            if len(free):
                self.table[cell, free[0]] = print_
                return True
        return False

    def delete(self, key: int) -> None:
        print_, first, second = self._places(key)
        for place in (first, second):
            held = np.flatnonzero(self.table[place] == print_)
            if len(held):
                self.table[place, held[0]] = 0
                return


class Bucket:
    """One bucket of the index: stored keys and the filter in front of them."""

    def __init__(self, held: pd.DataFrame):
        keys, blob = held[held.kind == "key"], held[held.kind == "filter"]
        self.stored = {sha: [octets, live, keep] for sha, octets, live, keep
                       in zip(keys["sha"], keys.octets, keys.live, keys.keep_id, strict=True)}
        if len(blob):
            cells = int(blob.cells.iloc[0])
            table = np.frombuffer(blob["filter"].iloc[0], np.uint16).reshape(cells, CELL).copy()
            self.filter = CuckooFilter(cells, table)
        else:
            self.filter = CuckooFilter()
            for sha in self.stored:
                self._remember(sha)

    @staticmethod
    def _key(sha: bytes) -> int:
        return int.from_bytes(sha[:8], "little")

    def _remember(self, sha: bytes) -> None:
        if self.filter.insert(self._key(sha)):
            return
        cells = self.filter.cells
        while True:
            cells *= 2
            self.filter = CuckooFilter(cells)
            if all(self.filter.insert(self._key(each)) for each in self.stored):
                return

    def add(self, sha: bytes, octets: int, live: int, keep) -> None:
        if self._key(sha) in self.filter and (known := self.stored.get(sha)) is not None:
            if known[0] != octets:
                raise ValueError("two texts of different length share one SHA-256 digest")
            known[1] += live
            known[2] = _larger(known[2], keep)
            return
        self.stored[sha] = [octets, live, keep]
        self._remember(sha)

    def remove(self, sha: bytes) -> None:
        if self._key(sha) in self.filter and self.stored.pop(sha, None) is not None:
            self.filter.delete(self._key(sha))

    def frame(self, number: int) -> pd.DataFrame:
        rows = [(number, "key", sha, octets, live, keep, None, None)
                for sha, (octets, live, keep) in self.stored.items()]
        rows.append((number, "filter", None, None, None, None, self.filter.cells, self.filter.table.tobytes()))
        out = pd.DataFrame(rows, columns=["bucket", "kind", "sha", "octets", "live", "keep_id", "cells", "filter"])
        return out.astype({"octets": "Int64", "live": "Int64", "keep_id": "Int64", "cells": "Int32"})


def _larger(one, other):
    if pd.isna(one):
        return other
    return one if pd.isna(other) else max(one, other)


def _apply(changes: pd.DataFrame) -> pd.DataFrame:
    bucket = Bucket(changes[changes.change == "held"])
    for row in changes[changes.change != "held"].itertuples(index=False):
        if row.change == "insert":
            bucket.add(row.sha, row.octets, row.live, row.keep_id)
        else:
            bucket.remove(row.sha)
    return bucket.frame(int(changes.bucket.iloc[0]))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, SHA-256 and byte length of every text; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"),
                       F.octet_length(text).cast("long").alias("octets"))


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("sha"), F.lit(buckets)).cast("int")


def update_index(index: DataFrame | None, buckets: int, inserts: DataFrame | None = None,
                 deletes: DataFrame | None = None) -> DataFrame:
    """Apply deletions of digests, then insertions, to an index and return the new one.

    ``inserts`` are rows of :func:`digests`.  They are combined by digest and
    one of ``SALTS`` salts before they are dealt to buckets, so a text that
    makes up a third of the corpus reaches its bucket as sixteen rows.
    ``deletes`` needs a ``sha`` column.  ``buckets`` is fixed for the life of
    an index; a bucket should hold some thousand digests.
    """
    parts = []
    none = {name: F.lit(None).cast(kind) for name, kind in
            (("kind", "string"), ("octets", "long"), ("live", "long"), ("keep_id", "long"),
             ("cells", "int"), ("filter", "binary"))}
    order = ["bucket", "change", "kind", "sha", "octets", "live", "keep_id", "cells", "filter"]
    if index is not None:
        parts.append(index.withColumn("change", F.lit("held")).select(order))
    if deletes is not None:
        gone = deletes.select("sha").distinct().withColumns(none)
        parts.append(gone.withColumns({"bucket": bucket_of(buckets), "change": F.lit("delete")}).select(order))
    if inserts is not None:
        salted = (inserts.groupBy("sha", "octets", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
                  .agg(F.count("*").alias("live"), F.max("doc_id").alias("keep_id")))
        fresh = salted.withColumns({name: none[name] for name in ("kind", "cells", "filter")})
        parts.append(fresh.withColumns({"bucket": bucket_of(buckets), "change": F.lit("insert")}).select(order))
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part)
    return changes.groupBy("bucket").applyInPandas(_in_order, INDEX)


def _in_order(changes: pd.DataFrame) -> pd.DataFrame:
    """Held rows first, then deletions, then insertions."""
    rank = changes.change.map({"held": 0, "delete": 1, "insert": 2})
    typed = changes.astype({"octets": "Int64", "live": "Int64", "keep_id": "Int64"})
    return _apply(typed.iloc[np.argsort(rank.to_numpy(), kind="stable")])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: the row that stays of its equal texts, and the size of the group.

    Texts are equal when they are identical; null counts as empty.  Of equal
    texts the row with the largest ``doc_id`` stays.  A null id stays only when
    no row of its group has an id; rows that repeat both id and text stay or
    go together.  An empty table gives no rows; other columns are ignored.
    """
    seen = stage(digests(docs), "digests")
    buckets = max(1, -(-seen.count() // BUCKET_KEYS))
    index = stage(update_index(None, buckets, seen), "cuckoo-index")
    live = index.filter("kind = 'key'").select("sha", "keep_id", F.col("live").alias("group_size"))
    return seen.join(live, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Those that go are a stored table of ids and digests; where it is small
    enough for a broadcast, no text is shuffled.
    """
    gone = stage(exact_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_id"),
                                                                  F.unhex("text_sha256").alias("_sha")).distinct(), "gone")
    sha = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (sha == gone["_sha"]), "left_anti")


def rows_of(index: DataFrame) -> Iterator:
    """Live digests of an index as ``sha``, ``octets``, ``live``, ``keep_id`` rows, without the filters."""
    return index.filter("kind = 'key'").select("sha", "octets", "live", "keep_id")
