"""SimHash near-duplicates through multi-index hashing.

Fingerprints link when at most two of their 64 bits differ.  Each fingerprint
is cut into two 32-bit segments.  If two fingerprints differ in at most two
bits, their high segments differ in at most one bit, or their low segments are
equal; so the high segment is looked up with its Hamming ball of radius one
(33 keys) and the low one as it is.  Every table match is verified on all 64
bits.  Tables hold distinct fingerprints, so copies cost nothing.

A table bucket with more than ``BUCKET_CAP`` fingerprints is not paired.  The
fingerprints that touch such a bucket are linked exactly in another way: two
of them differ in at most two bits if and only if their radius-one balls over
all 64 bits share a point, and no point lies in more than 65 balls.  The work
stays linear however many near copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.graph import connected_components
from tidewatch.llm.rows import numbered, without
from tidewatch.session import stage

SHINGLE, SEED = 3, 42
BUCKET_CAP = 64
# Near copies: 128 bits over two-word shingles in six segments, verified on five-word shingles.
PRINT_SHINGLE, SEGMENTS, SEGMENT_BITS, FLIPS, RADIUS = 2, 6, 21, 4, 26
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
# One bit of the smallest value of each of 256 hashes of the five-word shingles: texts at similarity s differ in
# (1 - s) / 2 of them, 25.6 at 0.8 with a deviation of 4.8.
SKETCH_WORDS, SKETCH_RADIUS = 4, 40
MAX_ROUNDS = 40
SET_ROWS = 500  # texts whose shingles leave Python together
# Texts are paired for a shingle that so many have among their first ones; pairs share this part of the first ones.
SHARED_CAP, KEPT = 64, 0.25
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 32, 64 * SKETCH_WORDS, np.uint32) | np.uint32(1)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of three-word shingles, as a signed integer; zero without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:-SHINGLE + 1].tolist()
        ends = ends[SHINGLE - 1:].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)),
                             np.uint64, len(starts))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch.doc_id, "fp": [fingerprint(text) for text in batch.text]})


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and signed 64-bit fingerprint ``fp`` of every whole text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInPandas(_fingerprints, "doc_id long, fp long")


def links(points: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all links between the distinct ``fp`` of ``points``."""
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(32)]).cast("array<bigint>")
    ball = F.concat(F.transform(flips, lambda flip: high.bitwiseXOR(flip)), F.array(low))
    table = points.select("fp", F.explode(F.array(high, low)).alias("key"))
    probes = points.select("fp", F.explode(ball).alias("key"))
    sizes = table.groupBy("key").agg(F.count("*").alias("n"))
    paired = table.join(sizes.filter(F.col("n") <= cap), "key").select("key", F.col("fp").alias("b"))
    near = (probes.withColumnRenamed("fp", "a").join(paired, "key")
            .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
            .select("a", "b"))
    crowded = probes.join(sizes.filter(F.col("n") > cap).select("key"), "key", "left_semi").select("fp").distinct()
    all_flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(63)], F.lit(-(1 << 63))).cast("array<bigint>")
    points_near = crowded.select(
        "fp", F.explode(F.transform(all_flips, lambda flip: F.col("fp").bitwiseXOR(flip))).alias("point"))
    meeting = (points_near.groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
               .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b"))
    return near.unionByName(meeting)


def near_duplicates(docs: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """One row per document: ``fingerprint`` in hex and the smallest ``doc_id`` reachable by links.

    A null or empty text has fingerprint zero and links like any other.  A row
    whose ``doc_id`` is null takes part in links and gets the smallest id of
    its component, null if there is none.  Texts of any length are read whole.  Repeated rows give repeated rows,
    an empty table none; other columns are ignored.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    points = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = connected_components(links(points, cap))
    rooted = stage(points.join(roots, points["fp"] == roots["node"], "left")
                   .select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies
def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """One 64-bit hash per shingle, repeats included; of a shorter text the whole is one."""
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    return np.fromiter((digest(b" ".join(words[k:k + shingle]), SEED) for k in range(n)), np.uint64, n)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """A second hash made from each first one, with all its bits mixed."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> list[int]:
    """One bit per smallest value of differently multiplied hashes, as signed integers; order and repeats do not count."""
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), 256):
        values = upper[at:at + 256, None] * _FACTORS
        values ^= values >> np.uint32(16)
        values *= np.uint32(0x85EBCA6B)
        np.minimum(least, values.min(axis=0), out=least)
    bits = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8").tolist()


def wide_print(text: str | None, shingle: int = PRINT_SHINGLE, flips: int = FLIPS) -> tuple[int, int, list[int], list[int]]:
    """A 128-bit SimHash as two signed integers, the keys of its segments, and the keys to look up.

    Of the small Hamming ball around a segment those keys are looked up that a
    near copy most likely has: the segment itself, and it with one of the
    ``flips`` bits changed whose votes were closest.
    """
    hashes = _hashes(_words(text), shingle)
    votes = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)]
        both = np.stack([part, _mixed(part)], axis=1).astype("<u8").view(np.uint8)
        votes += 2 * np.unpackbits(both, axis=1, bitorder="little").sum(axis=0, dtype=np.int64) - len(part)
    bits = votes > 0
    own, probes = [], []
    for segment in range(SEGMENTS):
        place = slice(segment * SEGMENT_BITS, (segment + 1) * SEGMENT_BITS)
        key = segment << SEGMENT_BITS | int(bits[place] @ (1 << np.arange(SEGMENT_BITS)))
        own.append(key)
        probes += [key, *(key ^ (1 << int(bit)) for bit in np.argsort(np.abs(votes[place]), kind="stable")[:flips])]
    low, high = np.packbits(bits, bitorder="little").view("<i8").tolist()
    return low, high, own, probes


_MARKS = ("low", "high", *(f"sketch{k}" for k in range(SKETCH_WORDS)))
_WIDE = f"row long, {', '.join(f'{name} long' for name in _MARKS)}, own array<int>, probes array<int>"


def _wide_prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch.text:
            low, high, own, probes = wide_print(text)
            rows.append((low, high, *sketch(_hashes(_words(text), NEAR_SHINGLE)), own, probes))
        yield pd.DataFrame({"row": batch.row, **dict(zip((*_MARKS, "own", "probes"), zip(*rows)))})


def jaccard(one: str | None, other: str | None, shingle: int = NEAR_SHINGLE) -> float:
    """Similarity of the sets of shingles of two texts; one for two texts without words."""
    a, b = (set(_hashes(words, shingle).tolist()) if words else set() for words in (_words(one), _words(other)))
    return len(a & b) / len(a | b) if a or b else 1.0


def _verified(similarity: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [jaccard(one, other) >= similarity for one, other in zip(batch.one, batch.other, strict=True)]
            yield batch.loc[near, ["a", "b"]]
    return verify


def _keyed(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points by their own keys, and by the keys that they look up."""
    own = active.select(F.explode("own").alias("key"), F.col("row").alias("b"), F.col("order").alias("order_b"),
                        *[F.col(name).alias(f"{name}_b") for name in _MARKS])
    return own, active.select(F.explode("probes").alias("key"), F.col("row").alias("a"), "order", *_MARKS)


def _differ(names: Sequence[str]) -> Column:
    return sum((F.bit_count(F.col(name).bitwiseXOR(F.col(f"{name}_b"))) for name in names), F.lit(0))


def _close() -> Column:
    return (_differ(_MARKS[:2]) <= RADIUS) & (_differ(_MARKS[2:]) <= SKETCH_RADIUS)


def _nearest_first(active: DataFrame) -> DataFrame:
    """Per point ``a`` the closest ``b`` among the first points of its keys, if one comes before it: a pair at most."""
    own, probes = _keyed(active)
    first = own.groupBy("key").agg(F.min(F.struct("order_b", *[c for c in own.columns if c not in ("key", "order_b")]))
                                   .alias("first")).select("key", "first.*")
    found = probes.join(first, "key").filter((F.col("order_b") < F.col("order")) & _close())
    return (found.groupBy("a").agg(F.min(F.struct(_differ(_MARKS[2:]).alias("differ"), "order_b", "b")).alias("best"))
            .select("a", "best.b"))


def _all_pairs(active: DataFrame) -> DataFrame:
    """All pairs that share a key and are close on all bits of print and sketch."""
    own, probes = _keyed(active)
    pairs = probes.join(own, "key").filter((F.col("a") != F.col("b")) & _close())
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, len(batch), SET_ROWS):
            part = batch.iloc[at:at + SET_ROWS]
            yield part.row, [np.unique(_hashes(_words(text), NEAR_SHINGLE).view(np.int64)) for text in part.text]


def _shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for row, sets in _sets(batches):
        yield pd.DataFrame({"row": row, "size": list(map(len, sets)), "shingles": sets})


def _more(size, floor, similarity: float):
    """How many shingles beyond one two texts have to share among their first ones, by the size of the smaller.

    A part of the size that pairs of the ``similarity`` surely share.
    """
    return floor(size * (KEPT if similarity >= 2 * KEPT else 0))


def _prefixes(similarity: float):
    """The smallest shingles of every text that :func:`_sharing` wants, with their place, a row each."""
    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, sets in _sets(batches):
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            wanted = sizes - np.ceil(sizes * similarity - 1e-6).astype(np.int64) + 1 + _more(sizes, np.floor, similarity).astype(np.int64)
            sets = [shingles[:n] for shingles, n in zip(sets, wanted.tolist(), strict=True)]
            lengths = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pd.DataFrame({"row": np.repeat(row.to_numpy(), lengths), "size": np.repeat(sizes, lengths),
                                "pos": np.concatenate([np.arange(n) for n in lengths]), "shingle": np.concatenate(sets)})
    return prefixes


def _by_frequency(texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs of :func:`_sharing`, by the shingles that the fewest texts hold; every shingle is shuffled.

    Of two sets of sizes m and n with Jaccard similarity s at least,
    the larger has at most 1/s as many shingles, and the first
    n - ceil(s * n) + 1 shingles of each hold the first one they share.  What
    follows that shingle must be enough for the overlap wanted.  Shingles of
    one text only come first of all and meet nothing, so they only count.
    """
    share = float(similarity)
    sets = texts.mapInPandas(_shingle_sets, "row long, size int, shingles array<long>")
    shingles = sets.select("row", "size", F.explode("shingles").alias("shingle"))
    held = shingles.withColumn("texts", F.count("*").over(Window.partitionBy("shingle"))).filter("texts > 1")
    ordered = held.groupBy("row", "size").agg(F.array_sort(F.collect_list(F.struct("texts", "shingle"))).alias("shared"))
    alone = F.col("size") - F.size("shared")
    wanted = F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1 - alone
    first = stage(ordered.select("row", "size", alone.alias("alone"),
                                 F.posexplode(F.slice("shared", 1, F.greatest(wanted, F.lit(0)).cast("int"))))
                  .select("row", "size", (F.col("alone") + F.col("pos")).alias("pos"), F.col("col.shingle").alias("shingle")),
                  "prefixes")
    one, other = first.alias("one"), first.alias("other")
    left = F.least(*[F.col(f"{side}.size") - F.col(f"{side}.pos") for side in ("one", "other")])
    smaller, larger = (pick("one.size", "other.size") for pick in (F.least, F.greatest))
    enough = left >= share / (1 + share) * (smaller + larger) - 1e-6
    return (one.join(other, "shingle").filter((F.col("one.row") < F.col("other.row")) & (smaller >= share * larger - 1e-6) & enough)
            .select(F.col("one.row").alias("a"), F.col("other.row").alias("b")).distinct())


def _sharing(texts: DataFrame, similarity: float, cap: int = SHARED_CAP) -> DataFrame:
    """Every pair of ``texts`` (``row``, ``text``) whose similarity can reach ``similarity``, by prefix filtering.

    Shingles are ordered by their hash.  Two sets that share at least
    o >= s * n shingles, n being the size of either, have k of these among the
    first n - o + k of each, so among the first n - ceil(s * n) + k.  With k
    growing with n (see :func:`_more`), texts with some lines in common are
    told apart without reading them.

    Shingles that more than ``cap`` texts have there are not paired, but
    counted per text: as many may be missing from the k.  Where they may be all
    of the k, both texts are taken again with the other such texts, by the
    shingles that the fewest texts hold (see :func:`_by_frequency`).  So no
    pair is left out, and the pairs of a frequent line are not formed.
    """
    share = float(similarity)
    first = texts.mapInPandas(_prefixes(share), "row long, size int, pos int, shingle long")
    shared = stage(first.withColumn("texts", F.count("*").over(Window.partitionBy("shingle"))).filter("texts > 1"), "prefixes")
    crowds = stage(shared.filter(F.col("texts") > cap).groupBy("row", "size").agg(F.count("*").alias("crowded")), "crowds")
    few = shared.filter(F.col("texts") <= cap).join(crowds.drop("size"), "row", "left").fillna(0, "crowded")
    one, other = few.alias("one"), few.alias("other")
    smaller, larger = (pick("one.size", "other.size") for pick in (F.least, F.greatest))
    left = F.least(*[F.col(f"{side}.size") - F.col(f"{side}.pos") for side in ("one", "other")])
    both = (one.join(other, "shingle").filter((F.col("one.row") < F.col("other.row")) & (smaller >= share * larger - 1e-6))
            .groupBy(F.col("one.row").alias("a"), F.col("other.row").alias("b"))
            .agg(F.count("*").alias("n"), F.max(left).alias("left"), F.first(smaller).alias("smaller"), F.first(larger).alias("larger"),
                 F.first(F.least("one.crowded", "other.crowded")).alias("crowded")))
    wanted = share / (1 + share) * (F.col("smaller") + F.col("larger")) - 1e-6
    # the first ones end earlier in one of the two texts, and what follows there is the most that can be shared yet
    after = F.greatest(*[F.greatest(F.ceil(F.col(side) * share - 1e-6) - 1 - _more(F.col(side), F.floor, share), F.lit(0))
                         for side in ("smaller", "larger")])
    enough = (F.col("left") + F.col("crowded") >= wanted) & (F.col("n") + F.col("crowded") + after >= wanted)
    pairs = both.filter(enough).select("a", "b")
    again = stage(crowds.filter(F.col("crowded") > _more(F.floor(F.col("size") * share - 1e-6), F.floor, share)).select("row"), "crowded")
    if again.isEmpty():
        return pairs
    return pairs.unionByName(_by_frequency(texts.join(again, "row", "left_semi"), share)).distinct()


def near_copies(rows: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """The ``row`` of every document that is dropped as a copy or near copy of one that stays.

    ``rows`` is a table of :func:`~tidewatch.llm.rows.numbered` documents.
    Equal texts are one point.  Points link when the Jaccard similarity of
    their five-word shingles, computed on the whole texts, reaches
    ``similarity``.  At first those are compared that share a key, differ in
    at most ``RADIUS`` of 128 bits and in at most ``SKETCH_RADIUS`` of the 256
    bits of a sketch of these shingles.  The sketch keeps texts apart that have most words in common but not their
    shingles, such as the far ends of a large group of copies.

    First every point is compared with one point that comes before it in the
    order of ``doc_id``, the closest of those that are the first ones of its
    keys, and dropped if they link; that is repeated among what is left until
    it drops nothing.  A group of copies of any size has shrunk to a few
    points by then, at one comparison per point and round.  Then all pairs
    that are left are compared, and with them every pair of texts whose
    shingles can reach ``similarity`` whatever their prints are (see
    :func:`_sharing`); of each linked group the point with the smallest
    ``doc_id`` stays.  So no two texts stay whose similarity reaches it.
    """
    text = F.coalesce("doc.text", F.lit(""))
    plain = rows.select("row", text.alias("text"))
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").cast("long").alias("doc_id"), "row")
    same = stage(rows.select(F.sha2(text, 256).alias("sha"), order.alias("order")).groupBy("sha")
                 .agg(F.min("order").alias("order")).select("order.row", "order"), "distinct-texts")
    dropped = [rows.select("row").join(same.select("row"), "row", "left_anti")]
    active = stage(plain.mapInPandas(_wide_prints, _WIDE).join(same, "row"), "wide-prints")

    def linked(pairs: DataFrame) -> DataFrame:
        # Either text is looked up for itself: few pairs are broadcast, and only the texts of pairs are shuffled.
        found = stage(pairs, "near-candidates")
        one = found.join(plain.select(F.col("row").alias("a"), F.col("text").alias("one")), "a")
        other = found.join(plain.select(F.col("row").alias("b"), F.col("text").alias("other")), "b")
        return stage(one.join(other, ["a", "b"]).select("a", "b", "one", "other")
                     .mapInPandas(_verified(similarity), "a long, b long"), "near-pairs")

    for _ in range(MAX_ROUNDS):
        gone = linked(_nearest_first(active)).select(F.col("a").alias("row"))
        if gone.isEmpty():
            break
        dropped.append(gone)
        active = stage(active.join(gone, "row", "left_anti"), "wide-prints")
    # by the smaller side, as in ``without``: where the rows dropped so far fit a broadcast, no text is shuffled
    gone = stage(reduce(DataFrame.unionByName, dropped), "gone")
    pairs = _all_pairs(active).unionByName(_sharing(plain.join(gone, "row", "left_anti"), similarity)).distinct()
    roots = connected_components(linked(pairs)).withColumnRenamed("node", "row")
    members = active.select("row", "order").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    stay = members.groupBy("root").agg(F.min("order").alias("order")).select("order.row")
    return gone.unionByName(members.select("row").join(stay, "row", "left_anti"))


def keep_one(docs: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all columns, without copies and near copies of others (see :func:`near_copies`).

    A null text counts as empty; texts of any length are read whole.  Of rows
    that repeat id and text one stays, as of equal texts without any id.  An
    empty table gives no rows.
    """
    rows = numbered(docs)
    return without(rows, near_copies(rows, similarity))
