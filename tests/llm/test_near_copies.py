"""Near copies by five-word shingles against a comparison of all pairs."""

import os
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import simhash
from tidewatch.session import SHUFFLE_CLEANUP, stage

DOC = "doc_id long, text string"


def plain_jaccard(one, other, shingle=5):
    def shingles(text):
        words = "".join(c.lower() if c < "\x80" else c for c in text or "").encode().split()
        return {tuple(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()
    a, b = shingles(one), shingles(other)
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(r, words, vocabulary):
    """A copy with single words changed, or a stretch added, dropped or moved to the end."""
    words, kind = list(words), r.randrange(4)
    if kind == 0:
        for _ in range(max(1, len(words) // 60)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
    at, n = r.randrange(len(words)), max(1, len(words) // 14)
    if kind == 1:
        words[at:at] = r.choices(vocabulary, k=n)
    if kind == 2:
        del words[at:at + n]
    if kind == 3:
        words = words[:at] + words[at + n:] + words[at:at + n]
    return words


def planted(seed, n, lengths=(30, 500)):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "su") for b in range(120)]
    docs = [r.choices(vocabulary, k=r.randint(*lengths)) for _ in range(n)]
    docs += [edited(r, docs[k % n], vocabulary) for k in range(n)]
    order = list(range(len(docs)))
    r.shuffle(order)
    return [(i, " ".join(docs[k])) for i, k in enumerate(order)]


def test_recall_and_precision(spark):
    rows = planted(3, 250)
    texts = dict(rows)
    pairs = [(i, j) for i in texts for j in texts if i < j and plain_jaccard(texts[i], texts[j]) >= 0.8]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, DOC)).collect()}
    linked = {i for pair in pairs for i in pair}
    assert len(pairs) > 100 and set(texts) - kept <= {j for _, j in pairs}  # nothing else is dropped
    assert set(texts) - linked <= kept
    caught = sum(not {i, j} <= kept for i, j in pairs) / len(pairs)
    assert caught >= 0.9, caught


def test_large_group(spark):
    """Hundreds of copies of one text, each changed in its own way, share most of their keys."""
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(900)]
    base = r.choices(vocabulary, k=300)
    rows = [(1000 + k, " ".join([*base[:k % 300], f"x{k}", *base[k % 300 + 1:]])) for k in range(300)]
    clean = [(k, " ".join(r.choices(vocabulary, k=200))) for k in range(60)]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows + clean, DOC).repartition(4)).collect()}
    assert {k for k in kept if k < 1000} == set(range(60))
    assert 1 <= len(kept) - 60 <= 3 and 1000 in kept


def test_odd_rows(spark, documents, rows, no_documents):
    kept = simhash.keep_one(documents.unionByName(documents))
    assert kept.columns == documents.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert set(got.values()) == {1}
    texts = {}
    for row in rows:
        texts.setdefault(row.text or "", []).append((row.doc_id is None, row.doc_id))
    distinct = {text: min(ids)[1] for text, ids in texts.items()}
    pairs = [(a, b) for a in distinct for b in distinct if a < b and len(a) < 50_000 > len(b) and plain_jaccard(a, b) >= 0.8]
    near = {distinct[t] for pair in pairs for t in pair}
    assert {i for i in distinct.values() if i not in near} <= set(got) <= set(distinct.values())
    assert simhash.keep_one(no_documents).count() == 0


def test_similarity_of_texts():
    assert simhash.jaccard("A b  c d e f", "a B c d\te\nF") == 1.0 == simhash.jaccard("", None) == simhash.jaccard(" ", "\t")
    for one, other in (("a b c d e f g", "a b c d e f h"), ("a b", "a b c"), ("a", ""), ("\u00c4 b c d e", "\u00e4 b c d e")):
        assert simhash.jaccard(one, other) == plain_jaccard(one, other)


def test_sketch_follows_similarity():
    """Differing bits of 256 stay near (1 - s) / 2 of them, whatever the order and number of the shingles."""
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(900)]
    for kept in (1.0, 0.97, 0.9, 0.0):
        one = r.choices(vocabulary, k=400)
        other = [w if r.random() < kept else f"n{k}" for k, w in enumerate(one)]
        sketches = [simhash.sketch(simhash._hashes([w.encode() for w in words], 5)) for words in (one, other)]
        differ = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(*sketches))
        expected = 128 * (1 - plain_jaccard(" ".join(one), " ".join(other)))
        assert abs(differ - expected) <= 4.5 * (expected * (1 - expected / 256)) ** 0.5, (kept, differ, expected)
    hashes = simhash._hashes([w.encode() for w in r.choices(vocabulary, k=700)], 5)
    assert simhash.sketch(hashes) == simhash.sketch(hashes[::-1].repeat(2))


def test_far_ends_of_a_group_are_not_compared(spark):
    """Copies that share three words in four, but few shingles, meet in keys; the sketch leaves them out unread."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(300):
        words = list(base)
        for at in r.sample(range(400), 24):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, DOC)
    points = docs.select(docs.doc_id.alias("row"), "text").mapInPandas(simhash._wide_prints, simhash._WIDE)
    active = points.withColumn("order", points.row)
    own, probes = simhash._keyed(active)
    meeting = probes.join(own, "key").filter("a <> b").count()
    assert meeting > 5_000 and simhash._all_pairs(active).count() < meeting / 100
    assert simhash.keep_one(docs).count() == 300


def test_no_pair_is_left_out(spark):
    """Repeated words rule the prints of these texts, which no key brings together, but hardly count as shingles."""
    r = random.Random(11)
    rows = []
    for k in range(30):
        base = r.choices([f"w{j}" for j in range(2000)], k=r.randint(90, 160))
        rows += [(2 * k + side, " ".join([*base, *[f"{mark}{k}"] * 700])) for side, mark in enumerate("xy")]
    rows += [(1000 + i, text) for i, text in planted(6, 100, (5, 60))]
    texts = dict(rows)
    pairs = {(i, j) for i in texts for j in texts if i < j and plain_jaccard(texts[i], texts[j]) >= 0.8}
    docs = spark.createDataFrame(rows, DOC)
    points = docs.select(docs.doc_id.alias("row"), "text").mapInPandas(simhash._wide_prints, simhash._WIDE)
    met = {(p.a, p.b) for p in simhash._all_pairs(points.withColumn("order", points.row)).collect()}
    assert not any((2 * k, 2 * k + 1) in met for k in range(30)) and all((2 * k, 2 * k + 1) in pairs for k in range(30))
    assert pairs <= {(p.a, p.b) for p in simhash._sharing(docs.select(docs.doc_id.alias("row"), "text"), 0.8).collect()}
    kept = {x.doc_id for x in simhash.keep_one(docs).collect()}
    assert not any({i, j} <= kept for i, j in pairs) and set(texts) - kept <= {j for _, j in pairs}


def test_only_texts_of_frequent_shingles_are_shuffled_whole(spark, monkeypatch):
    """All pairs are found whatever number of texts counts as a crowd, and only crowds need every shingle."""
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    lines = [r.choices(vocabulary, k=12) for _ in range(8)]
    crowd = [" ".join([w for line in r.sample(lines, 7) for w in line] + r.choices(vocabulary, k=r.randint(1, 60))) for _ in range(40)]
    crowd += [f"{text} more" for text in crowd[:20]]
    texts = dict([*planted(7, 60, (5, 120)), *enumerate(crowd, 1000)])
    pairs = {(i, j) for i in texts for j in texts if i < j and plain_jaccard(texts[i], texts[j]) >= 0.8}
    docs = spark.createDataFrame(list(texts.items()), "row long, text string")
    whole, plain = [], simhash._by_frequency
    monkeypatch.setattr(simhash, "_by_frequency", lambda few, s: whole.append({x.row for x in few.collect()}) or plain(few, s))
    for cap in (1, 3, 12, 64):
        assert pairs <= {(p.a, p.b) for p in simhash._sharing(docs, 0.8, cap).collect()}, cap
    assert len(pairs) > 40 and len(whole) == 3 and whole[-1] and min(whole[-1]) >= 1000


def test_staged_tables_leave_no_shuffle_files(spark):
    """Shuffle files of a stored table go with its write, so that those of many rounds do not add up."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {name for top in folders for _, _, names in os.walk(top) for name in names
                if name.startswith("shuffle_") and name.endswith(".data")}
    before = shuffled()
    counts = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    assert stage(counts, "counts").agg(F.sum("count")).first()[0] == 1000
    for _ in range(50):
        left = shuffled() - before
        if len(left) <= 1:  # of the sum above, which was not stored
            break
        time.sleep(0.1)
    assert len(left) <= 1, left
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false" and counts.count() == 7 == counts.count()
