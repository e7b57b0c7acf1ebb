"""Runs of words against a scan of every period."""

import hashlib
import random
import re
import zlib

import pytest

from tidewatch.llm import periodicity
from tidewatch.llm.queries import repeated_words


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda run: (run[0], run[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda run: (-run[1], run[0], run[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def random_words(r):
    words, letters, n = [], r.choice([1, 2, 3, 5, 50]), r.randint(0, 160)
    while len(words) < n:
        if r.random() < 0.4:
            words += [r.randrange(letters) for _ in range(r.randint(1, 20))]
        else:
            unit = [r.randrange(letters) for _ in range(r.randint(1, 14))]
            if r.random() < 0.4:  # a period that is periodic but for its end
                unit = unit * r.randint(1, 5) + [r.randrange(letters)]
            repeats = r.randint(3, 7)
            words += (unit * repeats)[:len(unit) * repeats - r.randrange(len(unit))]
    return [f"w{x}" for x in words]


@pytest.mark.parametrize("seed", range(40))
def test_all_runs_of_a_batch(seed):
    r = random.Random(seed)
    texts = [random_words(r) for _ in range(12)]
    runs, kept = periodicity._find([[w.encode() for w in words] for words in texts])
    for words, found, text in zip(texts, runs.to_pylist(), kept, strict=True):
        want = plain_runs(words)
        assert [tuple(run.values()) for run in found] == want
        dropped = {i for s, m, q in want for i in range(s + q, s + m)}
        assert text == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_blocks_fit_their_runs():
    for longest in (0, 3, 6, 7, 100, 5000):
        covered = [q for _, low, high in periodicity.windows(longest) for q in range(low, high + 1)]
        assert covered == list(range(1, longest // 4 + 1))
        for level, low, high in periodicity.windows(longest):
            block = 1 << level
            assert all(2 * block + q - 1 <= max(6, 4 * q) for q in (low, high)) and high - low < block


@pytest.mark.parametrize("words", [["a"] * 30_000, ["a", "b"] * 20_000 + ["c"], ["x y z".split()[k % 3] for k in range(9000)]])
def test_long_texts(words):
    runs, kept = periodicity._find([[w.encode() for w in words]])
    assert [tuple(run.values()) for run in runs.to_pylist()[0]] == [
        (0, len(words) - (words[-1] == "c"), len(set(words) - {"c"}))]
    assert len(kept[0].split()) == len(set(words))


def test_query_rows(spark, documents, rows, no_documents):
    r = random.Random(1)
    more = [(700_000 + k, " \t".join(random_words(r))) for k in range(120)] + [(700_005, "a b " * 40), (None, "q " * 9)]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    long_ones = (900009, 900010)
    given = documents.select("doc_id", "text", "fp", "sha").filter(f"doc_id is null or doc_id not in {long_ones}")
    found = periodicity.run_digests(periodicity.periodic_runs(
        given.unionByName(extra, allowMissingColumns=True), repeated_words)).collect()
    want = [plain_row(doc, text) for doc, text in [(x.doc_id, x.text) for x in rows if x.doc_id not in long_ones] + more]
    key = repr
    assert sorted((tuple(x) for x in found), key=key) == sorted(want, key=key)
    assert sum(x.n_runs > 0 for x in found) > 50
    assert periodicity.run_digests(periodicity.periodic_runs(no_documents)).count() == 0


def test_short_batches_give_the_same(monkeypatch):
    r = random.Random(2)
    texts = [random_words(r) for _ in range(9)]
    import pyarrow as pa
    record = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([" ".join(t) for t in texts])], names=["doc_id", "text"])
    whole = pa.Table.from_batches(periodicity._scan(None)(iter([record]))).to_pylist()
    monkeypatch.setattr(periodicity, "BATCH_WORDS", 1)
    assert pa.Table.from_batches(periodicity._scan(None)(iter([record]))).to_pylist() == whole
