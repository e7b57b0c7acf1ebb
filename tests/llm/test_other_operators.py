"""Mixing, vectors, URLs, components and the pipeline against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import embedding_dedup, mixing, queries, url_filter
from tidewatch.llm.graph import connected_components


def test_components(spark):
    chance = random.Random(5)
    edges = [(chance.randrange(400), chance.randrange(400)) for _ in range(260)]
    edges += [(1000 + k, 1001 + k) for k in range(300)] + [(5000, k) for k in range(5001, 5400)] + [(7, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({n for e in edges[:-1] for n in e})
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges[:-1]:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    assert {n: got.get(n, n) for n in nodes} == root
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_is_fair(spark, documents, rows, no_documents):
    weights, other, block = {"src0": 7, "src1": 3, "src2": 5, "nothing": 4}, 6, 2
    got = mixing.mixed(documents, weights, other, block, max_sources=0).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    ordered = sorted(got, key=lambda r: r.position)
    assert [r.slot for r in ordered] == sorted(r.slot for r in got)
    blocks = defaultdict(set)
    size = Counter()
    for r in got:
        assert r.release <= r.slot < r.deadline
        assert r.grp == (r.source if r.source in weights else "*")
        blocks[r.grp].add((r.block, r.slot))
        size[r.grp, r.block] += 1
    for grp, pairs in blocks.items():
        numbers = sorted(pairs)
        assert [b for b, _ in numbers] == list(range(len(numbers)))
        assert [s for _, s in numbers] == sorted(s for _, s in numbers)
        assert all(size[grp, b] == block for b, _ in numbers[:-1])
    slots = [s for pairs in blocks.values() for _, s in pairs]
    assert sorted(slots) == list(range(len(slots)))
    by_source = defaultdict(list)
    for r in ordered:
        by_source[r.grp].append(r.doc_id)
    for ids in by_source.values():
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert mixing.mixed(no_documents, weights, other, block).count() == 0
    stored = mixing.in_mixed_order(documents, weights, other, block, max_sources=0)
    assert stored.columns == documents.columns
    place = {r.doc_id: r.position for r in ordered}
    first = [place[r.doc_id] for r in stored.select("doc_id").collect() if r.doc_id != 900004]
    assert first == sorted(first)


def replay(rows, weights, other, block):
    """Positions by serving slot after slot, from the groups' queues; equal ids are told apart by their count only."""
    queues = defaultdict(list)
    for r in rows:
        queues["*" if r.source is None else r.source].append(r.doc_id)
    for ids in queues.values():
        ids.sort(key=lambda i: (i is not None, i or 0))
    unnamed = [g for g in queues if g not in weights]
    # Exact parts: fractions of the whole, whatever integers the operator takes for them.
    part = {g: Fraction(weights[g]) if g in weights else Fraction(other, len(unnamed)) for g in queues}
    left, out, begin, slot = {g: -(-len(ids) // block) for g, ids in queues.items()}, [], 0, 0
    served, phase = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0)
    while left:
        total = sum(part[g] for g in left)
        ready = []
        for g in left:
            release = math.floor(phase[g] * total / part[g])
            if begin + release <= slot:
                ready.append((math.ceil((phase[g] + 1) * total / part[g]), g))
        _, g = min(ready)
        out += [(slot, g, i) for i in queues[g][served[g] * block:(served[g] + 1) * block]]
        served[g] += 1
        phase[g] += 1
        left[g] -= 1
        slot += 1
        if not left[g]:  # the next phase starts with the groups that have blocks left
            del left[g]
            begin, phase = slot, dict.fromkeys(queues, 0)
    return out


def test_mixing_equals_a_replay_for_every_source(spark, documents, rows):
    for weights, other, block in (({"src0": 7, "src1": 3, "src2": 5, "nothing": 4}, 6, 2), ({}, 1, 3),
                                  (queries.SOURCE_WEIGHTS, queries.OTHER_WEIGHT, queries.BLOCK_ROWS)):
        got = sorted(mixing.mixed(documents, weights, other, block).collect(), key=lambda r: r.position)
        assert [r.position for r in got] == list(range(len(rows)))
        assert all(r.grp == ("*" if r.source is None else r.source) and r.release <= r.slot < r.deadline for r in got)
        assert [(r.slot, r.grp, r.doc_id) for r in got] == replay(rows, weights, other, block)


def test_every_source_is_within_one_block(spark):
    weights, other = {f"src{k}": 10 + 7 * k for k in range(6)}, 60
    parts = mixing.shares(weights, other, [f"src{k}" for k in range(6, 20)])
    assert all(Fraction(parts[f"src{k}"], sum(parts.values())) == Fraction(60, 14 * (sum(weights.values()) + 60))
               for k in range(6, 20))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.expr("concat('src', id % 20)").alias("source"))
    got = mixing.mixed(docs, weights, other, 4).groupBy("slot").agg(F.first("grp").alias("grp")).collect()
    order = [r.grp for r in sorted(got, key=lambda r: r.slot)]
    counts, total = Counter(), sum(parts.values())
    for slot, grp in enumerate(order):
        counts[grp] += 1
        if max(counts.values()) == 500:  # a source of 2,000 rows has run out, the first phase ends
            break
        assert all(abs(counts[g] * total - (slot + 1) * w) < total for g, w in parts.items())
    assert max(counts.values()) == 500


def test_shares_of_many_sources():
    for k in (1, 3, 7, 64, 97):
        parts = mixing.shares({"a": 700, "b": 190}, 110, [f"s{n}" for n in range(k)])
        rest = [w for g, w in parts.items() if g not in "ab"]
        assert sum(parts.values()) <= mixing.MAX_PERIOD and parts["a"] * 190 == parts["b"] * 700
        assert sum(rest) * 700 == parts["a"] * 110 and max(rest) - min(rest) <= 1
    with pytest.raises(ValueError):
        mixing.shares({"a": 9_000}, 1, ["s", "t"])


def test_rows_without_an_id_are_spread_and_kept(spark):
    docs = spark.range(0, 60_000, 1, 4).select(
        F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
            F.expr("concat('s', id % 250)")).alias("source"), F.col("id").alias("row"))
    stored = mixing.in_mixed_order(docs, {"hot": 5}, 200, 8, max_sources=30)
    assert stored.columns == docs.columns
    assert stored.agg(F.count("*"), F.countDistinct("row")).first() == (60_000, 60_000)
    placed = mixing.mixed(docs, {"hot": 5}, 200, 8, max_sources=30)
    assert placed.agg(F.count("*"), F.countDistinct("position"), F.max("position")).first() == (60_000, 60_000, 59_999)
    assert placed.select("grp").distinct().count() == 32  # hot, 30 by themselves, the rest
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be joined again
    try:
        stored = mixing.in_mixed_order(docs, {"hot": 5}, 200, 8, max_sources=30)
        sizes = [r["count"] for r in stored.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 30_000


def test_schedule_stays_within_one_block():
    chance = random.Random(2)
    for _ in range(40):
        weights = {f"s{k}": chance.randrange(1, 60) for k in range(chance.randrange(1, 9))}
        total = sum(weights.values())
        served = mixing.edf_period(weights)
        assert Counter(name for name, _ in served) == weights
        counts = Counter()
        for slot, (name, block) in enumerate(served):
            assert block * total // weights[name] <= slot < -(-(block + 1) * total // weights[name])
            counts[name] += 1
            assert all(abs(counts[n] - (slot + 1) * w / total) < 1 for n, w in weights.items())
        blocks = {name: chance.randrange(0, 400) for name in weights}
        seen = defaultdict(list)
        for row in mixing.phases(blocks, weights):
            for k in range(row["upto"] - row["first"]):
                seen[row["grp"]].append(row["start"] + k // row["weight"] * row["period"]
                                        + row["slots"][k % row["weight"]])
        assert {n: len(s) for n, s in seen.items()} == {n: b for n, b in blocks.items() if b}
        assert sorted(s for each in seen.values() for s in each) == list(range(sum(blocks.values())))


def vectors(spark):
    noise = np.random.default_rng(4)
    rows, number = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            centre = noise.standard_normal(64)
            for spread in [0.0, 0.0, *noise.uniform(0.0, 0.4, 10)]:
                vec = centre + spread * noise.standard_normal(64)
                rows.append((number, [float(np.float32(x)) for x in vec], label))
                number += 1
    hub = noise.standard_normal(64)
    rows += [(number + k, [float(np.float32(x)) for x in hub + 0.05 * noise.standard_normal(64)], 3) for k in range(700)]
    number += 700
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0],
           [1.0, 2.0], [2.0, 4.0]]
    rows += [(number + k, vec, 1) for k, vec in enumerate(odd)]
    rows += [(None, [1.0, 2.0], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {name: F.lit("clash") for name in ("point", "mark", "keys", "weight", "root", "sound", "vec")})


def test_embedding_links(spark):
    rows, frame = vectors(spark)
    sound = [(i, np.array(v, float), label) for i, v, label in rows
             if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for k, (i, v, label) in enumerate(sound):
        for j, w, other in sound[:k]:
            if label == other and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    root = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, near in links.items():
            low = min([root[i], *(root[j] for j in near)])
            if low < root[i]:
                root[i], changed = low, True
    got = embedding_dedup.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    found = {r.vec_id: r for r in got}
    total = sum(map(len, links.values()))
    assert total > 5000 and all(r.n_links <= len(links[r.vec_id]) for r in got)
    assert sum(r.n_links for r in got) > 0.995 * total
    assert sum(found[i].component_id == root[i] for i in root) > 0.99 * len(root)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(frame.filter("false")).count() == 0


URLS = ["http://a.ORG/x?y", "https://Org", "x://example.org/es/1", "x://sub.example.org/en/12#t", "x://example.org/en/2",
        "x://b.com/fr/1", "x://c.com/de/1", "x://c.com/es", "no scheme", None, "://com/fr/", "x://notorg/", "a://b://c/d",
        "x://d.com\n/fr/", "x://m.c.com/en", "x://e.net/", "x://\u0130.ORG/fr/"]


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, verdict) for verdict, h, p in queries.URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark, sf):
    html = '<p><a href="http://d.com/q">x</a> <A class=z HREF=\'//e.net\'>y</a><a href="/own">z</a>'
    pages = [(k, url, html if k % 2 else None) for k, url in enumerate(URLS)] * 2
    given = [(r.page_id + 1000, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    frame = spark.createDataFrame(pages + given, "page_id long, url string, html string").withColumns(
        {name: F.lit("clash") for name in ("host", "path", "rule", "verdict", "doubt")})
    got = url_filter.judged(frame, queries.URL_RULES).collect()
    assert len(got) == len(pages) + len(given)
    known = plain_ranks([(plain_split(u), h) for _, u, h in pages + given])
    for r in got:
        url = URLS[r.page_id] if r.page_id < 1000 else dict((p, u) for p, u, _ in given)[r.page_id]
        host, path = plain_split(url)
        rule, verdict = plain_rule(host, path)
        trust, distrust = known.get(host, (0, 0))
        doubt = "block" if distrust > 0 and distrust >= 0.75 * (trust + distrust) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or doubt)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    assert url_filter.judged(frame.filter("false"), queries.URL_RULES).count() == 0


def plain_ranks(pages):
    edges = Counter()
    hosts = {host for (host, _), _ in pages if host}
    for (host, _), html in pages:
        for to in set(re.findall(url_filter.LINK, html or "")) if host else ():
            if re.match("(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", to):
                dst = plain_split("x:" + to[to.index("//"):])[0]
                if dst and dst != host:
                    edges[host, dst] += 1
    for host in hosts:
        parts = host.split(".")
        for k in range(1, len(parts)):
            if (parent := ".".join(parts[k:])) in hosts and parent:
                edges[host, parent] += 1
                edges[parent, host] += 1
                break
    out = defaultdict(lambda: [0, 0])
    for column, verdict in enumerate(("allow", "block")):
        seeds = Counter(host for (host, path), _ in pages if host and plain_rule(host, path)[1] == verdict)
        ahead = {(a, b): n for (a, b), n in edges.items()} if column == 0 else {(b, a): n for (a, b), n in edges.items()}
        degree = Counter()
        for (a, _), n in ahead.items():
            degree[a] += n
        start = {h: n / sum(seeds.values()) for h, n in seeds.items()}
        rank = dict(start)
        for _ in range(url_filter.ROUNDS):
            step = Counter({h: 0.15 * w for h, w in start.items()})
            for (a, b), n in ahead.items():
                step[b] += 0.85 * rank.get(a, 0) * n / degree[a]
            rank = step
        for host, value in rank.items():
            out[host][column] = value
    return out


def test_rules_with_no_list(spark):
    frame = spark.createDataFrame([(1, "x://a/b", None)], "page_id long, url string, html string")
    assert [tuple(r) for r in url_filter.judged(frame, []).collect()] == [(1, "a", "/b", None, "allow")]


def test_pipeline(spark, sf):
    import corpus_pipeline
    from tests.llm.test_near_copies import plain_jaccard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    last = {}
    for r in rows:
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    rows = [r for r in rows if last[r.text] == r.doc_id]
    texts = {r.doc_id: r.text for r in rows}
    pairs = [(i, j) for i in texts for j in texts if j < i and plain_jaccard(texts[i], texts[j]) >= 0.8]
    root = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= root[i] != root[j]
            root[i] = root[j] = low
    kept = {r.doc_id: r for r in rows if root[r.doc_id] == r.doc_id}
    place = {r.doc_id: r.position for r in mixing.mixed(
        docs.filter(F.col("doc_id").isin(list(kept))), queries.SOURCE_WEIGHTS, queries.OTHER_WEIGHT,
        queries.BLOCK_ROWS).collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    starts = sorted((r.sequence_id, r.offset, r.doc_id) for r in got if r.start == 0)
    assert [doc for _, _, doc in starts] == sorted(place, key=place.get) and len(place) == len(kept)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns(spark, no_documents, documents, sf, stage):
    import corpus_pipeline

    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, no_documents):
        assert corpus_pipeline.STAGES[stage][1](spark, frame, sf).schema.names == docs.columns
