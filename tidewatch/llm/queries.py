"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import (embedding_dedup, exact_dedup, hard_negatives, language_id, mixing, packing, periodicity, pii,
                           quality, secrets, simhash, url_filter, warc)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
# Parts of a thousand: the largest source is held back, the sources not named share the rest.
SOURCE_WEIGHTS = {"src0": 150, "src1": 80, "src2": 80, "src3": 60, "src4": 60, "src5": 60, "src6": 50, "src7": 50,
                  "src8": 50, "src9": 50, "src10": 40, "src11": 40, "src12": 40, "src13": 40, "src14": 40}
OTHER_WEIGHT = 110
BLOCK_ROWS = 8
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents"), SOURCE_WEIGHTS, OTHER_WEIGHT, BLOCK_ROWS)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"), TOKENIZER)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_read(spark, sf_dir, "pages"), URL_RULES)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_read(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def repeated_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by a hash of its id, repeats a stretch of its words up to the end."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicity.run_digests(periodicity.periodic_runs(_read(spark, sf_dir, "documents"), repeated_words))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in (op1_mixing, op2_pii, op3_embedding_dedup, op4_packing, op5_exact_dedup,
                                        op6_simhash, op7_quality, op8_url_filter, op9_language_id, op10_secrets,
                                        op11_warc, op12_hard_negatives, op13_periodic_runs)}

_HOST = r"regexp_extract(coalesce({}, ''), '(?s)^.*?://([^/?#]*)', 1)"


def _lowered(text: str) -> str:
    return f"translate({text}, '{url_filter.UPPER}', '{url_filter.LOWER}')"


def _rule_sql(value: int) -> str:
    """The deciding rule's text (0) or verdict (1) as a CASE, longest rules first."""
    arms = [f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') "
            f"THEN '{(host + path, verdict)[value]}'"
            for verdict, host, path in sorted(URL_RULES, key=lambda rule: -len(rule[1] + rule[2]))]
    return f"CASE {' '.join(arms)} END"


URL_SQL = f"""
    WITH RECURSIVE split AS (
      SELECT page_id, html, {_lowered(_HOST.format('url'))} AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    ruled AS (SELECT *, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS said FROM split),
    hosts AS (SELECT DISTINCT host FROM split WHERE host <> ''),
    links AS (
      SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{url_filter.LINK.replace("'", "''")}', 1))) AS link
      FROM split WHERE host <> ''),
    linked AS (
      SELECT src, {_lowered(_HOST.format("('x:' || regexp_extract(link, '(//.*)', 1))"))} AS dst FROM links
      WHERE regexp_matches(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//')),
    parents AS (
      SELECT h.host, p.host AS parent, row_number() OVER (PARTITION BY h.host ORDER BY length(p.host) DESC) AS place
      FROM hosts h JOIN hosts p ON ends_with(h.host, '.' || p.host)),
    edges AS (
      SELECT src, dst, sum(n) AS n FROM (
        SELECT src, dst, count(*) AS n FROM linked WHERE dst <> '' AND src <> dst GROUP BY ALL
        UNION ALL SELECT host, parent, 1 FROM parents WHERE place = 1
        UNION ALL SELECT parent, host, 1 FROM parents WHERE place = 1) GROUP BY src, dst),
    moves AS (
      SELECT kind, src, dst, {url_filter.DAMPING} * n / sum(n) OVER (PARTITION BY kind, src) AS share FROM (
        SELECT 'allow' AS kind, src, dst, n FROM edges UNION ALL SELECT 'block', dst, src, n FROM edges)),
    start AS (
      SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS rank FROM (
        SELECT said AS kind, host, count(*) AS n FROM ruled WHERE said IS NOT NULL AND host <> '' GROUP BY ALL)),
    ranks AS (
      SELECT 0 AS turn, kind, host, CAST(rank AS DOUBLE) AS rank FROM start
      UNION ALL
      SELECT turn, kind, host, sum(rank) FROM (
        SELECT r.turn + 1 AS turn, m.kind, m.dst AS host, r.rank * m.share AS rank
        FROM ranks r JOIN moves m ON m.kind = r.kind AND m.src = r.host
        UNION ALL
        SELECT t.turn + 1, s.kind, s.host, s.rank * (1 - {url_filter.DAMPING})
        FROM start s, (SELECT DISTINCT turn FROM ranks) t)
      WHERE turn <= {url_filter.ROUNDS} GROUP BY turn, kind, host),
    doubted AS (
      SELECT host FROM ranks WHERE turn = {url_filter.ROUNDS} GROUP BY host
      HAVING coalesce(sum(rank) FILTER (kind = 'block'), 0) > 0
        AND sum(rank) FILTER (kind = 'block') >= {url_filter.DISTRUST_SHARE} * sum(rank))
    SELECT page_id, host, path, rule,
      coalesce(said, CASE WHEN host IN (SELECT host FROM doubted) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""

# Compares all pairs of a label; the operator finds each pair at the threshold with probability 0.9994.
EMBEDDING_SQL = f"""
    WITH RECURSIVE usable AS (
      SELECT vec_id, label, vec, sqrt(list_dot_product(vec, vec)) AS norm
      FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings) WHERE label IS NOT NULL),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec) AND a.norm > 0 AND b.norm > 0
      WHERE list_dot_product(a.vec, b.vec) / (a.norm * b.norm) >= {embedding_dedup.THRESHOLD}),
    reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
    least AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
    counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
    FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)"""

NEGATIVES_SQL = """
    WITH usable AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
        CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
      FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec) WHERE a.vec_id % 50 = 0),
    positives AS (
      SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other AS negative_id,
      positive_score, score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
      AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
    QUALIFY row_number() OVER best <= 3"""

ORACLES: dict[str, str] = {
    "op11_warc": """
        with seen as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
                        sha256(coalesce(html, '')) as payload_digest from pages),
             firsts as (select payload_digest, min(page_id) as first from seen where payload_bytes >= 100 group by 1)
        select page_id, payload_bytes, payload_digest, if(page_id <> first, 'revisit', 'response') as record_type,
          if(page_id <> first, first, null) as refers_to
        from seen left join firsts using (payload_digest)""",
    "op12_hard_negatives": NEGATIVES_SQL,
    "op3_embedding_dedup": EMBEDDING_SQL,
    "op8_url_filter": URL_SQL,
    "op5_exact_dedup": """
        with seen as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
             groups as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from seen group by 1)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256
        from seen join groups using (text_sha256)""",
}
