"""Personal data: fixed formats, and identifiers bootstrapped from their context.

Four fixed formats give the base spans.  They are also the seeds of a
bootstrap.  The two words before a seed are a *lexical pattern*; every
identifier-like token (it holds a digit or an at sign) that follows a pattern
is an *instance* of it.  Patterns and instances form a graph that is scored in
turns: a pattern's confidence is the mean confidence of its distinct
instances, an instance's that of a noisy-or over its patterns, and seeds keep
confidence one.  Instances whose confidence reaches ``ACCEPT`` through patterns
with enough distinct seeds become additional spans of kind ``id``.  They count
as seeds from then on, so that further patterns find support, until nothing
new is accepted.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.spans import with_spans
from tidewatch.session import stage

# Fixed formats.  A match begins where the last one ended or where a run begins, which leaves the matches
# as they are and keeps the search linear; possessive repeats change nothing, as what follows cannot match inside.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9\x20-](?<![\x20-](?![0-9])))++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
TOKEN = r"(?<![^\s,;|\"'()<>])[^\s,;|\"'()<>0-9@]*+[0-9@][^\s,;|\"'()<>]*+"

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3  # distinct seeds or accepted instances that a pattern needs
ACCEPT = 0.8
ROUNDS = 3  # of scoring, before instances are accepted
MIN_LENGTH = 6


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string holds."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid_ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda part: part.rlike(OCTET))


def _valid_card(match: Column) -> Column:
    digits = F.regexp_replace(match, r"[\x20-]", "")
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)


def _valid_phone(match: Column) -> Column:
    return F.length(F.regexp_replace(match, r"[^0-9]", "")).between(8, 15)


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds an array of ``{at, upto, match, left}`` per kind, and ``tokens``, the identifier-like tokens.

    ``rows`` needs a ``text`` without nulls.
    """
    text = F.col("text")
    digit = text.rlike("[0-9]")
    found = with_spans(rows, {
        "email": (EMAIL, F.contains(text, F.lit("@"))), "ip": (IP, digit), "card": (CARD, digit),
        "phone": (PHONE, F.contains(text, F.lit("+"))), "tokens": (TOKEN, text.rlike("[0-9@]"))})
    return found.withColumns({"ip": F.filter("ip", lambda span: _valid_ip(span["match"])),
                              "card": F.filter("card", lambda span: _valid_card(span["match"])),
                              "phone": F.filter("phone", lambda span: _valid_phone(span["match"]))})


def _context(left: Column) -> Column:
    """The two words before a span, lower-cased, digits masked; null if there is no letter."""
    words = F.regexp_extract(left, r"(\S+\s+\S+|\S+)\s*+[^\s\p{L}\p{N}]*$", 1)
    plain = F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]+", "#"), r"\s+", " ")
    return F.when(plain.rlike(r"\p{L}"), plain)


def _confident(occurrences: DataFrame) -> DataFrame:
    """Values to accept, from ``context``, ``value``, ``seed`` rows."""
    edges = stage(occurrences.filter("context is not null").groupBy("context", "value")
                  .agg(F.max("seed").alias("seed")), "pattern-graph")
    known = stage(edges.filter("seed = 1").select("value", F.lit(1.0).alias("known")).distinct(), "pattern-known")
    n, before = known.count(), -1
    while n != before:  # what is accepted stays so, hence this ends
        supported = (edges.join(known, "value").groupBy("context").agg(F.count("*").alias("n"))
                     .filter(F.col("n") >= MIN_SEEDS).select("context"))
        used = stage(edges.join(supported, "context").join(known, "value", "left")
                     .select("context", "value", "seed", F.coalesce("known", F.lit(0.0)).alias("known")),
                     "pattern-supported")
        instances = used.groupBy("value").agg(F.max("known").alias("confidence"))
        for _ in range(ROUNDS):
            patterns = (used.join(instances, "value").groupBy("context")
                        .agg(F.avg("confidence").alias("strength")))
            doubt = F.log(F.greatest(F.lit(1e-9), 1 - F.col("strength")))
            instances = (used.join(patterns, "context").groupBy("value")
                         .agg(F.max("known").alias("known"), F.sum(doubt).alias("doubt"))
                         .select("value", F.greatest("known", 1 - F.exp("doubt")).alias("confidence")))
        accepted = instances.filter(F.col("confidence") >= ACCEPT).withColumnRenamed("confidence", "known")
        known = stage(known.unionByName(accepted).groupBy("value").agg(F.max("known").alias("known")), "pattern-known")
        n, before = known.count(), n
    return known.join(used.filter("seed = 0").select("value").distinct(), "value", "left_semi").select("value")


def _texts(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda span: F.concat_ws(":", F.lit(kind), span["at"], span["upto"]))


def _apart(found: DataFrame, min_length: int) -> DataFrame:
    """Tokens of ``min_length`` characters or more that share no character with a base span, a row each."""
    base = F.concat(*[F.transform(F.col(kind), lambda span: F.struct(
        span["at"], span["upto"], span["match"], span["left"], F.lit(True).alias("base"))) for kind in KINDS])
    tokens = F.transform(F.filter("tokens", lambda token: F.length(token["match"]) >= min_length), lambda token: F.struct(
        token["at"], token["upto"], token["match"], token["left"], F.lit(False).alias("base")))
    has_base = F.lit(False)
    for kind in KINDS:
        has_base = has_base | (F.size(kind) > 0)
    plain = found.filter(~has_base).select("row", F.inline(tokens))
    mixed = found.filter(has_base).select("row", F.inline(F.concat(base, tokens)))
    forward, back = (Window.partitionBy("row").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
                     for order in (F.asc("at"), F.desc("at")))
    free = mixed.withColumns({
        "_seen": F.max(F.when(F.col("base"), F.col("upto"))).over(forward),
        "_next": F.min(F.when(F.col("base"), F.col("at"))).over(back)}).filter(
        ~F.col("base") & (F.coalesce("_seen", F.lit(0)) <= F.col("at"))
        & (F.col("_next").isNull() | (F.col("_next") >= F.col("upto"))))
    return plain.drop("base").unionByName(free.drop("base", "_seen", "_next"))


def personal_data(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: counts per kind, a digest of the base spans, and all spans.

    Whole texts are searched, in time linear in their length but for sorting
    the spans of a text; null counts as empty and has no span.  Rows that
    repeat an id are searched one by one; an empty table gives no rows; other
    columns are ignored.  Added spans have ``min_length`` characters or more
    and never overlap base ones; the two words that are their context lie in
    the ``CONTEXT_CHARS`` characters before them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = stage(base_spans(rows).drop("text").withColumn("row", F.monotonically_increasing_id()), "pii-spans")

    def occurrences(spans: DataFrame, seed: int) -> DataFrame:
        return spans.select("row", "at", "upto", F.lower("match").alias("value"),
                            _context(F.col("left")).alias("context"), F.lit(seed).alias("seed"))

    seeds = occurrences(found.select("row", F.inline(F.concat(*KINDS))), 1)
    tokens = occurrences(_apart(found, min_length), 0)
    accepted = _confident(seeds.unionByName(tokens))
    added = (tokens.join(accepted, "value", "left_semi").groupBy("row")
             .agg(F.array_sort(F.collect_list(F.struct("at", "upto"))).alias("added")))
    base_texts = F.concat(*[_texts(kind, F.col(kind)) for kind in KINDS])
    more = F.coalesce(F.col("added"), F.array().cast("array<struct<at:int,upto:int>>"))
    return found.join(added, "row", "left").select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.concat_ws(",", base_texts), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base_texts, _texts("id", more))).alias("spans"))
