"""Small column builders shared by the operators.  All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that later filters must not recompute.

    A filter on a plain derived column is pushed below it with the whole
    expression copied in, once per use.  Producing the columns by a one-row
    ``inline`` keeps costly parsing to a single evaluation per row; filters on
    source columns still pass below it.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def lookup(key: Column, table: Mapping, default) -> Column:
    """Value of ``key`` in a constant map, or ``default`` when it is absent or null."""
    entries = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def has_prefix(value: Column, prefixes: Iterable[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | value.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value and keep nulls null (``least``/``greatest`` would skip them)."""
    bounded = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), bounded)


def keyword_points(message: Column, cap: int) -> Column:
    """Sum of the weights of all keywords contained in the text, bounded by ``cap``."""
    text = F.lower(F.coalesce(message, F.lit("")))
    total = F.lit(0)
    for word, weight in K.RISK_KEYWORDS.items():
        total = total + text.contains(word).cast("int") * F.lit(weight)
    return F.least(F.lit(cap), total)


def protocol_code(protocol: Column) -> Column:
    return lookup(protocol, K.PROTOCOL_CODES, K.DEFAULT_PROTOCOL_CODE)


def event_type_code(event_type: Column) -> Column:
    return lookup(event_type, K.EVENT_TYPE_CODES, K.DEFAULT_EVENT_TYPE_CODE)


def log_level_code(level: Column) -> Column:
    return lookup(level, K.LOG_LEVEL_CODES, K.DEFAULT_LOG_LEVEL_CODE)


def traffic_direction(src_ip: Column, dst_ip: Column) -> Column:
    src_in = has_prefix(src_ip, K.INTERNAL_PREFIXES)
    dst_in = has_prefix(dst_ip, K.INTERNAL_PREFIXES)
    return (F.when(src_in & ~dst_in, "outbound")
             .when(~src_in & dst_in, "inbound")
             .otherwise("internal"))


def portable_hash(*values: Column) -> Column:
    """52 bits of the MD5 of the values joined by ``|``: the same number in any engine."""
    digest = F.md5(F.concat_ws("|", *[v.cast("string") for v in values]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


# full ISO form that Spark casts directly; everything else is rebuilt first
_PLAIN_ISO = (r"^\d{4}-\d{2}-\d{2}"
              r"([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?)?$")
_LOOSE_ISO = (r"^(\d{4})-?(\d{2})-?(\d{2})"
              r"(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
              r"(Z|[+-]\d{2}(?::?\d{2})?)?)?$")


def parse_timestamp(text: Column, fallback: Column) -> Column:
    """ISO-8601 text to a timestamp; no zone means UTC; unreadable text gives ``fallback``."""
    def part(i: int) -> Column:
        return F.regexp_extract(text, _LOOSE_ISO, i)

    zone = F.regexp_replace(part(8), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    zone = F.regexp_replace(zone, r"^([+-]\d{2})$", "$1:00")
    rebuilt = F.concat(
        part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"),
        F.coalesce(F.nullif(part(4), F.lit("")), F.lit("00")), F.lit(":"),
        F.coalesce(F.nullif(part(5), F.lit("")), F.lit("00")), F.lit(":"),
        F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00")), F.lit("."),
        F.coalesce(F.nullif(part(7), F.lit("")), F.lit("0")), zone)
    parsed = (F.when(text.rlike(_PLAIN_ISO), text.try_cast("timestamp"))
               .when(text.rlike(_LOOSE_ISO), rebuilt.try_cast("timestamp")))
    return F.coalesce(parsed, fallback)


def iso_utc(ts: Column) -> Column:
    """ISO text in UTC; microseconds are shown only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1000000))
    return F.concat(whole,
                    F.when(micros == 0, "").otherwise(F.date_format(ts, ".SSSSSS")),
                    F.lit("+00:00"))
