"""Validation of raw JSON logs.

The text is parsed once into a VARIANT; presence and JSON type of each field
are then read from that value, so absent, null, integer and decimal stay
distinguishable without a Python parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.functions.columns import compute_once
from tidewatch.sources.schemas import LOG_SCHEMA

OK = "OK"


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _typed(df: DataFrame, raw: str) -> DataFrame:
    """Add ``_doc`` (VARIANT) and one JSON type name per known field."""
    df = compute_once(df, {"_doc": F.try_parse_json(F.col(raw))})
    return compute_once(df, {
        f"_type_{f}": F.schema_of_variant(F.try_variant_get(F.col("_doc"), f"$.{f}", "variant"))
        for f in K.REQUIRED_FIELDS + ["id"]})


def _with_reason(df: DataFrame, raw: str, *checks: Column) -> DataFrame:
    return compute_once(_typed(df, raw), {"reason": F.coalesce(*checks, F.lit(OK))})


def _text(field: str) -> Column:
    return F.try_variant_get(F.col("_doc"), f"$.{field}", "string")


def _first_of(checks: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in checks])


def missing_field() -> Column:
    """First absent field, in declared order."""
    return _first_of([(F.col(f"_type_{f}").isNull(), f"Missing required field: {f}")
                      for f in K.REQUIRED_FIELDS])


def wrong_type() -> Column:
    """First field whose JSON type is not accepted."""
    checks = [(~_is_number(F.coalesce(F.col(f"_type_{f}"), F.lit("VOID"))),
               f"{f} must be numeric") for f in K.NUMERIC_FIELDS]
    # a number beyond 32 bits would be read as null
    checks += [((F.coalesce(F.col(f"_type_{f}"), F.lit("VOID")) != "BIGINT")
                | F.try_variant_get(F.col("_doc"), f"$.{f}", "int").isNull(),
                f"{f} must be integer") for f in K.INTEGER_FIELDS]
    # an address that is not text cannot be classified as internal or external
    checks += [(F.coalesce(F.col(f"_type_{f}"), F.lit("VOID")) != "STRING",
                f"{f} must be string") for f in ("src_ip", "dst_ip")]
    return _first_of(checks)


def validate_required(df: DataFrame, raw: str = "value") -> DataFrame:
    """Add ``reason``: the first missing field, or OK."""
    return _with_reason(df, raw, missing_field()).select(*df.columns, "reason")


def validate_types(df: DataFrame, raw: str = "value") -> DataFrame:
    """Add ``reason``: missing field first, then wrong type, else OK."""
    return _with_reason(df, raw, missing_field(), wrong_type()).select(*df.columns, "reason")


def parse_logs(df: DataFrame, raw: str = "value") -> DataFrame:
    """Every input row with ``reason`` and the typed log fields (null when invalid)."""
    typed = _with_reason(df, raw, missing_field(), wrong_type())
    fields = {
        f.name: F.when(F.col("reason") == OK,
                       F.try_variant_get(F.col("_doc"), f"$.{f.name}", f.dataType.simpleString()))
        for f in LOG_SCHEMA.fields}
    keep = [c for c in df.columns if c not in fields]
    return typed.select(*keep, "reason", *[v.alias(n) for n, v in fields.items()])


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid logs, and the quarantine with its reasons."""
    valid = parsed.filter(F.col("reason") == OK).drop("reason")
    return valid, parsed.filter(F.col("reason") != OK)


def coerce_log_schema(df: DataFrame, raw: str = "value") -> DataFrame:
    """Edge coercion: numeric text and whole decimals are accepted, other mismatches rejected.

    Adds the typed fields and ``rejected_fields`` (comma separated, null when
    the log is accepted).
    """
    typed = _typed(df, raw)
    values, bad = {}, []
    for field in LOG_SCHEMA.fields:
        name, kind = field.name, F.coalesce(F.col(f"_type_{field.name}"), F.lit("VOID"))
        target = field.dataType.simpleString()
        if target == "string":
            value = F.when(kind == "STRING", _text(name))
        else:
            scalar = _is_number(kind) | kind.isin("STRING", "BOOLEAN")
            number = F.when(kind == "BOOLEAN", _text(name).try_cast("boolean").cast("double")) \
                      .otherwise(F.trim(_text(name)).try_cast("double"))
            if target == "int":
                number = F.when(number == F.floor(number), number)
            value = F.when(scalar, number.try_cast(target))
        values[name] = value
        optional = F.col("_type_id").isNull() | (kind == "VOID") if name == "id" else F.lit(False)
        bad.append(F.when(F.col(f"_v_{name}").isNull() & ~optional, F.lit(name)))
    typed = compute_once(typed, {f"_v_{n}": v for n, v in values.items()})
    rejected = F.array_join(F.array_compact(F.array(*bad)), ",")
    keep = [c for c in df.columns if c not in values]
    return typed.select(
        *keep, *[F.col(f"_v_{n}").alias(n) for n in values],
        F.nullif(rejected, F.lit("")).alias("rejected_fields"))
