"""Two public intrusion datasets, brought to one 23-column labelled table.

Each rule is a column function, and each dataset is a single ``select`` over
its source, so the whole harmonisation is one map stage without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as K
from tidewatch.functions.columns import clip, lookup, portable_hash
from tidewatch.operators.quantiles import kth_smallest


@dataclass(frozen=True)
class Synthetic:
    """Columns neither source has.  ``port`` stands in for an unknown service."""
    src_port: Column
    hour: Column
    weekend: Column
    port: Column


def synthetic_from(*key: str) -> Synthetic:
    """Values drawn by hashing the key: repeatable and independent of partitioning."""
    def draw(salt: int, n: int) -> Column:
        return portable_hash(*[F.col(c) for c in key], F.lit(salt)) % n

    ports = K.EPHEMERAL_PORT_HIGH - K.EPHEMERAL_PORT_LOW
    return Synthetic(
        src_port=draw(1, ports) + K.EPHEMERAL_PORT_LOW,
        hour=draw(2, 1_000_000) / F.lit(1e6),
        weekend=(draw(3, 100) < K.WEEKEND_PERCENT).cast("int"),
        port=draw(4, ports) + K.EPHEMERAL_PORT_LOW)


# --------------------------------------------------------------- shared rules
def log2_bytes(n: Column) -> Column:
    return F.when(n.isNotNull(), F.log2(F.greatest(n, F.lit(0)) + 1))


def norm_duration(seconds: Column) -> Column:
    return clip(seconds.cast("double"), 0.0, K.MAX_DURATION) / K.MAX_DURATION


def norm_port(port: Column) -> Column:
    return port.cast("double") / K.MAX_PORT


def category_event_code(category: Column) -> Column:
    return lookup(category, K.CATEGORY_EVENT_CODES, 0)


# ----------------------------------------------------- connection dataset (NSL)
def nsl_attack_category(attack_type: Column) -> Column:
    return lookup(attack_type, K.NSL_ATTACK_CATEGORY, K.UNKNOWN_CATEGORY)


def nsl_label(category: Column) -> Column:
    return (category != "Normal").cast("int")


def nsl_protocol_code(protocol: Column) -> Column:
    return lookup(protocol, K.NSL_PROTOCOL_CODES, K.OTHER_PROTOCOL_CODE)


def nsl_service_port(service: Column) -> Column:
    return lookup(service, K.NSL_SERVICE_PORTS, 0)


def nsl_flag_severity(flag: Column) -> Column:
    return lookup(flag, K.NSL_FLAG_SEVERITY, 1)


def nsl_risk_score() -> Column:
    total = F.lit(0)
    for name, weight in K.NSL_RISK_WEIGHTS.items():
        total = total + F.col(name) * weight
    return clip(total, 0, K.MAX_RISK)


def nsl_standardize(df: DataFrame, synthetic: Synthetic | None = None, *keep: str) -> DataFrame:
    """Connection records to the unified columns; ``keep`` passes extra columns through."""
    made = synthetic or synthetic_from(*[c for c in K.NSL_COLUMNS if c in df.columns])
    category = nsl_attack_category(F.col("attack_type"))
    unified = {
        "src_port": norm_port(made.src_port),
        "dst_port": norm_port(nsl_service_port(F.col("service"))),
        "log_bytes_sent": log2_bytes(F.col("src_bytes")),
        "log_bytes_recv": log2_bytes(F.col("dst_bytes")),
        "norm_duration": norm_duration(F.col("duration")),
        "protocol_code": nsl_protocol_code(F.col("protocol_type")),
        "event_type_code": category_event_code(category),
        "log_level_code": nsl_flag_severity(F.col("flag")),
        "hour_of_day": made.hour,
        "is_weekend": made.weekend,
        "message_risk_score": nsl_risk_score(),
        "label": nsl_label(category),
        "attack_category": category,
        "attack_type": F.col("attack_type"),
        "dataset": F.lit(K.NSL_DATASET),
    }
    unified.update({name: F.col(name).cast("double") for name in K.FLOW_FEATURES})
    return df.select(*[unified[c].alias(c) for c in K.UNIFIED_COLUMNS], *keep)


# ------------------------------------------------------------ flow dataset (UNSW)
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(point) for point in range(0x2000, 0x200B))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end.

    Trimming looks every end up in the whole list, so a text that begins and
    ends with a visible ASCII character is taken as it is.
    """
    def visible(end: Column) -> Column:
        return end.between("!", "~")

    return F.when(visible(F.left(text, F.lit(1))) & visible(F.right(text, F.lit(1))), text).otherwise(
        F.btrim(text, F.lit(WHITE_SPACE)))


def unsw_clean_category(raw: Column) -> Column:
    return F.coalesce(F.nullif(stripped(raw), F.lit("")), F.lit("Normal"))


def unsw_attack_category(cleaned: Column) -> Column:
    return lookup(cleaned, K.UNSW_ATTACK_CATEGORY, K.UNKNOWN_CATEGORY)


def unsw_protocol_code(proto: Column) -> Column:
    return lookup(stripped(F.lower(proto)), K.UNSW_PROTOCOL_CODES, K.OTHER_PROTOCOL_CODE)


def unsw_service_port(service: Column, otherwise: Column) -> Column:
    cleaned = stripped(F.lower(F.coalesce(service, F.lit("-"))))
    known = F.create_map(*[F.lit(x) for pair in K.UNSW_SERVICE_PORTS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, cleaned).cast("long"), otherwise.cast("long"))


def unsw_state_severity(state: Column) -> Column:
    return lookup(stripped(F.coalesce(state, F.lit("no"))), K.UNSW_STATE_SEVERITY, 1)


def unsw_risk_score() -> Column:
    def flag(condition: Column) -> Column:
        return F.coalesce(condition.cast("int"), F.lit(0))

    return clip(
        clip(F.col("ct_state_ttl"), 0, 10) * 2
        + flag(F.col("sttl") < 32) * 10
        + flag(F.col("is_ftp_login") == 1) * 15
        + clip(F.col("ct_flw_http_mthd"), 0, 5) * 3
        + flag(F.col("is_sm_ips_ports") == 1) * 5, 0, K.MAX_RISK)


def unsw_flow_features() -> dict[str, Column]:
    def share(name: str, top: float) -> Column:
        return clip(F.col(name).cast("double"), 0.0, top) / top

    return {
        "count": (F.col("spkts") + F.col("dpkts")).cast("double"),
        "srv_count": F.col("ct_srv_src").cast("double"),
        "serror_rate": share("sload", 1e6),
        "same_srv_rate": share("rate", 1000.0),
        "dst_host_count": F.col("ct_dst_ltm").cast("double"),
        "dst_host_srv_count": F.col("ct_srv_dst").cast("double"),
        "dst_host_same_srv_rate": share("ct_dst_src_ltm", 100.0),
        "dst_host_serror_rate": share("dttl", 255.0),
    }


def unsw_standardize(df: DataFrame, synthetic: Synthetic | None = None, *keep: str) -> DataFrame:
    """Flow records to the unified columns; ``keep`` passes extra columns through."""
    known = K.UNSW_STRING_COLUMNS + K.UNSW_LONG_COLUMNS + K.UNSW_DOUBLE_COLUMNS
    made = synthetic or synthetic_from(*[c for c in known if c in df.columns])
    cleaned = unsw_clean_category(F.col("attack_cat"))
    category = unsw_attack_category(cleaned)
    unified = {
        "src_port": norm_port(made.src_port),
        "dst_port": norm_port(unsw_service_port(F.col("service"), made.port)),
        "log_bytes_sent": log2_bytes(F.col("sbytes")),
        "log_bytes_recv": log2_bytes(F.col("dbytes")),
        "norm_duration": norm_duration(F.col("dur")),
        "protocol_code": unsw_protocol_code(F.col("proto")),
        "event_type_code": category_event_code(category),
        "log_level_code": unsw_state_severity(F.col("state")),
        "hour_of_day": made.hour,
        "is_weekend": made.weekend,
        "message_risk_score": unsw_risk_score(),
        "label": F.col("label").cast("int"),
        "attack_category": category,
        "attack_type": cleaned,
        "dataset": F.lit(K.UNSW_DATASET),
        **unsw_flow_features(),
    }
    return df.select(*[unified[c].alias(c) for c in K.UNIFIED_COLUMNS], *keep)


# -------------------------------------------------------------------- combining
def union_datasets(*parts: DataFrame | None) -> DataFrame:
    """UNION ALL of the parts that exist."""
    present = [p for p in parts if p is not None]
    if not present:
        raise ValueError("no dataset was processed")
    out = present[0]
    for part in present[1:]:
        out = out.unionByName(part)
    return out


def seeded_shuffle(df: DataFrame, seed: int = 42) -> DataFrame:
    """Global permutation by row hash, as a distributed sort; needed only by ordered consumers.

    Equal rows tie; their position is the last sort key, so that many copies
    of one row still spread over the range partitions.
    """
    columns = [F.col(c) for c in df.columns]
    marked = df.withColumn("_position", F.monotonically_increasing_id())
    return marked.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns, "_position").drop("_position")


def subsample(df: DataFrame, n: int, seed: int = 42, row_key: Column | None = None) -> DataFrame:
    """Exactly ``n`` rows chosen by hash when ``0 < n < count``; otherwise all rows.

    The hash of the n-th row is found first, so choosing is a filter and not a
    sort.  ``row_key`` should be unique; row position is used without one.
    """
    total = df.count() if n > 0 else 0
    if not 0 < n < total:
        return df
    key = row_key if row_key is not None else F.monotonically_increasing_id()
    # 52 bits are exact as a double
    marked = df.withColumn("_rank", portable_hash(key, F.lit(seed)).cast("double"))
    cut = kth_smallest(marked, "_rank", n - 1)
    surely = marked.filter(F.col("_rank") < cut)
    ties = marked.filter(F.col("_rank") == cut).limit(n - surely.count())
    return surely.unionByName(ties).drop("_rank")


def class_balance(df: DataFrame, *by: str) -> DataFrame:
    """Totals, class counts and percentages per group."""
    attack = F.sum(F.col("label").cast("long"))
    out = df.groupBy(*by).agg(F.count("*").alias("total"), attack.alias("attack"))
    out = out.withColumn("normal", F.col("total") - F.col("attack"))
    return out.withColumns({
        "normal_pct": F.round(F.col("normal") / F.col("total") * 100, 1),
        "attack_pct": F.round(F.col("attack") / F.col("total") * 100, 1),
        "attack_rate": F.round(F.col("attack") / F.col("total"), 6)})


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; ties by value."""
    out = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out.limit(top) if top else out
