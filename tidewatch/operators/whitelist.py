"""Trusted addresses as a table.

An entry is an address, a dotted prefix (``10.0.1.``) or a subnet
(``10.0.0.0/16``).  Entries become exact keys, one *form* per kind and length,
so that every form is one equi-join whatever the number of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.session import stage

BROADCAST_ENTRIES = 100_000
ADDRESS = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
PREFIX = r"^(?:[0-9]{1,3}\.){1,3}$"
SUBNET_LENGTH = r"/(3[0-2]|[12]?[0-9])$"


def _number(address: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    octets = F.split(address, r"\.")
    value = sum((F.get(octets, F.lit(i)).try_cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(address.rlike(ADDRESS), value)


def _network(address: Column, length: int) -> Column:
    return F.shiftright(_number(address), 32 - length).cast("string")


def _key(form: str, address: Column) -> Column:
    """What an address has to equal in the entries of a form."""
    kind, _, length = form.partition(":")
    if kind == "prefix":
        prefix = F.concat(F.substring_index(address, ".", int(length)), F.lit("."))
        return F.when(F.startswith(address, prefix), prefix)
    return _network(address, int(length)) if kind == "subnet" else address


def entries(table: DataFrame, column: str = "entry") -> DataFrame:
    """Distinct ``form`` and ``key`` of a list; null and blank entries count for nothing, others as written."""
    entry = F.trim(F.col(column))
    base, length = F.substring_index(entry, "/", 1), F.regexp_extract(entry, SUBNET_LENGTH, 1)
    subnet = F.when(length != "", _number(base))
    shifted = F.expr("CAST(shiftright(subnet, 32 - CAST(length AS INT)) AS STRING)")
    rows = table.select(entry.alias("entry"), subnet.alias("subnet"), length.alias("length"))
    prefix = F.col("entry").rlike(PREFIX)
    form = (F.when(F.col("subnet").isNotNull(), F.concat(F.lit("subnet:"), F.col("length").cast("int")))
             .when(prefix, F.concat(F.lit("prefix:"), F.size(F.split("entry", r"\.")) - 1)).otherwise("address"))
    key = F.when(F.col("subnet").isNotNull(), shifted).otherwise(F.col("entry"))
    return rows.filter("entry <> ''").select(form.alias("form"), key.alias("key")).distinct()


def with_listed(df: DataFrame, table: DataFrame, columns: tuple[str, ...] = ("src_ip", "dst_ip"),
                name: str = "_listed", broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Add a boolean: whether one of the address columns is on the list.

    The list is counted first.  A form with at most ``broadcast_entries``
    entries is broadcast; a longer one goes through a shuffled join, which
    adaptive execution splits where an address is hot.  On a stream, too, the
    list is the one that the table held when the query was planned.
    """
    known = stage(entries(table), "whitelist")
    hits = []
    for place, row in enumerate(known.groupBy("form").agg(F.count("*").alias("n")).orderBy("form").collect()):  # 37 forms at most
        mine = known.filter(F.col("form") == row["form"])
        for column in columns:
            key, hit = f"_entry{len(hits)}", f"_hit{len(hits)}"
            part = mine.select(F.col("key").alias(key), F.lit(True).alias(hit))
            part = F.broadcast(part) if row["n"] <= broadcast_entries else part.hint("merge")
            df = df.join(part, _key(row["form"], F.col(column)) == F.col(key), "left").drop(key)
            hits.append(hit)
    listed = F.coalesce(*[F.col(hit) for hit in hits], F.lit(False))
    return df.withColumn(name, listed).drop(*hits)
