"""Run registered queries next to their SQL counterparts and compare all values.

    python -m verification.check [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tidewatch.session import build_session
from verification.queries import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, db, name: str, sf: str) -> str:
    started = time.time()
    frame = QUERIES[name](spark, sf)
    got = frame.toArrow()
    took = time.time() - started
    if name not in ORACLES:
        return f"rows only  {got.num_rows:>8}  {took:6.2f}s"
    want = db.execute(ORACLES[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"COLUMNS {sorted(got.column_names)} != {sorted(want.column_names)}"
    types = {c: (str(got.schema.field(c).type), str(want.schema.field(c).type)) for c in got.column_names}
    differ = {c: t for c, t in types.items() if ("double" in t[0]) != ("double" in t[1])
              or ("string" in t[0]) != ("string" in t[1]) or "decimal" in t[1]
              or ("int" in t[0] and t[0] != t[1])}
    def table_rows(table):
        columns = [table.column(c).to_pylist() for c in table.column_names]
        return rows_of(table.column_names, zip(*columns))
    a, b = table_rows(got), table_rows(want)
    if a != b:
        missing = [r for r in b if r not in set(a)][:3] if len(b) < 200000 else "?"
        extra = [r for r in a if r not in set(b)][:3] if len(a) < 200000 else "?"
        return f"MISMATCH {len(a)} rows, want {len(b)}; extra {extra}; missing {missing} {differ or ''}"
    return f"ok         {len(a):>8}  {took:6.2f}s {differ or ''}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                  "spark.driver.memory": "8g",
                                                  "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    bad = 0
    for name in names:
        try:
            result = compare(spark, db, name, sf)
        except Exception as error:  # report every query
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:32} {result}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
