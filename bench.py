"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores.  Deriving log and dataset rows from the tables is timed apart,
as ``prepare``.
"""

from __future__ import annotations

import json
import os
import time

from tidewatch.session import build_session, release_staged
from verification.queries import QUERIES, Inputs

HEADLINE = ["parse_batch_filter", "enrich_logs", "core_features", "context_evaluate", "threat_score",
            "alert_cooldown", "process_logs", "unsw_standardize", "describe_features", "iforest_fit",
            "train_evaluate", "process_logs_fitted", "severity_distribution"]


def run(spark, sf: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    inputs = Inputs(spark, sf)
    started = time.perf_counter()
    logs = inputs.logs.count()
    inputs.raw, inputs.nsl, inputs.unsw  # noqa: B018 - written on first use
    prepare = round(time.perf_counter() - started, 3)
    seconds = {name: run(spark, sf, name) for name in HEADLINE}
    per_log = seconds["process_logs_fitted"] / max(logs, 1) * 1000
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "prepare": prepare, "logs": logs, "fitted_run_ms_per_log": round(per_log, 4)}))
    release_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
