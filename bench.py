"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
    {"metric": "sum_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query first runs once on the sf0.001 and sf0.01 tables (compiles
generated code and lets the JIT reach steady state, as executors on a large
job do after their first tasks; nothing is cached between runs), then is
timed twice at the target scale; the faster run is reported (single runs on
a shared machine vary by up to 2x). A query's result is
consumed by the no-op sink, so the whole plan executes without collecting
rows on the driver. ``career_summary_stored`` / ``career_summary_json`` are
the production shape: the summary over round records stored as Parquet or
as JSON lines (written once, untimed, to the session's checkpoint folder).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tricklens.model import COMPASS_ROSTER  # noqa: E402
from tricklens.plans.queries import registry, rounds  # noqa: E402
from tricklens.plans.summary import summarize  # noqa: E402
from tricklens.session import local_session  # noqa: E402
from tricklens.sources.rounds import read_rounds  # noqa: E402
from tricklens.sources.scratch import fresh_path  # noqa: E402

WARM_SF_DIRS = [d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(d)]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs: int = 2) -> float:
    best = float("inf")
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        best = min(best, time.perf_counter() - t0)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    only = os.environ.get("BENCH_ONLY")
    # Stage and task times: set BENCH_EVENT_LOG_DIR to a scratch folder for Spark's event log.
    spark = local_session(cpus, app="tricklens-bench", event_log_dir=os.environ.get("BENCH_EVENT_LOG_DIR"))
    queries = registry()
    if only:
        queries = {k: v for k, v in queries.items() if re.search(only, k)}

    # A large input arrives in many files; the one-file test tables are split once, untimed, to run like one.
    def split(d: str) -> str:
        to = fresh_path(spark, "bench-tables")
        for name in ("orders", "lineitem", "events", "documents", "conversations"):
            spark.read.parquet(f"{d}/{name}.parquet").repartition(cpus).write.parquet(f"{to}/{name}.parquet")
        return to

    tables = {d: split(d) for d in (*WARM_SF_DIRS, sf_dir)}
    stored = {}
    warm = {d: {} for d in WARM_SF_DIRS}
    for fmt in ("parquet", "json"):
        stored[fmt] = fresh_path(spark, f"bench-rounds-{fmt}")
        rounds(spark, tables[sf_dir]).write.mode("overwrite").format(fmt).save(stored[fmt])
        for d in WARM_SF_DIRS:
            warm[d][fmt] = fresh_path(spark, f"bench-rounds-warm-{fmt}")
            rounds(spark, tables[d]).write.mode("overwrite").format(fmt).save(warm[d][fmt])

    def stored_summary(path, fmt):
        return summarize(read_rounds(spark, path, fmt), COMPASS_ROSTER)

    for d in WARM_SF_DIRS:
        for name, q in queries.items():
            consume(q(spark, tables[d]))
        for fmt in stored:
            consume(stored_summary(warm[d][fmt], fmt))

    times = {
        "career_summary_stored": timed(lambda: consume(stored_summary(stored["parquet"], "parquet"))),
        "career_summary_json": timed(lambda: consume(stored_summary(stored["json"], "json"))),
    }
    for name, q in queries.items():
        times[name] = timed(lambda: consume(q(spark, tables[sf_dir])))

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum_query_sec",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else sf_dir,
                "cpus": cpus,
                "headline": "career_summary_stored",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
