"""Seconds per registered headline query; prints one JSON line.

Each query is planned and executed into Spark's no-op sink: one warm-up, then the median of
``BENCH_RUNS`` (default 3) timed runs. ``catalogue`` holds the seconds of whole catalogue runs over
the same tables, one analysis after the other and four side by side; they are no part of ``value``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from trichter.plans.catalogue import ANALYSES, run_catalogue
from trichter.plans.registered import QUERIES, STAR_PARAMS
from trichter.session import build_session, shared_folder
from trichter.sources.star import star_tables

EXTRA = ("ntile_global", "quality_report", "clean_tables", "question_intents")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or [*ANALYSES, *EXTRA]
    spark = build_session(
        "trichter-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)

    def catalogue(side_by_side: int) -> float:
        start = time.perf_counter()
        out = shared_folder(spark, "catalogue")
        run_catalogue(star_tables(spark, folder), out, STAR_PARAMS, fmt="parquet", side_by_side=side_by_side)
        return round(time.perf_counter() - start, 3)

    runs_of_all = {} if sys.argv[1:] else {"one_by_one": catalogue(1), "four_side_by_side": catalogue(4)}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "catalogue": runs_of_all,
                "sf": float(folder.rsplit("sf", 1)[-1]),
            }
        )
    )


if __name__ == "__main__":
    main()
