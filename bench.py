"""Benchmark: headline queries on $BENCH_SF_DIR (default sf0.1).

Prints ONE JSON line:
  {"metric": "total_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is timed end to end (building the DataFrame, which may run
checkpoint jobs, plus full execution into Spark's ``noop`` sink, so no
rows travel to the driver): one warm-up, then the median of
$BENCH_REPEATS runs. ``etl_features`` is a fresh build of the whole
warehouse (crosswalk, census, education, crime, AQI, amenities, feature
mart) from the raw fixtures, timed the same way.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearth.plans.catalog import Catalog  # noqa: E402
from hearth.plans.registry import REGISTRY  # noqa: E402
from hearth.session import get_spark  # noqa: E402

HEADLINE = (
    "crime", "education", "search", "metros", "kpis", "price_trends_month", "metro_compare",
    "distribution", "affordability", "top_metros", "market_trends", "valuation_fallback",
    "forecast", "training_data", "comparables", "recommend", "similar", "similar_complete", "predict_ml",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_spark(f"local[{cpus}]", app="hearth-bench",
                      shuffle_partitions=max(8, 2 * int(cpus)),
                      extra={"spark.driver.memory": "16g"})
    timings: dict[str, float] = {}

    # the whole warehouse build from raw fixtures, fresh each time
    run(Catalog(spark, sf_dir).features)        # warm-up (JVM, code generation)
    runs = []
    for _ in range(repeats):
        t = time.perf_counter()
        run(Catalog(spark, sf_dir).features)
        runs.append(time.perf_counter() - t)
    timings["etl_features"] = round(statistics.median(runs), 3)
    Catalog.of(spark, sf_dir).features          # shared mart for the queries

    for name in ([q for q in only if q != "model_fit"] or HEADLINE):
        q = REGISTRY[name]
        run(q(spark, sf_dir))                   # warm-up
        runs = []
        for _ in range(repeats):
            t = time.perf_counter()
            run(q(spark, sf_dir))
            runs.append(time.perf_counter() - t)
        timings[name] = round(statistics.median(runs), 3)

    if not only or "model_fit" in only:                # one cold fit: the queries above share a fitted model
        from hearth.plans.training import fit_valuation_model
        t = time.perf_counter()
        fit_valuation_model(Catalog.of(spark, sf_dir).training_data)
        timings["model_fit"] = round(time.perf_counter() - t, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
