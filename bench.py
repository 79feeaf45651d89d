"""Times the headline queries over $BENCH_SF_DIR and prints one JSON line.

``queries`` are timed over the rail tables written once as Parquet (``tables_sec`` is what that takes); ``derived`` has the same
queries deriving those tables anew each time, as they did before there were such tables.  ``feed`` is the decoding and
folding of a feed's messages from files to the state of trains.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = (
    "headline_metrics", "daily_series", "journey_metrics", "operator_league", "calibration_curve", "leadtime_accuracy",
    "report_summary", "report_services", "explore_grouped", "explore_filters", "station_heatmap", "map_day_about", "direct_journeys",
)


def timed(run, views) -> float:
    run(views).write.format("noop").mode("overwrite").save()  # code is compiled, files are cached
    start = time.perf_counter()
    run(views).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def feed(spark: SparkSession, views) -> dict:
    """Messages of one train in twenty, from Parquet files through the decoder and the keyed state to Parquet."""
    from punctuo.plans import trains as P

    def part(rows):
        return rows.filter(F.col("number") % 20 == 1)

    waves = P._waves(part(P._trains(views)).cache())
    n = sum(w.count() for w in waves)
    start = time.perf_counter()
    P._play(views, waves).count()
    took = time.perf_counter() - start
    return {"messages": n, "sec": round(took, 3), "per_sec": round(n / took, 1)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from punctuo import tables
    from punctuo.plans.registry import PLANS
    from punctuo.views import Views

    views = Views(spark, sf_dir)
    start = time.perf_counter()
    stored = tables.build(spark, sf_dir, "file://" + tempfile.mkdtemp(prefix="punctuo-bench-") + "/tables", int(cpus))
    built = round(time.perf_counter() - start, 3)
    times = {name: timed(PLANS[name], stored) for name in HEADLINE}
    derived = {name: timed(PLANS[name], views) for name in HEADLINE}
    total = round(sum(times.values()), 3)
    out = {"metric": "headline queries over stored tables, warm, total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    out |= {"tables_sec": built, "derived": derived, "derived_total": round(sum(derived.values()), 3), "feed": feed(spark, stored)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
