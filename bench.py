"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores. Raw rows,
clean events and the CSV are stored before the clock starts, and the timings start from
them; only ``rank_cluster_zones`` and ``run_csv_to_artifacts`` build all they need.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import registry
from checks.tables import clean_rows, raw_rows
from geohotspots.operators import clean, dbscan, forecast, panel, spatial
from geohotspots.plans import forecasting, zones
from geohotspots.session import build_session, cut_lineage

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = tempfile.mkdtemp(prefix="bench-")
    # Session start and first class loading are not part of any query.
    raw_rows(spark, SF_DIR).agg(F.count("id")).collect()
    raw = cut_lineage(raw_rows(spark, SF_DIR))
    events = cut_lineage(clean_rows(spark, SF_DIR))
    csv = f"{out}/events.csv"
    raw.drop("read_order").write.csv(csv, header=True, quote='"', escape='"')
    cells8 = spatial.assign_cells(events, 8)
    box = registry.S.BOX

    def evaluation() -> None:
        done = forecasting.evaluate_forecaster(cells8, test_days=7, min_cell_total=20)
        for part in (done.metrics, done.auc, done.confusion):
            consume(part)

    def forecast_week() -> None:
        fitted = forecast.DemandForecaster(min_cell_total=20).fit(cells8)
        consume(fitted.predict_hotspots())

    queries = {
        "ingestion_report": lambda: consume(clean.ingestion_report(raw)),
        "clean_events": lambda: consume(clean.clean_events(raw)),
        "hotspots_from_cells": lambda: consume(
            spatial.hotspots_from_cells(spatial.assign_cells(events, 9))
        ),
        "cluster_dbscan": lambda: consume(dbscan.cluster_dbscan(events, bbox=box)),
        "rank_cluster_zones": lambda: consume(registry.cluster_zones(spark, SF_DIR)),
        "daily_panel": lambda: consume(panel.build_daily_panel(cells8, min_cell_total=20)),
        "evaluate_forecaster": evaluation,
        "forecast_week": forecast_week,
        "run_csv_to_artifacts": lambda: zones.run(spark, csv, f"{out}/artifacts"),
    }
    timings = {}
    for name, query in queries.items():
        start = time.perf_counter()
        query()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "hotspot_analytics_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
