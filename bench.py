"""Headline queries on one folder of tables; prints one JSON line.

BENCH_SF_DIR names the folder and BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from demandgrid.catalog import CATALOG  # noqa: E402
from demandgrid.session import build_session  # noqa: E402

HEADLINE = (
    "holdout_slice",
    "panel_densify",
    "merge_dimensions",
    "lag_features",
    "rolling_features",
    "feature_plan",
    "trim_pre_activation",
    "split_walk_forward",
    "seasonal_naive_forecast",
    "theta_forecast",
    "ets_grid_forecast",
    "rolling_origin_cv",
    "slice_scores",
    "shift_summary",
    "bootstrap_rmsle",
    "panel_batch_scoring",
    "ridge_fit_predict",
    "ridge_recursive",
    "model_board",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("demandgrid-bench", cores)
    CATALOG["panel_densify"].build(spark, folder).count()  # start the engine
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        rows = CATALOG[name].build(spark, folder)
        rows.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
