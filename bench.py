"""Benchmark: wall time of the headline queries, printed as one JSON line.

``BENCH_SF_DIR`` names the data directory, ``BENCH_CPUS`` the number of local cores.
Every query runs to completion into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segflux.catalog import QUERIES  # noqa: E402
from segflux.session import local_session  # noqa: E402

HEADLINE = (
    "basin_emission",
    "gas_transfer_by_basin",
    "gas_transfer_wide",
    "reach_assembly",
    "width_override",
    "stream_order_summary",
    "extrapolate_emission",
    "basin_attributes",
    "basin_part1",
    "basin_part2",
    "global_quantiles",
    "qc_null_counts",
    "qc_key_mismatch",
    "months_roundtrip",
    "training_table",
    "predictor_r2",
    "histogram_by_group",
    "multi_ols",
    "residuals_long",
    "seasonality",
    "kde_by_group",
    "seasonal_loess",
    "rf_train_predict",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    # Executor threads, code generation and Parquet reader are warm before the first query counts.
    QUERIES["training_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
