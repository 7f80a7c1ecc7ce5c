"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import re
import time

from barloom.catalog import QUERIES
from barloom.session import build_session

HEADLINE = (
    "session_period_summary",
    "a01_minute_bar",
    "a03_five_minute_bar",
    "a23_fill_absent",
    "w03_sma",
    "w21_prepare_features",
    "w22_benchmark_features",
    "j01_attach_benchmarks",
    "a25_prune_training_rows",
    "u02_screen_union",
    "p17_entry_signal",
    "o05_make_instructions",
    "j21_upsert_instructions",
    "j22_commission_upsert",
    "o08_instruction_precheck",
    "t02_five_minute_bars_stream",
)


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("OFF")
    run(spark, HEADLINE[0], sf_dir)
    times = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    scale = re.search(r"sf([\d.]+)", sf_dir)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
