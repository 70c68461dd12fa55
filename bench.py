"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's full plan is executed into the ``noop`` sink (nothing is
collected to the driver), twice: ``cold`` (first run: planning, codegen,
file listing) and ``warm``.  ``value`` is the warm total of the batch
queries; stream queries (each runs a whole availableNow stream) are timed
once under ``streams``.  Prints one line:
{"metric": "total_query_seconds_warm", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Set BENCH_QUERIES=a,b,c to run a subset.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from canopy.plans import load_all  # noqa: E402
from canopy.session import get_spark  # noqa: E402


def flagship_per_user(spark, sf_dir: str) -> dict:
    """The control replay with every user as its own device (not part of ``value``).

    Same plan, ~user-count devices instead of 8: shows how the replay scales
    with the number of keys.
    """
    from canopy.plans.control import ControlParams, control_replay
    from canopy.sources import bindings as B
    df = control_replay(spark, sf_dir, ControlParams(), telemetry=B.telemetry(spark, sf_dir, devices=0),
                        actions=B.actuator_logs(spark, sf_dir, devices=0))
    res = {}
    for run in ("cold", "warm"):
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        res[f"control_replay_per_user_{run}"] = round(time.perf_counter() - t0, 3)
    res["control_replay_per_user_rows"] = df.count()
    return res


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_spark("canopy-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    reg = load_all()
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = [n for n in reg if not only or n in only]
    # warm-up: JVM, parquet footers, data-derived bounds
    reg["scan_telemetry"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    failed: dict[str, str] = {}
    streams: dict[str, float] = {}
    for name in names:
        if reg[name].kind == "stream":  # runs a whole availableNow stream: reported apart
            try:
                t0 = time.perf_counter()
                reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
                streams[name] = round(time.perf_counter() - t0, 3)
            except Exception as e:  # noqa: BLE001
                failed[name] = repr(e)[:200]
            continue
        try:
            for run in ("cold", "warm"):
                t0 = time.perf_counter()
                reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
                (cold if run == "cold" else times)[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = repr(e)[:200]
    out = {"metric": "total_query_seconds_warm", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "n_queries": len(times),
           "cold_total": round(sum(cold.values()), 3), "cold": cold}
    if streams:
        out["streams"] = streams
    if not only:
        out["scale"] = flagship_per_user(spark, sf_dir)
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
