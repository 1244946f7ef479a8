"""Bench: the whole study (cohort, probes, models, analysis cohort, 10 grid indicators, count summary).

Runs ``run_study`` on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``, each stage written as parquet under the checkpoint folder
(the stage writes are the study's lineage cuts). The surrogate warehouse views
are stored first, as the warehouse tables of a real study are. One untimed warm-up run on
``$BENCH_WARM_DIR`` (default sf0.001), then ``$BENCH_RUNS`` timed runs (default 3); per-stage
seconds are the minimum over the timed runs. Shuffle bytes come from Spark's event log (written to a scratch
folder) and are averaged over the timed runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tempovar.plans.study import Pipeline, run_study  # noqa: E402
from tempovar.session import ensure_checkpoint_dir, local_session  # noqa: E402
from tempovar.sources.surrogate import warehouse  # noqa: E402


def one_run(spark, sf_dir: str) -> dict[str, float]:
    times: dict[str, float] = {}
    out = f"{ensure_checkpoint_dir(spark)}/bench-{uuid.uuid4().hex}"
    core, reference, claims = warehouse(spark, sf_dir, persist=False)
    run_study(spark, Pipeline(core, reference, claims), out, on_stage=lambda n, s: times.__setitem__(n, s),
              materialize_inputs=True)
    return times


def shuffle_bytes(log_dir: str) -> tuple[int, int]:
    """Total shuffle bytes written / read over the application, from Spark's event log."""
    written = read = 0
    paths = [os.path.join(root, f) for root, _, files in os.walk(log_dir) for f in files if not f.startswith(".")]
    for path in paths:
        with open(path, errors="replace") as fh:
            for line in fh:
                if '"SparkListenerTaskEnd"' not in line:
                    continue
                metrics = json.loads(line).get("Task Metrics") or {}
                written += (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                r = metrics.get("Shuffle Read Metrics") or {}
                read += r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)
    return written, read


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    log_dir = tempfile.mkdtemp(prefix="tempovar-eventlog-")
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                      "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    one_run(spark, os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001"))  # warm-up: JIT
    best: dict[str, float] = {}
    walls = []
    for _ in range(runs):
        t0 = time.perf_counter()
        times = one_run(spark, sf_dir)
        walls.append(time.perf_counter() - t0)
        for k, v in times.items():
            best[k] = min(v, best.get(k, v))
    spark.stop()  # flushes the event log
    shuffle_write, shuffle_read = shuffle_bytes(log_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "study_wall_time",
        "value": round(min(walls), 3),
        "unit": "sec",
        "queries": {k.replace("/", "_"): round(v, 3) for k, v in best.items()},
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "runs": runs,
        "shuffle_write_bytes_per_run": shuffle_write // runs,
        "shuffle_read_bytes_per_run": shuffle_read // runs,
        "config": {"master": f"local[{cpus}]", "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                   "spark.sql.adaptive.enabled": spark.conf.get("spark.sql.adaptive.enabled")},
    }))


if __name__ == "__main__":
    main()
