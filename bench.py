"""Benchmark: headline reports over the driver tables.

Runs each headline query to completion (``noop`` sink: every row computed, none
collected) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints one
JSON line.  One untimed warm-up run of the flagship absorbs JVM start-up;
each query is then timed ``$BENCH_REPEAT`` times and the best run is kept.

``stored_cube_report`` is the flagship report read from a monthly cube that was
stored once: the cost of every further report once the export has been
aggregated.  ``stored_cube_write`` is that set-up.  Every report line has all
nine figures.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendlens.operators.report import api_flavour, cube_cost_report  # noqa: E402
from spendlens.plans.catalog import AS_OF, REGISTRY  # noqa: E402
from spendlens.session import local_session  # noqa: E402
from spendlens.sources import cube_store, fixtures  # noqa: E402

HEADLINE = [
    "all_projects",
    "project_cost_report_single_pass",
    "projects_by_ids",
    "monthly_cube",
    "last_six_months",
    "org_unit_costs",
    "org_spend_rollup",
    "department_report",
    "carbon_report",
    "cost_estimates",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _best_of(repeat: int, build) -> float | None:
    """Best wall time of ``repeat`` full runs; None (and a note on stderr) on failure."""
    best = None
    for _ in range(repeat):
        t0 = time.perf_counter()
        try:
            _run(build())
        except Exception as exc:  # keep timing the other queries; report the failure
            print(f"bench: query failed: {exc!r}"[:500], file=sys.stderr)
            return None
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    return round(best, 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    scratch = tempfile.mkdtemp(prefix="spendlens-bench-")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")), checkpoint=scratch)
    _run(REGISTRY["all_projects"].build(spark, sf_dir))
    times = {}
    for name in HEADLINE:
        times[name] = _best_of(repeat, lambda name=name: REGISTRY[name].build(spark, sf_dir))
    t0 = time.perf_counter()
    cube = cube_store.materialize_costs(fixtures.billing(spark, sf_dir))
    times["stored_cube_write"] = round(time.perf_counter() - t0, 4)
    times["stored_cube_report"] = _best_of(
        repeat, lambda: api_flavour(cube_cost_report(cube, AS_OF)))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_reports_total",
        "value": round(sum(t for t in times.values() if t is not None), 4),
        "failed": [k for k, t in times.items() if t is None],
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
