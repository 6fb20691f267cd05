"""Run the correctness gate (and optionally plan facts) from the command line.

    python tests/run_gate.py [--sf DIR] [--plans] [key ...]

Compares every registered query (or the named ones) with its DuckDB oracle the
way the driver does, and prints one line per key.  ``--plans`` prints the plan
facts of each key instead (scans, shuffles, pushed filters, shuffle inputs).
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

import __spark_entry__ as entry  # noqa: E402
from compare import compare  # noqa: E402
from spendlens.plans import inspect  # noqa: E402
from spendlens.session import local_session  # noqa: E402


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--plans", action="store_true")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    spark = local_session("*", checkpoint=tempfile.mkdtemp(prefix="spendlens-gate-"))
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for key in args.keys or sorted(queries):
        t0 = time.perf_counter()
        df = queries[key](spark, args.sf)
        if args.plans:
            facts = inspect.summary(df)
            facts["shuffle_inputs"] = inspect.shuffle_inputs(df)
            print(key, json.dumps(facts))
            continue
        result = compare(df, sql[key], args.sf) if key in sql else {"ok": None, "rows": df.count()}
        print(key, json.dumps(result, default=str)[:400], f"{time.perf_counter() - t0:.1f}s", flush=True)
        if not result.get("ok"):
            bad.append(key)
    if not args.plans:
        print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
