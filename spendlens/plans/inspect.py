"""Read facts off a DataFrame's physical plan (for plan tests and reviews).

Uses only ``DataFrame.explain`` output: how many parquet scans, shuffles and
broadcasts a plan has, which filters reached the scan and which columns it
reads.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def _tree(df: DataFrame) -> str:
    text = plan_text(df, "formatted")
    return text.split("\n\n", 1)[0]


def count_nodes(df: DataFrame, pattern: str) -> int:
    return len(re.findall(pattern, _tree(df)))


def scan_count(df: DataFrame) -> int:
    """Parquet/file scans in the physical plan (reused exchanges not counted)."""
    return count_nodes(df, r"Scan (?:parquet|orc|csv|json)")


def shuffle_count(df: DataFrame) -> int:
    return count_nodes(df, r"\bExchange \(")


def reused_exchange_count(df: DataFrame) -> int:
    return count_nodes(df, r"ReusedExchange")


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*)\]", plan_text(df, "formatted"))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*>)", plan_text(df, "formatted"))


def summary(df: DataFrame) -> dict:
    return {
        "scans": scan_count(df),
        "shuffles": shuffle_count(df),
        "reused_exchanges": reused_exchange_count(df),
        "broadcasts": count_nodes(df, r"BroadcastExchange"),
        "pushed_filters": pushed_filters(df),
        "read_schemas": read_schemas(df),
    }


def shuffle_inputs(df: DataFrame) -> list[str]:
    """Name of the operator feeding each shuffle ``Exchange`` of the plan.

    A shuffle fed by a (partial) aggregate moves pre-aggregated rows; one fed
    by a scan, filter or projection moves raw input rows.
    """
    lines = _tree(df).splitlines()
    out = []
    for i, line in enumerate(lines):
        if not line.lstrip(" :+-").startswith("Exchange ("):
            continue
        depth = line.index("Exchange")
        child = next((nxt for nxt in lines[i + 1:] if nxt.find("+- ") >= depth - 3), None)
        if child is not None:
            out.append(re.sub(r"\s*\(\d+\)\s*$", "", child[child.find("+- ") + 3:]).strip())
    return out
