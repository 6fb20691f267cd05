"""Every report of a dashboard from one pass over the export.

``spend_reports`` aggregates the export once into the monthly cost cube,
stores it under the session's shared checkpoint folder (cutting lineage: a
lost executor recomputes from the stored cube, not from the export), and
derives each report from that small table.  On a large export this replaces
one full scan per report with one scan in total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from spendlens.operators import org
from spendlens.operators.carbon import carbon_report
from spendlens.operators.report import all_projects
from spendlens.sources.cube_store import materialize_costs


def spend_reports(billing: DataFrame, as_of=None, dim: DataFrame | None = None, carbon: DataFrame | None = None,
                  store_path: str | None = None) -> dict[str, DataFrame]:
    """{name: DataFrame} for the project report and, with a dimension, the unit
    reports, roll-up and classification spend; with a carbon table, the carbon
    report.  All cost reports read the one stored cube."""
    cube = materialize_costs(billing, store_path)
    out = {"projects": all_projects(cube, as_of)}
    if dim is not None:
        out["org_units"] = org.org_units(cube, dim, as_of, carbon=carbon)
        out["org_spend_rollup"] = org.org_spend_rollup(cube, dim)
        out["classification_spend"] = org.classification_spend(cube, dim)
        out["project_owner"] = org.project_owner(cube, dim)
    if carbon is not None:
        out["carbon_report"] = carbon_report(carbon, as_of)
    return out
