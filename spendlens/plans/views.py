"""SQL surface: the reports as temporary views, ids as a named array parameter.

For users who write Spark SQL: ``register_views`` names the billing input, its
monthly cube and the report so that ``spark.sql`` can query them (the caller
drops them), and ``projects_sql`` runs the per-project report with the ids bound
as named parameters (Spark's ``args=``), never spliced into the text.
The views are the same lazy DataFrames as the Python API, so Catalyst plans
them identically.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame

from spendlens.operators import org
from spendlens.operators.carbon import carbon_report
from spendlens.operators.monthly import monthly_costs
from spendlens.operators.report import project_cost_report
from spendlens.sources.billing import load_billing, normalize_ids


def register_views(billing: DataFrame, as_of=None, dim: DataFrame | None = None, carbon: DataFrame | None = None,
                   prefix: str | None = None) -> dict[str, str]:
    """Register temp views and return {role: view name}.

    Roles: ``billing``, ``monthly``, ``report`` (raw), plus ``org_units`` with
    a dimension and ``carbon_report`` with a carbon table.  ``prefix``
    defaults to a fresh unique one so that concurrent callers never collide.
    """
    prefix = prefix or f"spend_{uuid.uuid4().hex[:12]}"
    billing = load_billing(billing)
    frames = {
        "billing": billing,
        "monthly": monthly_costs(billing),
        "report": project_cost_report(billing, as_of),
    }
    if dim is not None:
        frames["org_units"] = org.org_units(billing, dim, as_of, carbon=carbon)
    if carbon is not None:
        frames["carbon_report"] = carbon_report(carbon, as_of)
    names = {}
    for role, df in frames.items():
        name = f"{prefix}_{role}"
        df.createOrReplaceTempView(name)
        names[role] = name
    return names


def projects_sql(billing: DataFrame, ids: str | Iterable[str] | None, as_of=None, api: bool = True) -> DataFrame:
    """The per-project report for ``ids`` written as Spark SQL.

    Each id is bound as a named parameter of an ``IN`` list on the usage lines,
    so the filter reaches the reader.  No view is left behind.
    """
    wanted = normalize_ids(ids)
    billing = load_billing(billing)
    spark = billing.sparkSession
    params = {f"id{i}": wanted_id for i, wanted_id in enumerate(wanted)}
    chosen = f"project.id IN ({', '.join(':' + p for p in params)})" if params else "FALSE"
    lines = spark.sql(f"SELECT * FROM {{lines}} WHERE {chosen}", args=params, lines=billing)
    report = project_cost_report(lines, as_of)
    if not api:
        return report
    select = ", ".join(
        "coalesce(project_id, '') AS project_id" if c == "project_id"
        else f"transform({c}, x -> coalesce(x, 0D)) AS {c}" if c == "lastSixMonths"
        else f"coalesce({c}, 0D) AS {c}"
        for c in report.columns
    )
    return spark.sql(f"SELECT {select} FROM {{report}}", report=report)
