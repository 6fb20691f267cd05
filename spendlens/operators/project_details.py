"""The full project record: costs, classification, owner and carbon footprint.

One call answers an API request for ``id``, ``costs``, ``classification``,
``owner`` and ``carbonFootprint`` together.  Every input is first reduced to
one row per project (cost report, carbon report, dimension), so the joins are
between per-project tables and never touch raw usage lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens import schema as S
from spendlens.operators.carbon import carbon_report
from spendlens.operators.estimates import carbon_report_with_estimates, cost_report_with_estimates
from spendlens.operators.org import project_dimension
from spendlens.operators.report import api_flavour, project_cost_report

_CARBON_PREFIX = "carbon_"
_ESTIMATED = (S.CURRENT_FISCAL_ESTIMATED, S.CURRENT_CALENDAR_ESTIMATED)


def project_details(billing: DataFrame, as_of=None, dim: DataFrame | None = None, carbon: DataFrame | None = None,
                    flavour: str = "api", nested: bool = True, estimates: bool = False) -> DataFrame:
    """One row per billed project with every field of the API's Project type.

    ``nested=True`` gives ``id, costs struct, classification, owner struct
    (name, acronym), carbonFootprint struct``; both structs carry the API's
    eleven fields, the two year-end estimates null as the original leaves them
    unless ``estimates`` asks for them; ``nested=False`` gives the same values as
    flat columns (carbon metrics prefixed ``carbon_``).  Fields whose input is
    not given are null.  Estimates come from the report's own scans.
    """
    def shown(report: DataFrame) -> DataFrame:
        report = api_flavour(report) if flavour == "api" else report
        return report if estimates else report.select("*", *[F.lit(None).cast("double").alias(n) for n in _ESTIMATED])

    out = shown((cost_report_with_estimates if estimates else project_cost_report)(billing, as_of))
    metrics = [c for c in out.columns if c != S.PROJECT_ID]
    if carbon is not None:
        kg = shown((carbon_report_with_estimates if estimates else carbon_report)(carbon, as_of))
        kg = kg.where(F.col(S.PROJECT_ID).isNotNull()).select(
            S.PROJECT_ID, *[F.col(c).alias(_CARBON_PREFIX + c) for c in metrics])
        out = out.join(kg, on=S.PROJECT_ID, how="left")
    carbon_cols = [c for c in out.columns if c.startswith(_CARBON_PREFIX)]
    if dim is not None:
        d = project_dimension(dim).select(S.PROJECT_ID, "classification", F.col("department").alias("owner"),
                                          F.col("department_acronym").alias("owner_acronym"))
        out = out.join(d, on=S.PROJECT_ID, how="left")
    else:
        out = out.select("*", *[F.lit(None).cast("string").alias(c)
                                for c in ("classification", "owner", "owner_acronym")])
    if not nested:
        return out.select(S.PROJECT_ID, *metrics, "classification", "owner", "owner_acronym", *carbon_cols)
    carbon_struct = (F.struct(*[F.col(c).alias(c[len(_CARBON_PREFIX):]) for c in carbon_cols])
                     if carbon_cols else F.lit(None))
    return out.select(
        F.col(S.PROJECT_ID).alias("id"),
        F.struct(*metrics).alias("costs"),
        "classification",
        F.when(F.col("owner").isNotNull(),
               F.struct(F.col("owner").alias("name"), F.col("owner_acronym").alias("acronym"))).alias("owner"),
        carbon_struct.alias("carbonFootprint"),
    )
