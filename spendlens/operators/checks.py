"""Data checks taken while the report runs.

``checked_report`` is the full report of every project with metrics observed on
the tables that it computes anyway (``Dataset.observe``): on the dimension's rows,
on its one row per project, on the monthly cube and on the finished report.  The
metrics are there once the report has been written or collected; no table is
scanned for them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spendlens import schema as S
from spendlens.functions.measures import as_double
from spendlens.operators.monthly import cost_cube
from spendlens.operators.org import validate_dim
from spendlens.operators.periods import period_report
from spendlens.operators.report import api_flavour

CHECKS = ("invalid_classifications", "duplicate_projects", "null_project_spend", "projects_without_dimension")


@dataclass(frozen=True)
class ReportChecks:
    """The observations of one report."""

    parts: tuple[Observation, ...]

    def metrics(self) -> dict:
        """``CHECKS`` by name; waits until the report has run.

        ``invalid_classifications`` counts dimension rows with a null class or one
        outside the domain, ``duplicate_projects`` ids listed more than once,
        ``projects_without_dimension`` billed ids that it lacks.
        ``null_project_spend`` is the spend without a project, null where there is none.
        """
        found: dict = {}
        for part in self.parts:
            found |= part.get
        return {name: found[name] for name in CHECKS}


def checked_report(billing: DataFrame, dim: DataFrame, as_of=None, flavour: str = "api") -> tuple[DataFrame, ReportChecks]:
    """(report with classification and owner, its checks), from one scan of the export (or of a cube) and one of ``dim``.

    The rows are those of the project report in its one-scan form.  A project
    listed more than once has its least row, as in the unit reports.
    """
    validate_dim(dim)
    rows, projects, months, shown = parts = tuple(Observation() for _ in CHECKS)
    c = F.col("classification")
    dim = dim.observe(rows, F.count_if(c.isNull() | ~c.isin(list(S.CLASSIFICATIONS))).alias("invalid_classifications"))
    attributes = [n for n in S.PROJECT_DIM_SCHEMA.fieldNames() if n != S.PROJECT_ID]
    owners = (dim.where(F.col(S.PROJECT_ID).isNotNull()).groupBy(S.PROJECT_ID)
              .agg(F.min(F.struct(*attributes)).alias("row"), F.count("*").alias("times"))
              .observe(projects, F.count_if(F.col("times") > 1).alias("duplicate_projects")))
    cube = cost_cube(billing).select(S.MONTH, S.PROJECT_ID, S.FINAL_COST).observe(
        months, as_double(F.sum(F.when(F.col(S.PROJECT_ID).isNull(), F.col(S.FINAL_COST)))).alias("null_project_spend"))
    report = period_report(cube, as_of).join(owners, on=S.PROJECT_ID, how="left").observe(
        shown, F.count_if(F.col(S.PROJECT_ID).isNotNull() & F.col("times").isNull()).alias("projects_without_dimension"))
    report = report.select(S.PROJECT_ID, *S.REPORT_FIELDS, F.col("row.classification").alias("classification"),
                           F.col("row.department").alias("owner"), F.col("row.department_acronym").alias("owner_acronym"))
    return (api_flavour(report) if flavour == "api" else report), ReportChecks(parts)
