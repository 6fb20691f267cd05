"""Carbon footprint report: the cost report's periods over kilograms.

Declared by the original API (per project, with the same eleven fields as
costs) but never computed there; here it is the very same period report run
over a carbon cube, so every rule (null project, newest-first six months,
fiscal years) is shared with the cost report.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from spendlens import schema as S
from spendlens.functions.calendar import ReportCalendar
from spendlens.operators.monthly import monthly_carbon, project_ids
from spendlens.operators.periods import period_report, report_over_history
from spendlens.sources.billing import usage_before, usage_between, validate_billing


def read_carbon(spark, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Read a carbon table; text formats get ``schema.CARBON_SCHEMA`` unless one is given."""
    reader = spark.read.format(fmt).options(**options)
    if schema is None and fmt.lower() in ("json", "csv", "text"):
        schema = S.CARBON_SCHEMA
    if schema is not None:
        reader = reader.schema(schema)
    carbon = reader.load(path)
    validate_carbon(carbon)
    return carbon


def validate_carbon(carbon: DataFrame) -> None:
    if S.CARBON_KG not in carbon.columns:
        raise ValueError(f"carbon table lacks '{S.CARBON_KG}'")
    validate_billing(carbon.withColumn(S.COST, carbon[S.CARBON_KG]).withColumn(S.CREDITS_SUM_AMOUNT, carbon[S.CARBON_KG]))


def carbon_report(carbon: DataFrame, as_of=None, prune_history: bool = True,
                  through_as_of: bool = False) -> DataFrame:
    """Per project: kilograms this month, previous month, years, fiscal years, deltas.

    ``through_as_of=True`` drops usage dated after ``as_of`` first."""
    validate_carbon(carbon)
    cal = ReportCalendar.for_date(as_of)
    if through_as_of:
        carbon = usage_before(carbon, cal.as_of + dt.timedelta(days=1))
    if not prune_history:
        return period_report(monthly_carbon(carbon), cal.as_of, value=S.CARBON_KG)
    lo, hi = cal.scan_window()
    cube = monthly_carbon(usage_between(carbon, lo, hi))
    return report_over_history(project_ids(carbon), cube, cal.as_of, value=S.CARBON_KG)
