"""Year-end estimates (``currentFiscalEstimated``, ``currentCalendarYearEstimated``).

Declared by the original API and never computed there; this project defines
them as a linear run rate: the period's spend so far divided by the days
elapsed up to and including ``as_of``, times the days in the period.  The day
counts are driver-side constants, so the whole operator is two multiplications
on top of the report.  They exist for every place the API declares them: project
costs, unit costs and carbon.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import schema as S
from spendlens.functions.calendar import ReportCalendar
from spendlens.operators.carbon import carbon_report, validate_carbon
from spendlens.operators.monthly import TO_DATE, final_cost_cube, is_cost_cube, monthly_carbon, project_ids
from spendlens.operators.org import UNIT_COLUMNS, org_unit_costs
from spendlens.operators.periods import finish, period_predicates, period_sums, valid_key
from spendlens.operators.report import project_cost_report
from spendlens.sources.billing import load_billing, usage_between


def run_rate(to_date, period_days: int, elapsed_days: int):
    """``to_date * period_days / elapsed_days`` (null when nothing has elapsed)."""
    if elapsed_days <= 0:
        return F.lit(None).cast("double")
    return to_date * F.lit(period_days) / F.lit(elapsed_days)


def with_estimates(report: DataFrame, as_of=None) -> DataFrame:
    cal = ReportCalendar.for_date(as_of)
    fiscal = run_rate(F.col(S.CURRENT_FISCAL_YEAR), cal.fiscal_days, cal.days_elapsed(cal.fy_start))
    calendar = run_rate(F.col(S.CURRENT_CALENDAR_YEAR), cal.calendar_days,
                        cal.days_elapsed(dt.date(cal.year, 1, 1)))
    return report.withColumn(S.CURRENT_FISCAL_ESTIMATED, fiscal).withColumn(S.CURRENT_CALENDAR_ESTIMATED, calendar)


#: Sums of usage up to the report date, of the fiscal and the calendar year.
SPENT = {"_fiscal_spent": "current_fiscal_year", "_calendar_spent": "current_calendar_year"}


def spent_sums(as_of, value: str = S.FINAL_COST, valid: Column | None = None) -> list[Column]:
    """Aggregates over a cube with ``value`` up to the report date: what the estimates scale."""
    inside = period_predicates(ReportCalendar.for_date(as_of), F.col(S.MONTH))
    valid = F.lit(True) if valid is None else valid
    return [F.sum(F.when(valid & inside[p], F.col(value + TO_DATE))).alias(c) for c, p in SPENT.items()]


def estimate_columns(as_of) -> list[Column]:
    """The two estimates from the columns of ``spent_sums``."""
    cal = ReportCalendar.for_date(as_of)
    starts = (cal.fy_start, cal.fiscal_days), (dt.date(cal.year, 1, 1), cal.calendar_days)
    names = (S.CURRENT_FISCAL_ESTIMATED, S.CURRENT_CALENDAR_ESTIMATED)
    return [run_rate(F.col(c).cast("double"), days, cal.days_elapsed(first)).alias(n)
            for c, (first, days), n in zip(SPENT, starts, names, strict=True)]


def _one_pass(ids: DataFrame, cube: DataFrame, as_of, value: str) -> DataFrame:
    keys = [S.PROJECT_ID]
    valid = valid_key(keys)
    sums = cube.groupBy(*keys).agg(*period_sums(as_of, value, valid), *spent_sums(as_of, value, valid)).where(valid)
    report = finish(sums, keys, list(SPENT)).select("*", *estimate_columns(as_of)).drop(*SPENT)
    return ids.join(report, on=keys, how="left")


def cost_report_with_estimates(billing: DataFrame, as_of=None) -> DataFrame:
    """The raw project report with both estimates, in the scans of the report alone.

    The month of the report date is split at that date in the one cube, so the
    estimates, which count usage up to it, need no pass of their own.
    """
    if is_cost_cube(billing):
        raise ValueError("estimates need usage lines, not an aggregated cube")
    billing = load_billing(billing)
    cal = ReportCalendar.for_date(as_of)
    cube = final_cost_cube(usage_between(billing, *cal.scan_window()), through=cal.as_of)
    return _one_pass(project_ids(billing), cube, cal.as_of, S.FINAL_COST)


def carbon_report_with_estimates(carbon: DataFrame, as_of=None) -> DataFrame:
    """The same over kilograms."""
    validate_carbon(carbon)
    cal = ReportCalendar.for_date(as_of)
    cube = monthly_carbon(usage_between(carbon, *cal.scan_window()), through=cal.as_of)
    return _one_pass(project_ids(carbon), cube, cal.as_of, S.CARBON_KG)


_ESTIMATES = (S.CURRENT_FISCAL_YEAR, S.CURRENT_FISCAL_ESTIMATED, S.CURRENT_CALENDAR_YEAR, S.CURRENT_CALENDAR_ESTIMATED)


def cost_estimates(billing: DataFrame, as_of=None) -> DataFrame:
    """Per project: fiscal and calendar year to date plus their run-rate estimates.

    Only usage up to and including ``as_of`` counts as spent, so a back-dated
    report does not scale up its own future.
    """
    report = project_cost_report(billing, as_of, through_as_of=True)
    return with_estimates(report, as_of).select(S.PROJECT_ID, *_ESTIMATES)


def carbon_estimates(carbon: DataFrame, as_of=None) -> DataFrame:
    """Per project: the same estimates over kilograms."""
    return with_estimates(carbon_report(carbon, as_of, through_as_of=True), as_of).select(S.PROJECT_ID, *_ESTIMATES)


def org_estimates(billing: DataFrame, dim: DataFrame, as_of=None, levels: Sequence[str] | None = None) -> DataFrame:
    """Per organisational unit: the same estimates over the unit's spend."""
    report = org_unit_costs(billing, dim, as_of, levels, through_as_of=True)
    return with_estimates(report, as_of).select(*UNIT_COLUMNS, *_ESTIMATES)
