"""Per-project spend report and its three entry points.

* ``project_cost_report``  raw report: nulls where a period has no spend.
* ``api_flavour``          the API's view of it: null numbers -> 0.0, null id
  -> "", null array elements -> 0.0, a null array stays null.
* ``project_records``      nested ``(id, costs struct)`` records.
* ``select_fields``        field selection; unselected metrics are pruned
  from the aggregate by Catalyst.
* ``all_projects`` / ``projects`` / ``project``: the entry points.

``as_of`` is always explicit (default: today in UTC, computed on the driver),
never ``current_date()`` inside the plan, so a report is reproducible.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import schema as S
from spendlens.functions.calendar import ReportCalendar
from spendlens.operators.monthly import cube_window, final_cost_cube, is_cost_cube, project_ids
from spendlens.operators.periods import period_report, period_total, report_over_history
from spendlens.sources.billing import filter_projects, load_billing, may_be_listed, normalize_ids, usage_before, usage_between


def project_cost_report(billing: DataFrame, as_of=None, prune_history: bool = True,
                        through_as_of: bool = False) -> DataFrame:
    """Raw report, one row per project id ever seen (null id included).

    ``billing`` is an export or an already aggregated monthly cost cube.

    Periods are whole months / years: usage dated after ``as_of`` inside the
    current month, year or fiscal year is counted, as the original query does.
    ``through_as_of=True`` drops usage after ``as_of`` first (for back-dated
    reports that should not see the future).

    ``prune_history=True`` (default) reads all history only for the id column
    and reads money columns only for the months the report covers (the window
    is a pushed-down range filter on ``usage_start_time``, which skips row
    groups / files of a time-ordered export).  ``False`` reads everything once
    and conditionally aggregates: one scan, two shuffles.  Both give the same
    rows.
    """
    if is_cost_cube(billing):
        if through_as_of:
            raise ValueError("through_as_of needs usage lines, not an aggregated cube")
        return cube_cost_report(billing, as_of) if prune_history else period_report(billing, as_of)
    billing = load_billing(billing)
    cal = ReportCalendar.for_date(as_of)
    if through_as_of:
        billing = usage_before(billing, cal.as_of + dt.timedelta(days=1))
    if not prune_history:
        return period_report(final_cost_cube(billing), cal.as_of)
    lo, hi = cal.scan_window()
    cube = final_cost_cube(usage_between(billing, lo, hi))
    return report_over_history(project_ids(billing), cube, cal.as_of)


def cube_cost_report(cube: DataFrame, as_of=None, ids: DataFrame | None = None) -> DataFrame:
    """Raw report from an already aggregated cube (e.g. a stored one).

    The metrics come from the report's months only, a filter that prunes the
    years and row groups of a stored cube.  ``ids`` (project_id, one row each)
    says which projects exist, as ``cube_store.read_project_ids`` does; without
    it they are read from every month of the cube.
    """
    cal = ReportCalendar.for_date(as_of)
    window = cube_window(cube, *cal.scan_window())
    ids = cube.select(S.PROJECT_ID).distinct() if ids is None else ids.select(S.PROJECT_ID)
    return report_over_history(ids, window, cal.as_of)


def billing_period_total(billing: DataFrame, as_of, period: str, name: str | None = None) -> DataFrame:
    """One period's total per project, reading only that period's usage rows.

    Projects without rows in the period are absent; the null project is its
    own group.  The period's date range is a pushed-down scan filter.
    """
    cal = ReportCalendar.for_date(as_of)
    lo, hi = cal.period_window(period)
    if is_cost_cube(billing):
        cube = cube_window(billing, lo, hi)
    else:
        cube = final_cost_cube(usage_between(load_billing(billing), lo, hi))
    return period_total(cube, cal.as_of, period, name=name)


def api_flavour(report: DataFrame, key: str = S.PROJECT_ID) -> DataFrame:
    """Null numbers become 0.0 and a null id becomes "", like the API layer does."""
    cols = []
    for name in report.columns:
        c = F.col(name)
        if name == key:
            cols.append(F.coalesce(c, F.lit("")).alias(name))
        elif name in S.REPORT_METRICS or name in (S.CURRENT_FISCAL_ESTIMATED, S.CURRENT_CALENDAR_ESTIMATED):
            cols.append(F.coalesce(c, F.lit(0.0)).alias(name))
        elif name == S.LAST_SIX_MONTHS:
            cols.append(F.transform(c, lambda x: F.coalesce(x, F.lit(0.0))).alias(name))
        else:
            cols.append(c)
    return report.select(*cols)


def costs_struct(report: DataFrame) -> Column:
    """The API's eleven cost fields of a report as one struct, estimates null unless the report has them."""
    fields = [F.col(f) for f in S.REPORT_FIELDS if f in report.columns]
    for name in (S.CURRENT_FISCAL_ESTIMATED, S.CURRENT_CALENDAR_ESTIMATED):
        fields.append(F.col(name) if name in report.columns else F.lit(None).cast("double").alias(name))
    return F.struct(*fields).alias("costs")


def project_records(report: DataFrame) -> DataFrame:
    """Nested records ``id`` + ``costs`` struct (one per project).

    ``costs`` has the API's eleven fields: the report's, plus the two year-end
    estimates, which are null unless computed (``estimates.with_estimates``),
    as the original API leaves them unset.
    """
    return report.select(F.col(S.PROJECT_ID).alias("id"), costs_struct(report))


def select_fields(report: DataFrame, fields: Sequence[str], key: str = S.PROJECT_ID) -> DataFrame:
    """Keep the key plus the requested report fields, in the requested order."""
    unknown = [f for f in fields if f not in report.columns or f == key]
    if unknown:
        raise ValueError(f"unknown report fields: {unknown}; available: {[c for c in report.columns if c != key]}")
    seen = list(dict.fromkeys(fields))
    return report.select(key, *seen)


def _finish(report: DataFrame, flavour: str) -> DataFrame:
    if flavour == "api":
        return api_flavour(report)
    if flavour == "raw":
        return report
    raise ValueError(f"flavour must be 'api' or 'raw', got {flavour!r}")


def all_projects(billing: DataFrame, as_of=None, flavour: str = "api", prune_history: bool = True,
                 through_as_of: bool = False) -> DataFrame:
    """Report for every project in the export."""
    return _finish(project_cost_report(billing, as_of, prune_history, through_as_of), flavour)


def projects(billing: DataFrame, ids: str | Iterable[str] | DataFrame | None, as_of=None, flavour: str = "api",
             prune_history: bool = True) -> DataFrame:
    """Report for the listed projects.

    Unknown ids give no row, duplicates give one row, an empty list gives no
    rows, a null element raises ``ValueError``.

    Python ids (a string, a list, any iterable) are applied before aggregation
    as ``project.id IN (...)``, which reaches the parquet reader.  An id
    DataFrame, the way for long lists, becomes a Bloom filter on the usage lines
    (``may_be_listed``), so that few lines of other projects are aggregated, and
    an exact left-semi join between two per-project tables behind the report:
    the raw export is never shuffled to meet the ids.  Both give the same rows,
    since a project's report depends only on its own usage lines.
    """
    if isinstance(ids, DataFrame):
        keys = ids.select(S.PROJECT_ID).where(F.col(S.PROJECT_ID).isNotNull()).distinct()
        chosen = billing if is_cost_cube(billing) else may_be_listed(load_billing(billing), keys)
        report = project_cost_report(chosen, as_of, prune_history)
        return _finish(report.join(keys, on=S.PROJECT_ID, how="left_semi"), flavour)
    if is_cost_cube(billing):
        chosen = billing.where(F.col(S.PROJECT_ID).isin(normalize_ids(ids)))
    else:
        chosen = filter_projects(load_billing(billing), ids)
    return _finish(project_cost_report(chosen, as_of, prune_history), flavour)


def project(billing: DataFrame, project_id: str, as_of=None, flavour: str = "api",
            prune_history: bool = True) -> DataFrame:
    """Report for one project: a DataFrame with one row, or none when unknown."""
    if project_id is None:
        raise ValueError("project id must not be null")
    return projects(billing, [project_id], as_of, flavour, prune_history)
