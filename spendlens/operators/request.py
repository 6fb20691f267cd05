"""Several root fields in one request, answered from one pass over the export.

A request names its root fields: ``{alias: RootField(entry, fields, ids or name)}``.
What all of them need together is planned first: the months of the periods that
their fields cover, the projects they may ask for, whether usage up to the report
date is told apart.  One scan aggregates that into one cube, which is stored once
under the shared folder; every root field is answered from the stored cube.

The cube has one row per month and project inside the needed months, and one row
without month per project for the rest of its history, since a project that was
ever billed has a report.  Money outside the needed months is not added up.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import schema as S
from spendlens.functions.calendar import ReportCalendar, month_of
from spendlens.functions.measures import as_double
from spendlens.operators import org
from spendlens.operators.estimates import SPENT, estimate_columns, spent_sums
from spendlens.operators.monthly import final_cost_cube
from spendlens.operators.periods import add_up, finish, period_sums, valid_key
from spendlens.operators.report import api_flavour, select_fields
from spendlens.sources.billing import load_billing, may_be_listed, normalize_ids, project_id_col, usage_date
from spendlens.sources.cube_store import new_store_path

PROJECT_ENTRIES = ("allProjects", "projects", "project")
UNIT_ENTRIES = tuple(S.ORG_LEVELS)
ESTIMATES = (S.CURRENT_FISCAL_ESTIMATED, S.CURRENT_CALENDAR_ESTIMATED)
UNIT_FIELDS = ("projectCount", "totalCloudSpend")

#: The periods that a field is computed from.
PERIODS_OF = {
    S.CURRENT_MONTH: ("current_month",),
    S.PREVIOUS_MONTH: ("previous_month",),
    S.MONTH_DELTA: ("current_month", "previous_month"),
    S.CURRENT_CALENDAR_YEAR: ("current_calendar_year",),
    S.PREVIOUS_CALENDAR_YEAR: ("previous_calendar_year",),
    S.CURRENT_FISCAL_YEAR: ("current_fiscal_year",),
    S.PREVIOUS_FISCAL_YEAR: ("previous_fiscal_year",),
    S.FISCAL_DELTA: ("current_fiscal_year", "previous_fiscal_year"),
    S.LAST_SIX_MONTHS: ("last_six_months",),
    S.CURRENT_FISCAL_ESTIMATED: ("current_fiscal_year",),
    S.CURRENT_CALENDAR_ESTIMATED: ("current_calendar_year",),
    "projectCount": (),
}


@dataclass(frozen=True)
class RootField:
    """One root field: its entry point, the fields asked for, and the ids or the unit's name.

    ``ids`` is a string, a list or (for ``projects``) a DataFrame with ``project_id``.
    """

    entry: str
    fields: tuple[str, ...]
    ids: str | Iterable[str] | DataFrame | None = None
    name: str | None = None

    def check(self) -> None:
        known = (*S.REPORT_FIELDS, *ESTIMATES, *(UNIT_FIELDS if self.entry in UNIT_ENTRIES else ()))
        unknown = [f for f in self.fields if f not in known]
        if self.entry not in (*PROJECT_ENTRIES, *UNIT_ENTRIES):
            raise ValueError(f"unknown entry point {self.entry!r}; expected one of {[*PROJECT_ENTRIES, *UNIT_ENTRIES]}")
        if unknown:
            raise ValueError(f"{self.entry} has no fields {unknown}; available: {list(known)}")
        if self.entry in UNIT_ENTRIES and self.name is None:
            raise ValueError(f"{self.entry} needs a name")
        if self.entry == "project" and not isinstance(self.ids, str):
            raise ValueError("project needs one id")


@dataclass(frozen=True)
class RequestPlan:
    """What all root fields of a request need together."""

    as_of: dt.date
    #: Half-open ranges of days, in order and apart from each other; None for all history.
    months: tuple[tuple[dt.date, dt.date], ...] | None
    to_date: bool
    #: Ids known here; None where some root field needs every project or its projects come from a table.
    ids: tuple[str, ...] | None
    #: Whether the projects are those of tables (id tables, units) and ``ids``.
    from_tables: bool


def _merged(ranges: Iterable[tuple[dt.date, dt.date]]) -> tuple[tuple[dt.date, dt.date], ...]:
    out: list[tuple[dt.date, dt.date]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return tuple(out)


def plan_request(request: Mapping[str, RootField], as_of=None) -> RequestPlan:
    """The union of the months, ids and measures of all root fields."""
    cal = ReportCalendar.for_date(as_of)
    for field in request.values():
        field.check()
    asked = {f for field in request.values() for f in field.fields}
    whole = "totalCloudSpend" in asked
    months = None if whole else _merged(cal.period_window(p) for f in asked for p in PERIODS_OF[f])
    everyone = any(f.entry == "allProjects" for f in request.values())
    tables = any(f.entry in UNIT_ENTRIES or isinstance(f.ids, DataFrame) for f in request.values())
    listed = dict.fromkeys(i for f in request.values() if f.entry in ("projects", "project") and not isinstance(f.ids, DataFrame)
                           for i in normalize_ids(f.ids))
    return RequestPlan(cal.as_of, months, bool(asked & set(ESTIMATES)), None if everyone or tables else tuple(listed),
                       tables and not everyone)


def _inside(day: Column, ranges: tuple[tuple[dt.date, dt.date], ...] | None) -> Column:
    if ranges is None:
        return F.lit(True)
    tests = [(day >= F.lit(lo)) & (day < F.lit(hi)) for lo, hi in ranges]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def _listed(request: Mapping[str, RootField], dim: DataFrame | None, billing: DataFrame) -> DataFrame:
    """The ids of all root fields as one table."""
    spark = billing.sparkSession
    out = spark.createDataFrame([], f"{S.PROJECT_ID} string")
    for field in request.values():
        if field.entry in UNIT_ENTRIES:
            more = org.named_projects(dim, field.entry, field.name)
        elif isinstance(field.ids, DataFrame):
            more = field.ids
        else:
            more = spark.createDataFrame([(i,) for i in normalize_ids(field.ids)], f"{S.PROJECT_ID} string")
        out = out.unionByName(more.select(F.col(S.PROJECT_ID).cast("string").alias(S.PROJECT_ID)))
    return out


def shared_cube(billing: DataFrame, request: Mapping[str, RootField], as_of=None, dim: DataFrame | None = None) -> DataFrame:
    """(month, project_id, final_cost[, final_cost_to_date]): all a request needs, in one scan of the export."""
    plan = plan_request(request, as_of)
    if dim is None and any(f.entry in UNIT_ENTRIES for f in request.values()):
        raise ValueError("units need a project dimension")
    billing = load_billing(billing)
    if plan.ids is not None:
        billing = billing.where(project_id_col().isin(list(plan.ids)))
    elif plan.from_tables:
        billing = may_be_listed(billing, _listed(request, dim, billing))
    day = usage_date(billing)
    inside = _inside(day, plan.months)
    money = [F.when(inside, F.col(c)).alias(c) for c in (S.COST, S.CREDITS_SUM_AMOUNT)]
    rows = billing.select(S.USAGE_START_TIME, S.PROJECT, *money)
    month = F.when(inside, month_of(usage_date(rows)))
    return final_cost_cube(rows, through=plan.as_of if plan.to_date else None, month=month)


def _project_answer(cube: DataFrame, field: RootField, plan: RequestPlan, flavour: str) -> DataFrame:
    tables = isinstance(field.ids, DataFrame)
    if field.entry != "allProjects" and not tables:
        cube = cube.where(F.col(S.PROJECT_ID).isin(normalize_ids(field.ids)))
    keys = [S.PROJECT_ID]
    valid = valid_key(keys)
    spent = spent_sums(plan.as_of, valid=valid) if plan.to_date else []
    report = finish(cube.groupBy(*keys).agg(*period_sums(plan.as_of, valid=valid), *spent), keys, list(SPENT) if spent else [])
    if spent:
        report = report.select("*", *estimate_columns(plan.as_of)).drop(*SPENT)
    if tables:
        report = report.join(field.ids.select(F.col(S.PROJECT_ID).cast("string").alias(S.PROJECT_ID)), S.PROJECT_ID, "left_semi")
    return select_fields(api_flavour(report) if flavour == "api" else report, field.fields)


def _unit_answer(cube: DataFrame, field: RootField, plan: RequestPlan, dim: DataFrame) -> DataFrame:
    members = org.unit_memberships(org.named_projects(dim, field.entry, field.name), [field.entry])
    spent = spent_sums(plan.as_of) if plan.to_date else []
    rows = cube.where(F.col(S.PROJECT_ID).isNotNull()).groupBy(S.PROJECT_ID).agg(
        *period_sums(plan.as_of), *spent, F.sum(S.FINAL_COST).alias("_total"))
    return org.unit_answers(members, rows, [
        *add_up(), *[F.sum(c).alias(c) for c in (SPENT if spent else ())], F.count("*").alias("projectCount"),
        as_double(F.sum("_total")).alias("totalCloudSpend")], [*(SPENT if spent else ()), *UNIT_FIELDS]).select(
        "*", *(estimate_columns(plan.as_of) if spent else ())).select(*org.UNIT_COLUMNS, *dict.fromkeys(field.fields))


def answer(billing: DataFrame, request: Mapping[str, RootField], as_of=None, dim: DataFrame | None = None,
           flavour: str = "api", path: str | None = None) -> dict[str, DataFrame]:
    """{alias: DataFrame} of every root field, the rows and values of the entry point on its own.

    Projects have ``project_id`` and the fields asked for; units their path and
    the fields (raw: null where a unit has no spend in a period).  The shared cube
    is written to ``path``, by default a new folder under the shared one
    (``cube_store.drop_store`` deletes it); an empty request writes nothing.
    """
    if flavour not in ("api", "raw"):
        raise ValueError(f"flavour must be 'api' or 'raw', got {flavour!r}")
    if not request:
        return {}
    plan = plan_request(request, as_of)
    spark = billing.sparkSession
    cube = shared_cube(billing, request, as_of, dim)
    path = path or new_store_path(spark, "request-cube")
    cube.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(cube.schema).parquet(path)
    return {alias: _unit_answer(stored, f, plan, dim) if f.entry in UNIT_ENTRIES else _project_answer(stored, f, plan, flavour)
            for alias, f in request.items()}
