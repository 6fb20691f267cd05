"""Registered queries: every operator of the inventory run over the driver tables.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with the
DuckDB SQL that computes the same rows from the same parquet files (``None``
when there is no SQL form).  Inputs are whole tables; no row is sampled,
capped or filtered out to make a check cheaper.  Column names are identical
on both sides.
"""

from __future__ import annotations

import atexit
import contextlib
import datetime as dt
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens import schema as S
from spendlens.functions.calendar import fiscal_calendar_columns
from spendlens.functions.measures import as_double, credit_amount_type, first_credit_amount
from spendlens.operators import carbon as carbon_ops
from spendlens.operators import estimates, org
from spendlens.operators.checks import CHECKS, checked_report
from spendlens.operators.monthly import monthly_costs, project_ids
from spendlens.operators.project_details import project_details
from spendlens.operators.report import (
    all_projects,
    api_flavour,
    billing_period_total,
    cube_cost_report,
    project,
    project_cost_report,
    project_records,
    projects,
    select_fields,
)
from spendlens.operators.request import RootField, answer
from spendlens.operators.suite import spend_reports
from spendlens.plans import oracle as Q
from spendlens.plans.views import projects_sql
from spendlens.session import ensure_checkpoint_dir
from spendlens.sources import fixtures
from spendlens.sources.billing import filter_projects, load_billing, usage_date
from spendlens.sources.cube_store import drop_store, materialize_costs, read_cube, stored_report, write_cube
from spendlens.sources.running_totals import running_report, write_running_totals
from spendlens.streaming.cube_refresh import billing_stream, refresh_paths, start_cube_refresh

# Fixed parameters of the registered queries.
AS_OF = dt.date(2000, 9, 17)
OTHER_DATES = {
    "fiscal_start": dt.date(2000, 4, 1),
    "fiscal_end": dt.date(2000, 3, 31),
    "jan_mar": dt.date(2000, 1, 15),
    "empty_month": dt.date(2001, 12, 30),
    "first_year": dt.date(1995, 5, 31),
}
SAMPLE_IDS = ["1", "2", "3", "42", "no-such-project", "2"]
ONE_ID = "42"
DEPARTMENT = "AMERICA"
BRANCH = "NATION_7"
DIRECTORATE = "NATION_7-1"
PROJECTION = [S.CURRENT_MONTH, S.PREVIOUS_FISCAL_YEAR]


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    survey_id: str


def _billing(spark, sf):
    return fixtures.billing(spark, sf)


def _dim(spark, sf):
    return fixtures.project_dim(spark, sf)


def _carbon(spark, sf):
    return fixtures.carbon(spark, sf)


# --- S1 / S2: billing rows -------------------------------------------------

def _billing_rows(b: DataFrame) -> DataFrame:
    amount_type = credit_amount_type(b)
    return b.select(
        S.USAGE_START_TIME,
        F.col("project.id").alias(S.PROJECT_ID),
        as_double(F.col(S.COST)).alias(S.COST),
        as_double(F.col(S.CREDITS_SUM_AMOUNT)).alias(S.CREDITS_SUM_AMOUNT),
        F.size(f"{S.CREDITS}.amount").alias("n_credits"),
        as_double(first_credit_amount(amount_type)).alias("first_credit"),
    )


def billing_scan(spark, sf):
    # The export view's credit sum is dropped and re-derived from the array.
    return _billing_rows(load_billing(_billing(spark, sf).drop(S.CREDITS_SUM_AMOUNT)))


def billing_for_projects(spark, sf):
    return _billing_rows(filter_projects(_billing(spark, sf), SAMPLE_IDS))


_BILLING_ROWS_SQL = (
    "SELECT usage_start_time, project_id, CAST(cost AS DOUBLE) AS cost, "
    "CAST(credits_sum_amount AS DOUBLE) AS credits_sum_amount, n_credits, "
    "CAST(first_credit AS DOUBLE) AS first_credit FROM billing"
)
_IDS_SQL = ", ".join(f"'{i}'" for i in SAMPLE_IDS)

# --- M0-M7: monthly cube -----------------------------------------------------

# The registered cube keys show the month as the first instant of the month
# (a zone-less timestamp), the type the original cube's month column has.
def _cube_keys():
    return [F.col(S.MONTH).cast("timestamp_ntz").alias(S.MONTH), S.YEAR, S.PROJECT_ID]


def _cube_measure(measure: str):
    def build(spark, sf):
        cube = monthly_costs(_billing(spark, sf))
        return cube.select(*_cube_keys(), as_double(F.col(measure)).alias(measure))
    return build


def monthly_cube(spark, sf):
    cube = monthly_costs(_billing(spark, sf))
    measures = [S.FINAL_COST_NO_CREDITS, S.FIRST_CREDIT_TOTAL, S.ALL_CREDITS_TOTAL, S.FINAL_COST_FIRST_CREDIT,
                S.FINAL_COST]
    return cube.select(*_cube_keys(), *[as_double(F.col(m)).alias(m) for m in measures])


def _cube_sql(cols: str) -> str:
    return (f"WITH {Q.BILLING_CTE},{Q.cube_cte()}\n"
            f"SELECT CAST(month AS TIMESTAMP) AS month, year, project_id, {cols} FROM monthly")


def monthly_long_credits(spark, sf):
    cube = monthly_costs(load_billing(fixtures.billing_long_credits(spark, sf)))
    measures = [S.FIRST_CREDIT_TOTAL, S.ALL_CREDITS_TOTAL, S.FINAL_COST]
    return cube.select(*_cube_keys(), *[as_double(F.col(m)).alias(m) for m in measures])


_LONG_CREDITS_SQL = (f"WITH {Q.LONG_CREDITS_CTE},{Q.cube_cte()}\nSELECT CAST(month AS TIMESTAMP) AS month, year, project_id, "
                     "CAST(total_credits_computed1 AS DOUBLE) AS total_credits_computed1, "
                     "CAST(total_credits_computed2 AS DOUBLE) AS total_credits_computed2, "
                     "CAST(final_cost AS DOUBLE) AS final_cost FROM monthly")


def project_ids_query(spark, sf):
    return project_ids(_billing(spark, sf))


def fiscal_calendar(spark, sf):
    b = _billing(spark, sf)
    days = b.select(usage_date(b).alias("day")).distinct()
    return days.select("day", *[c.alias(n) for n, c in fiscal_calendar_columns(F.col("day")).items()])


_FISCAL_SQL = """
WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
starts AS (SELECT day, max(april) AS f0 FROM days,
           (SELECT make_date(CAST(y AS INTEGER), 4, 1) AS april FROM range(1980, 2040) AS years(y))
           WHERE april <= day GROUP BY day)
SELECT day, CAST(year(f0) AS INTEGER) AS fiscal_year,
       CAST(f0 - INTERVAL 1 YEAR AS DATE) AS prev_fy_start, CAST(f0 - INTERVAL 1 DAY AS DATE) AS prev_fy_end,
       f0 AS current_fy_start, CAST(f0 + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS current_fy_end
FROM starts"""

# --- P1-P9, R1: periods and the report ---------------------------------------


def _period(period: str, name: str):
    def build(spark, sf):
        return billing_period_total(_billing(spark, sf), AS_OF, period, name=name)
    return build


def last_six_months(spark, sf):
    report = project_cost_report(_billing(spark, sf), AS_OF)
    return report.select(S.PROJECT_ID, F.posexplode(S.LAST_SIX_MONTHS).alias("pos", "cost"))


_LSM_EXPLODED_SQL = f"""{Q.with_report(AS_OF)}
SELECT project_id, CAST(i - 1 AS INTEGER) AS pos, lastSixMonths[i] AS cost
FROM report, range(1, 7) AS places(i) WHERE i <= len(lastSixMonths)"""


def _report_cols(*cols):
    def build(spark, sf):
        return project_cost_report(_billing(spark, sf), AS_OF).select(S.PROJECT_ID, *cols)
    return build


def _report_cols_sql(*cols) -> str:
    return f"{Q.with_report(AS_OF)}\nSELECT project_id, {', '.join(cols)} FROM report"


def report_raw(spark, sf):
    return project_cost_report(_billing(spark, sf), AS_OF)


def report_single_pass(spark, sf):
    return project_cost_report(_billing(spark, sf), AS_OF, prune_history=False)


# --- E1-E3, S4-S6: entry points and result mapping ---------------------------

def _all_projects_on(as_of: dt.date):
    def build(spark, sf):
        return all_projects(_billing(spark, sf), as_of)
    return build


def projects_by_ids(spark, sf):
    return projects(_billing(spark, sf), SAMPLE_IDS, AS_OF)


def projects_by_ids_sql(spark, sf):
    return projects_sql(_billing(spark, sf), SAMPLE_IDS, AS_OF)


def projects_by_id_table(spark, sf):
    ids = fixtures.read_table(spark, sf, "supplier").where("s_suppkey % 3 = 1").select(
        F.col("s_suppkey").cast("string").alias(S.PROJECT_ID))
    return projects(_billing(spark, sf), ids, AS_OF)


_ID_TABLE_SQL = (f"{Q.with_report(AS_OF)}\nSELECT {Q.api_columns()} FROM report WHERE project_id IN "
                 "(SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 = 1)")


def project_by_id(spark, sf):
    return project(_billing(spark, sf), ONE_ID, AS_OF)


_COSTS_SQL = f"""struct_pack({', '.join(f'{m} := COALESCE({m}, 0.0)' for m in Q.METRICS)},
                   lastSixMonths := list_transform(lastSixMonths, lambda x: COALESCE(x, 0.0)),
                   currentFiscalEstimated := CAST(NULL AS DOUBLE),
                   currentCalendarYearEstimated := CAST(NULL AS DOUBLE))"""
_RECORDS_SQL = f"""{Q.with_report(AS_OF)}
SELECT COALESCE(project_id, '') AS id, {_COSTS_SQL} AS costs FROM report"""


def project_records_query(spark, sf):
    return project_records(api_flavour(project_cost_report(_billing(spark, sf), AS_OF)))


def report_projection(spark, sf):
    return select_fields(all_projects(_billing(spark, sf), AS_OF), PROJECTION)


# --- D1-D13: organisational units, carbon, estimates -------------------------

def org_unit_costs(spark, sf):
    return org.org_unit_costs(_billing(spark, sf), _dim(spark, sf), AS_OF)


def org_units_shared_names(spark, sf):
    dim = fixtures.shared_names_dim(_dim(spark, sf))
    return org.org_units(_billing(spark, sf), dim, AS_OF, carbon=_carbon(spark, sf))


def _unit_query(fn, name):
    def build(spark, sf):
        return fn(_billing(spark, sf), _dim(spark, sf), name, AS_OF, carbon=_carbon(spark, sf))
    return build


def _unit_sql(level: str, name: str) -> str:
    return Q.unit_totals_sql(AS_OF, where=f"report.level = '{level}' AND report.{level} = '{name}'")


def org_project_count(spark, sf):
    return org.org_project_count(_billing(spark, sf), _dim(spark, sf))


def org_spend_rollup(spark, sf):
    return org.org_spend_rollup(_billing(spark, sf), _dim(spark, sf))


_SPEND = (f"WITH {Q.BILLING_CTE}, {Q.DIM_CTE}, spent AS (SELECT d.*, b.cost, b.credits_sum_amount AS credit "
          "FROM billing b JOIN project_dim d ON b.project_id = d.project_id)")
_ROLLUP_SQL = f"""{_SPEND}
SELECT department, branch, directorate, CAST(GROUPING(department, branch, directorate) AS INTEGER) AS grouping_level,
       COUNT(DISTINCT project_id) AS projectCount, CAST(SUM(cost) + SUM(credit) AS DOUBLE) AS totalCloudSpend
FROM spent GROUP BY ROLLUP (department, branch, directorate)"""


def org_projects(spark, sf):
    return org.org_projects(_billing(spark, sf), _dim(spark, sf), AS_OF)


def _unit_projects(level: str, name: str):
    def build(spark, sf):
        return org.unit_projects(_billing(spark, sf), _dim(spark, sf), level, name, AS_OF)
    return build


def _org_projects_sql(where: str = "TRUE") -> str:
    return f"""{Q.with_report(AS_OF)}, {Q.DIM_CTE}
SELECT {Q.raw_columns()}, d.classification,
       d.department, d.department_acronym, d.branch, d.branch_acronym, d.directorate, d.directorate_acronym
FROM report JOIN project_dim d ON report.project_id = d.project_id WHERE {where}"""


def org_hierarchy(spark, sf):
    return org.org_hierarchy(_dim(spark, sf))


_HIERARCHY_SQL = f"""WITH {Q.DIM_CTE}
SELECT DISTINCT department, department_acronym, branch, branch_acronym, directorate, directorate_acronym
FROM project_dim"""


def _children(level: str, name: str, below: str):
    def build(spark, sf):
        return org.children(_dim(spark, sf), level, name, below)
    return build


_BELOW_DEPARTMENT = f"""WITH {Q.DIM_CTE}
SELECT DISTINCT 'directorate' AS level, directorate AS name, directorate_acronym AS acronym,
       department AS parent_department, branch AS parent_branch FROM project_dim WHERE """


def classification_spend(spark, sf):
    return org.classification_spend(_billing(spark, sf), _dim(spark, sf))


_CLASSIFICATION_SQL = f"""{_SPEND}
SELECT classification, COUNT(DISTINCT project_id) AS projectCount,
       CAST(SUM(cost) + SUM(credit) AS DOUBLE) AS totalCloudSpend FROM spent GROUP BY classification"""


def invalid_classification(spark, sf):
    return org.invalid_classification(fixtures.bad_classes_dim(_dim(spark, sf)))


_INVALID_SQL = f"""WITH {Q.BAD_CLASSES_CTE}
SELECT project_id, classification FROM project_dim
WHERE classification IS NULL OR classification NOT IN ('PROTECTED_B', 'PROTECTED_A', 'UNCLASSIFIED')"""


def project_owner(spark, sf):
    return org.project_owner(_billing(spark, sf), _dim(spark, sf))


_OWNER_SQL = f"""WITH {Q.BILLING_CTE}, {Q.DIM_CTE}
SELECT b.project_id, d.department AS owner, d.department_acronym AS owner_acronym
FROM (SELECT DISTINCT project_id FROM billing) b LEFT JOIN project_dim d ON b.project_id = d.project_id"""


def carbon_report(spark, sf):
    return carbon_ops.carbon_report(_carbon(spark, sf), AS_OF)


def org_carbon_total(spark, sf):
    return org.org_carbon_total(_carbon(spark, sf), _dim(spark, sf))


def cost_estimates(spark, sf):
    return estimates.cost_estimates(_billing(spark, sf), AS_OF)


def carbon_estimates(spark, sf):
    return estimates.carbon_estimates(_carbon(spark, sf), AS_OF)


def org_estimates(spark, sf):
    return estimates.org_estimates(_billing(spark, sf), _dim(spark, sf), AS_OF)


def _estimated(metric: str, first: dt.date, last: dt.date, alias: str = "report") -> str:
    """A to-date figure scaled from the days gone by to the days of its year."""
    days, gone = (last - first).days + 1, (AS_OF - first).days + 1
    return f"{alias}.{metric} * {days} / {gone}"


_FISCAL_ESTIMATE = _estimated("currentFiscalToDate", dt.date(2000, 4, 1), dt.date(2001, 3, 31))
_CALENDAR_ESTIMATE = _estimated("currentCalendarYearToDate", dt.date(2000, 1, 1), dt.date(2000, 12, 31))
_ESTIMATE_COLUMNS = (f"report.currentFiscalToDate, {_FISCAL_ESTIMATE} AS currentFiscalEstimated, "
                     f"report.currentCalendarYearToDate, {_CALENDAR_ESTIMATE} AS currentCalendarYearEstimated")


def _estimates_sql(source: str) -> str:
    return f"{Q.with_report(AS_OF, source=source, through_as_of=True)}\nSELECT project_id, {_ESTIMATE_COLUMNS} FROM report"


_ORG_ESTIMATES_SQL = (f"{Q.with_units(AS_OF, through_as_of=True)}\nSELECT {Q.shown('report')}, {_ESTIMATE_COLUMNS}\n"
                      f"FROM report {Q.named('report')}")


def all_projects_through_as_of(spark, sf):
    return all_projects(_billing(spark, sf), AS_OF, through_as_of=True)


def _project_details(nested: bool, with_estimates: bool):
    def build(spark, sf):
        return project_details(_billing(spark, sf), AS_OF, dim=_dim(spark, sf), carbon=_carbon(spark, sf),
                               nested=nested, estimates=with_estimates)
    return build


def _details_sql(nested: bool, with_estimates: bool) -> str:
    """Money and kilograms of every project, each with its own report."""
    day_after = AS_OF + dt.timedelta(days=1)

    guess = {"currentFiscalEstimated": _FISCAL_ESTIMATE, "currentCalendarYearEstimated": _CALENDAR_ESTIMATE}

    def estimate(name: str, table: str) -> str:
        return f"COALESCE({guess[name].replace('report.', table + '.')}, 0.0)" if with_estimates else "CAST(NULL AS DOUBLE)"

    parts = [Q.BILLING_CTE, Q.CARBON_CTE, Q.DIM_CTE, Q.periods_cte(AS_OF), Q.lines_cte(), Q.report_cte(),
             Q.lines_cte("carbon").replace("lines AS", "kg_lines AS"), Q.report_cte(lines="kg_lines", name="kg"),
             Q.lines_cte(before=day_after).replace("lines AS", "past_lines AS"),
             Q.report_cte(lines="past_lines", name="past"),
             Q.lines_cte("carbon", before=day_after).replace("lines AS", "past_kg_lines AS"),
             Q.report_cte(lines="past_kg_lines", name="past_kg")]
    join = """FROM report LEFT JOIN kg ON report.project_id = kg.project_id
LEFT JOIN past ON report.project_id = past.project_id
LEFT JOIN past_kg ON report.project_id = past_kg.project_id
LEFT JOIN project_dim d ON report.project_id = d.project_id"""
    if not nested:
        extra = [f"{estimate(n, t)} AS {p}{n}" for t, p in (("past", ""), ("past_kg", "carbon_")) for n in guess]
        return (f"WITH {','.join(parts)}\nSELECT {Q.api_columns()}, {Q.api_columns(alias='kg', prefix='carbon_', key=False)}, "
                f"{', '.join(extra)}, d.classification, d.department AS owner, d.department_acronym AS owner_acronym\n{join}")

    def struct(table: str, past: str) -> str:
        fields = [f"{m} := {_value(table, m)}" for m in Q.ALL_METRICS] + [f"{n} := {estimate(n, past)}" for n in guess]
        return f"struct_pack({', '.join(fields)})"

    return f"""WITH {','.join(parts)}
SELECT COALESCE(report.project_id, '') AS id, {struct('report', 'past')} AS costs, d.classification,
       CASE WHEN d.department IS NOT NULL THEN struct_pack(name := d.department, acronym := d.department_acronym) END AS owner,
       {struct('kg', 'past_kg')} AS carbonFootprint
{join}"""


def _value(table: str, metric: str) -> str:
    if metric == "lastSixMonths":
        return f"list_transform({table}.{metric}, lambda x: COALESCE(x, 0.0))"
    return f"COALESCE({table}.{metric}, 0.0)"


# --- stored cube and its streaming refresh ------------------------------------

#: Lines of one landing file, and the batches that all files make: a task that writes a file reads no more on larger tables.
FILE_LINES, LANDING_BATCHES = 1_000_000, 4


def _scratch_root(spark) -> str:
    """Fresh folder under the session's shared folder, deleted when Python ends."""
    root = os.path.join(ensure_checkpoint_dir(spark), f"run-{uuid.uuid4().hex}")
    atexit.register(_drop_quietly, spark, root)
    return root


def _drop_quietly(spark, root: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        drop_store(spark, root)


def _refreshed(spark, root: str, files: str, schema, files_per_batch: int = 1):
    store, checkpoint = refresh_paths(root)
    stream = billing_stream(spark, files, schema, max_files_per_trigger=files_per_batch)
    query = start_cube_refresh(fixtures.billing_from_lineitem(stream), store, checkpoint)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"cube refresh failed: {query.exception()}")
    return read_cube(spark, store).select(*_cube_keys(), as_double(F.col(S.FINAL_COST)).alias(S.FINAL_COST))


def monthly_costs_incremental(spark, sf):
    """The lineitem file read as a stream; each micro-batch appends partial sums."""
    lineitem = fixtures.read_table(spark, sf, "lineitem")
    return _refreshed(spark, _scratch_root(spark), os.path.join(sf, "lineitem*.parquet"), lineitem.schema)


def _land(lineitem: DataFrame, folder: str) -> int:
    """Write the lines as files of ``FILE_LINES`` at most on average; returns how many files make a batch.

    Lines are dealt by all their columns, so an order (or the null one) of very many lines is in several files.
    """
    per_batch = max(1, -(-lineitem.count() // (LANDING_BATCHES * FILE_LINES)))
    lineitem.repartition(LANDING_BATCHES * per_batch, *lineitem.columns).write.parquet(folder)
    return per_batch


def monthly_costs_many_files(spark, sf):
    """The same lines landing as several files, every month in each: several batches add up."""
    root = _scratch_root(spark)
    lineitem = fixtures.read_table(spark, sf, "lineitem")
    landing = os.path.join(root, "landing")
    return _refreshed(spark, root, landing, lineitem.schema, _land(lineitem, landing))


def report_from_store(spark, sf):
    cube = materialize_costs(_billing(spark, sf), os.path.join(_scratch_root(spark), "cube"))
    return api_flavour(cube_cost_report(cube, AS_OF))


def org_units_from_store(spark, sf):
    reports = spend_reports(_billing(spark, sf), AS_OF, dim=_dim(spark, sf), carbon=_carbon(spark, sf),
                            store_path=os.path.join(_scratch_root(spark), "cube"))
    return reports["org_units"]


def report_from_id_table(spark, sf):
    path = write_cube(_billing(spark, sf), os.path.join(_scratch_root(spark), "cube"))
    return api_flavour(stored_report(spark, path, AS_OF))


def report_from_running_totals(spark, sf):
    path = write_cube(_billing(spark, sf), os.path.join(_scratch_root(spark), "cube"))
    write_running_totals(spark, path)
    return api_flavour(running_report(spark, path, AS_OF))


# --- nested units, requests of several root fields, observed checks -----------

def _unit_pages(level: str, page_size: int):
    def build(spark, sf):
        return org.unit_project_pages(_billing(spark, sf), _dim(spark, sf), level, AS_OF, page_size=page_size)
    return build


def _unit_pages_sql(level: str, page_size: int) -> str:
    path = list(S.ORG_LEVELS)[:list(S.ORG_LEVELS).index(level) + 1]
    names = ", ".join(path)
    return f"""{Q.with_report(AS_OF)}, {Q.DIM_CTE},
placed AS (SELECT report.*, d.* EXCLUDE (project_id), row_number() OVER (PARTITION BY {names} ORDER BY report.project_id) AS place,
                  count(*) OVER (PARTITION BY {names}) AS n
           FROM report JOIN project_dim d ON report.project_id = d.project_id)
SELECT '{level}' AS level, {level} AS name, min(min({level}_acronym)) OVER (PARTITION BY {names}) AS acronym,
       {"department" if len(path) > 1 else "CAST(NULL AS VARCHAR)"} AS parent_department,
       {"branch" if len(path) > 2 else "CAST(NULL AS VARCHAR)"} AS parent_branch,
       CAST((place - 1) // {page_size} + 1 AS INTEGER) AS page, CAST((n - 1) // {page_size} + 1 AS INTEGER) AS pages,
       list(struct_pack(id := project_id, classification := classification, costs := {_COSTS_SQL}) ORDER BY project_id) AS projects
FROM placed GROUP BY {names}, (place - 1) // {page_size}, n"""


def department_tree(spark, sf):
    return org.department_tree(_dim(spark, sf))


_TREE_SQL = f"""WITH {Q.DIM_CTE},
low AS (SELECT department, branch, directorate, min(directorate_acronym) AS a, min(branch_acronym) AS b, min(department_acronym) AS d
        FROM project_dim GROUP BY ALL),
mid AS (SELECT department, branch, min(b) AS b, min(d) AS d,
               list(struct_pack(name := directorate, acronym := a, branch := branch, department := department) ORDER BY directorate)
                 AS directorates FROM low GROUP BY department, branch)
SELECT department AS name, min(d) AS acronym,
       list(struct_pack(name := branch, acronym := b, department := department, directorates := directorates) ORDER BY branch) AS branches,
       flatten(list(directorates ORDER BY branch)) AS directorates
FROM mid GROUP BY department"""


_REQUEST = {
    "everyone": RootField("allProjects", (S.CURRENT_MONTH,)),
    "some": RootField("projects", (S.LAST_SIX_MONTHS, S.PREVIOUS_FISCAL_YEAR), SAMPLE_IDS),
    "one": RootField("project", (S.CURRENT_FISCAL_ESTIMATED,), ONE_ID),
    "unit": RootField("department", (S.CURRENT_FISCAL_YEAR, "projectCount"), name=DEPARTMENT),
}


def report_request(spark, sf):
    """Four root fields of one request, one under the other, with the fields that each asked for."""
    found = answer(_billing(spark, sf), _REQUEST, AS_OF, _dim(spark, sf), path=os.path.join(_scratch_root(spark), "cube"))
    fields = dict.fromkeys(f for root in _REQUEST.values() for f in root.fields)
    out = None
    for alias, rows in found.items():
        id_ = F.col("name" if alias == "unit" else S.PROJECT_ID).alias("id")
        rows = rows.select(F.lit(alias).alias("alias"), id_, *_REQUEST[alias].fields)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select("alias", "id", *fields)


_REQUEST_SQL = f"""{Q.with_report(AS_OF)},
past AS (WITH lines AS (SELECT * FROM lines WHERE used < TIMESTAMP '{AS_OF + dt.timedelta(days=1)} 00:00:00'),
         {Q.report_cte(name="past_report").strip()} SELECT * FROM past_report),
{Q.DIM_CTE}, {Q.units_cte()}, {Q.report_cte(Q.UNIT, "(SELECT * FROM unit_lines)", "unit_report")}
SELECT 'everyone' AS alias, COALESCE(project_id, '') AS id, COALESCE(currentMonthToDate, 0.0) AS currentMonthToDate,
       CAST(NULL AS DOUBLE[]) AS lastSixMonths, CAST(NULL AS DOUBLE) AS previousFiscalYear,
       CAST(NULL AS DOUBLE) AS currentFiscalEstimated, CAST(NULL AS DOUBLE) AS currentFiscalToDate, CAST(NULL AS BIGINT) AS projectCount
FROM report
UNION ALL SELECT 'some', project_id, NULL, list_transform(lastSixMonths, lambda x: COALESCE(x, 0.0)),
       COALESCE(previousFiscalYear, 0.0), NULL, NULL, NULL FROM report WHERE project_id IN ({_IDS_SQL})
UNION ALL SELECT 'one', project_id, NULL, NULL, NULL, COALESCE({_estimated("currentFiscalToDate", dt.date(2000, 4, 1),
       dt.date(2001, 3, 31), "past")}, 0.0), NULL, NULL FROM past WHERE project_id = '{ONE_ID}'
UNION ALL SELECT 'unit', u.department, NULL, NULL, NULL, NULL, u.currentFiscalToDate,
       (SELECT COUNT(DISTINCT project_id) FROM lines WHERE project_id IN (SELECT project_id FROM project_dim
        WHERE department = '{DEPARTMENT}'))
FROM unit_report u WHERE u.level = 'department' AND u.department = '{DEPARTMENT}'"""


def observed_checks(spark, sf):
    """The checks taken while the whole report ran, over a dimension with bad classes and a project of each ten listed twice."""
    dim = fixtures.bad_classes_dim(_dim(spark, sf))
    number = F.col(S.PROJECT_ID).cast("long")
    dim = dim.where(number % 10 != 3).unionByName(dim.where(number % 10 == 4))
    report, checks = checked_report(_billing(spark, sf), dim, AS_OF)
    report.write.format("noop").mode("overwrite").save()
    found = checks.metrics()
    return spark.createDataFrame([tuple(found[c] for c in CHECKS)],
                                 "invalid_classifications long, duplicate_projects long, null_project_spend double, "
                                 "projects_without_dimension long")


_CHECKS_SQL = f"""WITH {Q.BILLING_CTE}, {Q.BAD_CLASSES_CTE},
dim AS (SELECT * FROM project_dim WHERE CAST(project_id AS BIGINT) % 10 <> 3
        UNION ALL SELECT * FROM project_dim WHERE CAST(project_id AS BIGINT) % 10 = 4)
SELECT (SELECT COUNT(*) FROM dim WHERE classification IS NULL
        OR classification NOT IN ('PROTECTED_B', 'PROTECTED_A', 'UNCLASSIFIED')) AS invalid_classifications,
       (SELECT COUNT(*) FROM (SELECT project_id FROM dim GROUP BY project_id HAVING COUNT(*) > 1)) AS duplicate_projects,
       (SELECT CAST(SUM(cost) + SUM(credits_sum_amount) AS DOUBLE) FROM billing WHERE project_id IS NULL) AS null_project_spend,
       (SELECT COUNT(DISTINCT project_id) FROM billing WHERE project_id IS NOT NULL
        AND project_id NOT IN (SELECT project_id FROM dim)) AS projects_without_dimension"""


# --- registry ----------------------------------------------------------------

REGISTRY: dict[str, Query] = {
    "billing_scan": Query(billing_scan, f"WITH {Q.BILLING_CTE}\n{_BILLING_ROWS_SQL}", "S1 M6"),
    "billing_for_projects": Query(
        billing_for_projects, f"WITH {Q.BILLING_CTE}\n{_BILLING_ROWS_SQL} WHERE project_id IN ({_IDS_SQL})", "S2 S3"),
    "project_ids": Query(project_ids_query, f"WITH {Q.BILLING_CTE},{Q.cube_cte()}\nSELECT project_id FROM monthly "
                                            "GROUP BY project_id", "M7"),
    "monthly_cube": Query(monthly_cube, _cube_sql(
        "CAST(final_cost_no_credits AS DOUBLE) AS final_cost_no_credits, "
        "CAST(total_credits_computed1 AS DOUBLE) AS total_credits_computed1, "
        "CAST(total_credits_computed2 AS DOUBLE) AS total_credits_computed2, "
        "CAST(final_cost_0 AS DOUBLE) AS final_cost_0, CAST(final_cost AS DOUBLE) AS final_cost"), "M0-M5"),
    "monthly_costs": Query(_cube_measure(S.FINAL_COST), _cube_sql("CAST(final_cost AS DOUBLE) AS final_cost"),
                           "M0 M5"),
    "monthly_cost_no_credits": Query(
        _cube_measure(S.FINAL_COST_NO_CREDITS),
        _cube_sql("CAST(final_cost_no_credits AS DOUBLE) AS final_cost_no_credits"), "M1"),
    "monthly_first_credit": Query(
        _cube_measure(S.FIRST_CREDIT_TOTAL),
        _cube_sql("CAST(total_credits_computed1 AS DOUBLE) AS total_credits_computed1"), "M2"),
    "monthly_all_credits": Query(
        _cube_measure(S.ALL_CREDITS_TOTAL),
        _cube_sql("CAST(total_credits_computed2 AS DOUBLE) AS total_credits_computed2"), "M3"),
    "monthly_final_cost_first_credit": Query(
        _cube_measure(S.FINAL_COST_FIRST_CREDIT), _cube_sql("CAST(final_cost_0 AS DOUBLE) AS final_cost_0"), "M4"),
    "monthly_long_credits": Query(monthly_long_credits, _LONG_CREDITS_SQL, "M2 M3 M6"),
    "fiscal_calendar": Query(fiscal_calendar, _FISCAL_SQL, "C0 C1"),
    "current_month": Query(_period("current_month", S.CURRENT_MONTH), Q.period_sql(AS_OF, "month", S.CURRENT_MONTH), "P1"),
    "previous_month": Query(_period("previous_month", S.PREVIOUS_MONTH),
                            Q.period_sql(AS_OF, "month before", S.PREVIOUS_MONTH), "P2"),
    "last_six_months": Query(last_six_months, _LSM_EXPLODED_SQL, "P3"),
    "last_six_months_array": Query(_report_cols(S.LAST_SIX_MONTHS), _report_cols_sql(S.LAST_SIX_MONTHS), "P3"),
    "current_calendar_year": Query(_period("current_calendar_year", S.CURRENT_CALENDAR_YEAR),
                                   Q.period_sql(AS_OF, "year", S.CURRENT_CALENDAR_YEAR), "P4"),
    "previous_calendar_year": Query(_period("previous_calendar_year", S.PREVIOUS_CALENDAR_YEAR),
                                    Q.period_sql(AS_OF, "year before", S.PREVIOUS_CALENDAR_YEAR), "P5"),
    "current_fiscal_year": Query(_period("current_fiscal_year", S.CURRENT_FISCAL_YEAR),
                                 Q.period_sql(AS_OF, "fiscal", S.CURRENT_FISCAL_YEAR), "P6"),
    "previous_fiscal_year": Query(_period("previous_fiscal_year", S.PREVIOUS_FISCAL_YEAR),
                                  Q.period_sql(AS_OF, "fiscal before", S.PREVIOUS_FISCAL_YEAR), "P7"),
    "month_delta_pct": Query(_report_cols(S.CURRENT_MONTH, S.PREVIOUS_MONTH, S.MONTH_DELTA),
                             _report_cols_sql(S.CURRENT_MONTH, S.PREVIOUS_MONTH, S.MONTH_DELTA), "P8"),
    "fiscal_delta_pct": Query(_report_cols(S.CURRENT_FISCAL_YEAR, S.PREVIOUS_FISCAL_YEAR, S.FISCAL_DELTA),
                              _report_cols_sql(S.CURRENT_FISCAL_YEAR, S.PREVIOUS_FISCAL_YEAR, S.FISCAL_DELTA), "P9"),
    "project_cost_report": Query(report_raw, Q.report_sql(AS_OF, flavour="raw"), "R1"),
    "project_cost_report_single_pass": Query(report_single_pass, Q.report_sql(AS_OF, flavour="raw"), "R1"),
    "all_projects": Query(_all_projects_on(AS_OF), Q.report_sql(AS_OF), "E1 S5"),
    "all_projects_api": Query(_all_projects_on(AS_OF), Q.report_sql(AS_OF), "S5"),
    "projects_by_ids": Query(projects_by_ids, Q.report_sql(AS_OF, ids=SAMPLE_IDS), "E2 S2"),
    "projects_by_ids_sql": Query(projects_by_ids_sql, Q.report_sql(AS_OF, ids=SAMPLE_IDS), "E2 S3 SQL"),
    "projects_by_id_table": Query(projects_by_id_table, _ID_TABLE_SQL, "E2 S2"),
    "project_by_id": Query(project_by_id, Q.report_sql(AS_OF, ids=[ONE_ID]), "E3"),
    "project_records": Query(project_records_query, _RECORDS_SQL, "S4"),
    "report_projection": Query(
        report_projection, f"{Q.with_report(AS_OF)}\nSELECT {Q.api_columns(PROJECTION)} FROM report", "S6"),
    "department_report": Query(_unit_query(org.department, DEPARTMENT), _unit_sql("department", DEPARTMENT), "D1"),
    "branch_report": Query(_unit_query(org.branch, BRANCH), _unit_sql("branch", BRANCH), "D2"),
    "directorate_report": Query(_unit_query(org.directorate, DIRECTORATE),
                                _unit_sql("directorate", DIRECTORATE), "D3"),
    "org_unit_costs": Query(org_unit_costs, Q.unit_report_sql(AS_OF), "D4"),
    "org_units_shared_names": Query(org_units_shared_names, Q.unit_totals_sql(AS_OF, Q.SHARED_DIM_CTE), "D1-D5 D12"),
    "org_project_count": Query(
        org_project_count, Q.unit_sums_sql("COUNT(DISTINCT s.project_id)", "lines", "projectCount"), "D5"),
    "org_spend_rollup": Query(org_spend_rollup, _ROLLUP_SQL, "D6"),
    "org_projects": Query(org_projects, _org_projects_sql(), "D7"),
    "department_projects": Query(_unit_projects("department", DEPARTMENT),
                                 _org_projects_sql(f"d.department = '{DEPARTMENT}'"), "D7"),
    "branch_projects": Query(_unit_projects("branch", BRANCH), _org_projects_sql(f"d.branch = '{BRANCH}'"), "D7"),
    "directorate_projects": Query(_unit_projects("directorate", DIRECTORATE),
                                  _org_projects_sql(f"d.directorate = '{DIRECTORATE}'"), "D7"),
    "org_hierarchy": Query(org_hierarchy, _HIERARCHY_SQL, "D8"),
    "department_directorates": Query(_children("department", DEPARTMENT, "directorate"),
                                     f"{_BELOW_DEPARTMENT} department = '{DEPARTMENT}'", "D8"),
    "branch_directorates": Query(_children("branch", BRANCH, "directorate"),
                                 f"{_BELOW_DEPARTMENT} branch = '{BRANCH}'", "D8"),
    "classification_spend": Query(classification_spend, _CLASSIFICATION_SQL, "D9"),
    "invalid_classification": Query(invalid_classification, _INVALID_SQL, "D9"),
    "project_owner": Query(project_owner, _OWNER_SQL, "D10"),
    "carbon_report": Query(carbon_report, Q.report_sql(AS_OF, flavour="raw", source="carbon"), "D11"),
    "org_carbon_total": Query(
        org_carbon_total, Q.unit_sums_sql("CAST(SUM(carbon_kg) AS DOUBLE)", "carbon", "carbonFootprint"), "D12"),
    "cost_estimates": Query(cost_estimates, _estimates_sql("billing"), "D13"),
    "carbon_estimates": Query(carbon_estimates, _estimates_sql("carbon"), "D13"),
    "org_estimates": Query(org_estimates, _ORG_ESTIMATES_SQL, "D13"),
    "monthly_costs_incremental": Query(
        monthly_costs_incremental, _cube_sql("CAST(final_cost AS DOUBLE) AS final_cost"), "M0 streaming"),
    "monthly_costs_many_files": Query(
        monthly_costs_many_files, _cube_sql("CAST(final_cost AS DOUBLE) AS final_cost"), "M0 streaming"),
    "all_projects_from_store": Query(report_from_store, Q.report_sql(AS_OF), "E1 stored cube"),
    "all_projects_through_as_of": Query(all_projects_through_as_of, Q.report_sql(AS_OF, through_as_of=True),
                                        "E1 G9"),
    "project_details": Query(_project_details(False, False), _details_sql(False, False), "S4 D9 D10 D11"),
    "project_details_nested": Query(_project_details(True, True), _details_sql(True, True), "S4 D9 D10 D11 D13"),
    "all_projects_from_id_table": Query(report_from_id_table, Q.report_sql(AS_OF), "M7 stored cube"),
    "all_projects_from_running_totals": Query(report_from_running_totals, Q.report_sql(AS_OF), "P1-P9 stored cube"),
    "directorate_projects_nested": Query(_unit_pages("directorate", org.PAGE_PROJECTS),
                                         _unit_pages_sql("directorate", org.PAGE_PROJECTS), "D7"),
    "department_projects_nested": Query(_unit_pages("department", 7), _unit_pages_sql("department", 7), "D7"),
    "department_tree": Query(department_tree, _TREE_SQL, "D8"),
    "report_request": Query(report_request, _REQUEST_SQL, "S6 E1-E3 D1"),
    "observed_checks": Query(observed_checks, _CHECKS_SQL, "D9 G3"),
    "org_unit_costs_from_store": Query(org_units_from_store, Q.unit_totals_sql(AS_OF), "D4 stored cube"),
}

for _name, _day in OTHER_DATES.items():
    REGISTRY[f"all_projects_{_name}"] = Query(_all_projects_on(_day), Q.report_sql(_day), "E1 G-rules")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.build for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}
