"""DuckDB SQL oracles for the registered queries.

The report is computed from the usage lines, not from a monthly cube: a table
``periods(period, lo, hi)`` of half-open time ranges is joined to the lines by
range, one grouped sum gives each (key, period), and a pivot lays the periods
out as columns.  The bounds come from SQL date arithmetic on the report date,
the fiscal year from the last April 1 on or before it.  Lines of the null
project are left out before the sums and the project is put back, without
figures, by the key list.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

# Billing lines from lineitem (the fixture mapping), DuckDB spelling; credits as a list.
BILLING_CTE = """
billing_src AS (
  SELECT l_shipdate AS usage_start_time,
         NULLIF(CAST(l_suppkey AS VARCHAR), '0') AS project_id,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS cost,
         l_returnflag AS flag, l_linenumber,
         CAST(-(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS c_discount,
         CAST(-(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS c_promo
  FROM lineitem
),
billing_credits AS (
  SELECT usage_start_time, project_id, cost,
         CASE WHEN flag = 'A' THEN [c_discount] WHEN flag = 'R' THEN [c_discount, c_promo]
              ELSE CAST([] AS DECIMAL(18,4)[]) END AS credits
  FROM billing_src
),
billing AS (
  SELECT *, len(credits) AS n_credits,
         CASE WHEN len(credits) > 0 THEN credits[1] ELSE CAST(0 AS DECIMAL(18,4)) END AS first_credit,
         COALESCE(list_sum(credits), 0) AS credits_sum_amount
  FROM billing_credits
)"""

# The same lines with as many credits as the line number says, growing multiples of the discount.
LONG_CREDITS_CTE = BILLING_CTE.replace(
    """CASE WHEN flag = 'A' THEN [c_discount] WHEN flag = 'R' THEN [c_discount, c_promo]
              ELSE CAST([] AS DECIMAL(18,4)[]) END AS credits""",
    "list_transform(range(1, l_linenumber + 1), lambda i: CAST(c_discount * i AS DECIMAL(18,4))) AS credits")

CARBON_CTE = """
carbon AS (
  SELECT l_shipdate AS usage_start_time,
         NULLIF(CAST(l_suppkey AS VARCHAR), '0') AS project_id,
         CAST(l_quantity AS DECIMAL(12,2)) AS carbon_kg
  FROM lineitem
)"""

DIM_CTE = """
project_dim AS (
  SELECT CAST(s.s_suppkey AS VARCHAR) AS project_id,
         CASE WHEN s.s_acctbal < 3333 THEN 'UNCLASSIFIED'
              WHEN s.s_acctbal < 6666 THEN 'PROTECTED_A'
              ELSE 'PROTECTED_B' END AS classification,
         r.r_name AS department,
         upper(substr(r.r_name, 1, 3)) AS department_acronym,
         n.n_name AS branch,
         upper(substr(n.n_name, 1, 3)) AS branch_acronym,
         n.n_name || '-' || CAST(s.s_suppkey % 3 AS VARCHAR) AS directorate,
         upper(substr(n.n_name, 1, 3)) || CAST(s.s_suppkey % 3 AS VARCHAR) AS directorate_acronym
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


# The dimension with directorate names that several branches share.
SHARED_DIM_CTE = DIM_CTE.replace("n.n_name || '-' || CAST(s.s_suppkey % 3 AS VARCHAR) AS directorate,",
                                 "'DIR-' || CAST(s.s_suppkey % 3 AS VARCHAR) AS directorate,")
# The dimension with classifications outside the domain, and null ones.
BAD_CLASSES_CTE = DIM_CTE.replace("CASE WHEN s.s_acctbal < 3333",
                                  "CASE WHEN s.s_suppkey % 10 = 0 THEN 'SECRET' WHEN s.s_suppkey % 10 = 1 THEN NULL "
                                  "WHEN s.s_acctbal < 3333")

METRICS = (
    "currentMonthToDate",
    "previousMonth",
    "currentMonthDeltaPercentage",
    "currentCalendarYearToDate",
    "previousCalendarYear",
    "currentFiscalToDate",
    "previousFiscalYear",
    "currentFiscalYearDeltaPercentage",
)
ALL_METRICS = (*METRICS, "lastSixMonths")

# What identifies a unit.
UNIT = ("level", "department", "branch", "directorate")


def _quoted(ids: Sequence[str]) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in ids)


def periods_cte(as_of: dt.date) -> str:
    """The report's periods as half-open ranges of time."""
    return f"""
clock AS (
  SELECT day, date_trunc('month', day) AS m0, date_trunc('year', day) AS y0,
         (SELECT max(april) FROM (SELECT make_date(CAST(y AS INTEGER), 4, 1) AS april
                                  FROM range(year(day) - 1, year(day) + 1) AS years(y)) WHERE april <= day) AS f0
  FROM (SELECT DATE '{as_of.isoformat()}' AS day)
),
periods AS (
  SELECT 'month' AS period, m0 AS lo, m0 + INTERVAL 1 MONTH AS hi FROM clock
  UNION ALL SELECT 'month before', m0 - INTERVAL 1 MONTH, m0 FROM clock
  UNION ALL SELECT 'year', y0, y0 + INTERVAL 1 YEAR FROM clock
  UNION ALL SELECT 'year before', y0 - INTERVAL 1 YEAR, y0 FROM clock
  UNION ALL SELECT 'fiscal', f0, f0 + INTERVAL 1 YEAR FROM clock
  UNION ALL SELECT 'fiscal before', f0 - INTERVAL 1 YEAR, f0 FROM clock
  UNION ALL SELECT 'back ' || n, m0 - n * INTERVAL 1 MONTH, m0 - (n - 1) * INTERVAL 1 MONTH FROM clock, range(1, 7) AS t(n)
)"""


def lines_cte(source: str = "billing", ids: Sequence[str] | None = None, before: dt.date | None = None) -> str:
    """Usage lines as (project_id, used, cost, credit); kilograms count as cost without credit."""
    money = "carbon_kg AS cost, 0 AS credit" if source == "carbon" else "cost, credits_sum_amount AS credit"
    tests = []
    if ids is not None:
        tests.append(f"project_id IN ({_quoted(ids)})" if ids else "FALSE")
    if before is not None:
        tests.append(f"usage_start_time < TIMESTAMP '{before.isoformat()} 00:00:00'")
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    return f"\nlines AS (SELECT project_id, usage_start_time AS used, {money} FROM {source}{where})"


def units_cte() -> str:
    """Each project's units: one row per level, with the path down to it."""
    return """
units AS (
  SELECT project_id, 'department' AS level, department, NULL AS branch, NULL AS directorate,
         department_acronym AS acronym FROM project_dim
  UNION ALL SELECT project_id, 'branch', department, branch, NULL, branch_acronym FROM project_dim
  UNION ALL SELECT project_id, 'directorate', department, branch, directorate, directorate_acronym FROM project_dim
),
unit_names AS (SELECT level, department, branch, directorate, min(acronym) AS acronym FROM units GROUP BY ALL),
unit_lines AS (SELECT u.* EXCLUDE (project_id, acronym), l.* FROM lines l JOIN units u ON l.project_id = u.project_id)"""


def report_cte(keys: Sequence[str] = ("project_id",), lines: str = "lines", name: str = "report") -> str:
    """The nine figures of every key that has a line at any time."""
    k = ", ".join(keys)
    same = " AND ".join(f"everyone.{x} IS NOT DISTINCT FROM pivoted.{x}" for x in keys)

    def at(period: str) -> str:
        return f"max(amount) FILTER (WHERE period = '{period}')"

    def change(now: str, then: str) -> str:
        return f"(CAST({now} AS DOUBLE) - CAST({then} AS DOUBLE)) / NULLIF(CAST({then} AS DOUBLE), 0) * 100"

    return f"""
{name} AS (
  WITH sums AS (
    SELECT {k}, period, SUM(cost) + SUM(credit) AS amount
    FROM {lines} JOIN periods ON used >= lo AND used < hi
    WHERE project_id IS NOT NULL GROUP BY {k}, period
  ),
  pivoted AS (
    SELECT {k}, {at("month")} AS m1, {at("month before")} AS m2, {at("year")} AS y1, {at("year before")} AS y2,
           {at("fiscal")} AS f1, {at("fiscal before")} AS f2,
           list(CAST(amount AS DOUBLE) ORDER BY period) FILTER (WHERE starts_with(period, 'back')) AS months
    FROM sums GROUP BY {k}
  ),
  everyone AS (SELECT DISTINCT {k} FROM {lines})
  SELECT everyone.*, CAST(m1 AS DOUBLE) AS currentMonthToDate, CAST(m2 AS DOUBLE) AS previousMonth,
         {change("m1", "m2")} AS currentMonthDeltaPercentage,
         CAST(y1 AS DOUBLE) AS currentCalendarYearToDate, CAST(y2 AS DOUBLE) AS previousCalendarYear,
         CAST(f1 AS DOUBLE) AS currentFiscalToDate, CAST(f2 AS DOUBLE) AS previousFiscalYear,
         {change("f1", "f2")} AS currentFiscalYearDeltaPercentage, months AS lastSixMonths
  FROM everyone LEFT JOIN pivoted ON {same}
)"""


def cube_cte() -> str:
    """The monthly cube's measures per (month, project)."""
    return """
monthly AS (
  SELECT CAST(date_trunc('month', usage_start_time) AS DATE) AS month,
         CAST(EXTRACT(year FROM usage_start_time) AS INTEGER) AS year, project_id,
         SUM(cost) AS final_cost_no_credits,
         SUM(first_credit) AS total_credits_computed1,
         SUM(COALESCE(list_sum(credits), 0)) AS total_credits_computed2,
         SUM(cost) + SUM(first_credit) AS final_cost_0,
         SUM(cost) + SUM(credits_sum_amount) AS final_cost
  FROM billing GROUP BY ALL
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def with_report(as_of: dt.date, ids: Sequence[str] | None = None, source: str = "billing",
                through_as_of: bool = False) -> str:
    """``WITH`` clause ending in the ``report`` CTE (raw flavour)."""
    before = as_of + dt.timedelta(days=1) if through_as_of else None
    return _with(CARBON_CTE if source == "carbon" else BILLING_CTE, periods_cte(as_of), lines_cte(source, ids, before),
                 report_cte())


def api_columns(metrics: Sequence[str] = ALL_METRICS, alias: str = "report", prefix: str = "", key: bool = True) -> str:
    cols = [f"COALESCE({alias}.project_id, '') AS project_id"] if key else []
    for m in metrics:
        value = (f"list_transform({alias}.{m}, lambda x: COALESCE(x, 0.0))" if m == "lastSixMonths"
                 else f"COALESCE({alias}.{m}, 0.0)")
        cols.append(f"{value} AS {prefix}{m}")
    return ", ".join(cols)


def raw_columns(metrics: Sequence[str] = ALL_METRICS, alias: str = "report") -> str:
    return ", ".join([f"{alias}.project_id"] + [f"{alias}.{m}" for m in metrics])


def report_sql(as_of: dt.date, ids: Sequence[str] | None = None, flavour: str = "api",
               metrics: Sequence[str] = ALL_METRICS, source: str = "billing", through_as_of: bool = False) -> str:
    cols = api_columns(metrics) if flavour == "api" else raw_columns(metrics)
    return f"{with_report(as_of, ids, source, through_as_of)}\nSELECT {cols} FROM report"


def period_sql(as_of: dt.date, period: str, name: str) -> str:
    """One period per project, the null project's own total included."""
    return (f"{_with(BILLING_CTE, periods_cte(as_of), lines_cte())}\n"
            f"SELECT project_id, CAST(SUM(cost) + SUM(credit) AS DOUBLE) AS {name} FROM lines "
            f"JOIN periods ON used >= lo AND used < hi WHERE period = '{period}' GROUP BY project_id")


def with_units(as_of: dt.date, dim: str = DIM_CTE, through_as_of: bool = False) -> str:
    """``WITH`` clause ending in the ``report`` of every unit, ``unit_names`` and ``unit_lines``."""
    before = as_of + dt.timedelta(days=1) if through_as_of else None
    return _with(BILLING_CTE, dim, periods_cte(as_of), lines_cte(before=before), units_cte(),
                 report_cte(UNIT, "(SELECT * FROM unit_lines)"))


def named(table: str) -> str:
    same = " AND ".join(f"n.{k} IS NOT DISTINCT FROM {table}.{k}" for k in UNIT)
    return f"JOIN unit_names n ON {same}"


def shown(table: str) -> str:
    """Unit columns of a table keyed by the path, joined with ``unit_names n``."""
    return f"""{table}.level, COALESCE({table}.directorate, {table}.branch, {table}.department) AS name, n.acronym,
       CASE WHEN {table}.level <> 'department' THEN {table}.department END AS parent_department,
       CASE WHEN {table}.level = 'directorate' THEN {table}.branch END AS parent_branch"""


def unit_report_sql(as_of: dt.date, dim: str = DIM_CTE) -> str:
    return (f"{with_units(as_of, dim)}\nSELECT {shown('report')}, {', '.join('report.' + m for m in ALL_METRICS)}\n"
            f"FROM report {named('report')}")


def unit_totals_sql(as_of: dt.date, dim: str = DIM_CTE, where: str = "TRUE") -> str:
    """Whole unit records: report, project count, all-history spend and kilograms."""
    k = ", ".join(UNIT)
    same = lambda t: " AND ".join(f"report.{x} IS NOT DISTINCT FROM {t}.{x}" for x in UNIT)
    return f"""{with_units(as_of, dim)}, {CARBON_CTE},
totals AS (SELECT {k}, COUNT(DISTINCT project_id) AS projectCount,
                  CAST(SUM(cost) + SUM(credit) AS DOUBLE) AS totalCloudSpend FROM unit_lines GROUP BY {k}),
kilograms AS (SELECT {k}, CAST(SUM(carbon_kg) AS DOUBLE) AS carbonFootprint
              FROM carbon c JOIN units u ON c.project_id = u.project_id GROUP BY {k})
SELECT {shown('report')}, {', '.join('report.' + m for m in ALL_METRICS)}, projectCount, totalCloudSpend, carbonFootprint
FROM report {named('report')} JOIN totals ON {same('totals')} LEFT JOIN kilograms ON {same('kilograms')}
WHERE {where}"""


def unit_sums_sql(figure: str, source: str, name: str) -> str:
    """One figure per unit over the projects of ``source``."""
    path = ", ".join("u." + x for x in UNIT)
    return f"""{_with(BILLING_CTE, CARBON_CTE, DIM_CTE, lines_cte(), units_cte())},
sums AS (SELECT {path}, {figure} AS {name} FROM {source} s JOIN units u ON s.project_id = u.project_id GROUP BY {path})
SELECT {shown('sums')}, {name} FROM sums {named('sums')}"""
