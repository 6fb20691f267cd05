"""spendlens: cloud-spend reports as Spark DataFrame operators.

Start with ``spendlens.all_projects(billing_df, as_of)``; see README.md.
"""

from spendlens.functions.calendar import ReportCalendar
from spendlens.operators.monthly import final_cost_cube, monthly_carbon, monthly_costs, project_ids
from spendlens.operators.periods import period_report, period_total
from spendlens.operators.project_details import project_details
from spendlens.operators.report import (
    all_projects,
    api_flavour,
    cube_cost_report,
    project,
    project_cost_report,
    project_records,
    projects,
    select_fields,
)
from spendlens.operators.suite import spend_reports
from spendlens.plans.views import projects_sql, register_views
from spendlens.sources.billing import declare_date_partition, filter_projects, load_billing, read_billing

__all__ = [
    "ReportCalendar",
    "all_projects",
    "api_flavour",
    "cube_cost_report",
    "declare_date_partition",
    "filter_projects",
    "final_cost_cube",
    "load_billing",
    "monthly_carbon",
    "monthly_costs",
    "period_report",
    "period_total",
    "project",
    "project_cost_report",
    "project_details",
    "project_ids",
    "project_records",
    "projects",
    "projects_sql",
    "read_billing",
    "register_views",
    "select_fields",
    "spend_reports",
]
