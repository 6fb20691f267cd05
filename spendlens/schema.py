"""Column names and schemas shared by every operator.

Fixed values: the report column names below must equal the original API's
field names so that a user can switch without renaming anything.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values (report field names of the original API, in its output order).
PROJECT_ID = "project_id"
CURRENT_MONTH = "currentMonthToDate"
PREVIOUS_MONTH = "previousMonth"
MONTH_DELTA = "currentMonthDeltaPercentage"
CURRENT_CALENDAR_YEAR = "currentCalendarYearToDate"
PREVIOUS_CALENDAR_YEAR = "previousCalendarYear"
CURRENT_FISCAL_YEAR = "currentFiscalToDate"
PREVIOUS_FISCAL_YEAR = "previousFiscalYear"
FISCAL_DELTA = "currentFiscalYearDeltaPercentage"
LAST_SIX_MONTHS = "lastSixMonths"
# Declared by the original API, never computed there (see operators.estimates).
CURRENT_FISCAL_ESTIMATED = "currentFiscalEstimated"
CURRENT_CALENDAR_ESTIMATED = "currentCalendarYearEstimated"

# Scalar metrics of one report row, in output order.
REPORT_METRICS = (
    CURRENT_MONTH,
    PREVIOUS_MONTH,
    MONTH_DELTA,
    CURRENT_CALENDAR_YEAR,
    PREVIOUS_CALENDAR_YEAR,
    CURRENT_FISCAL_YEAR,
    PREVIOUS_FISCAL_YEAR,
    FISCAL_DELTA,
)
REPORT_FIELDS = REPORT_METRICS + (LAST_SIX_MONTHS,)

# Billing export columns (one row per usage line).
USAGE_START_TIME = "usage_start_time"
PROJECT = "project"
COST = "cost"
CREDITS = "credits"
CREDITS_SUM_AMOUNT = "credits_sum_amount"

# Monthly cube columns, named as in the original query's monthly
# CTE (month, year, and its five cost measures).
MONTH = "month"
YEAR = "year"
FINAL_COST_NO_CREDITS = "final_cost_no_credits"
FIRST_CREDIT_TOTAL = "total_credits_computed1"
ALL_CREDITS_TOTAL = "total_credits_computed2"
FINAL_COST_FIRST_CREDIT = "final_cost_0"
FINAL_COST = "final_cost"

# Carbon input.
CARBON_KG = "carbon_kg"

# The classification domain declared by the original API.
CLASSIFICATIONS = ("PROTECTED_B", "PROTECTED_A", "UNCLASSIFIED")

# Organisational levels: level name -> (name column, acronym column), top down.
ORG_LEVELS = {
    "department": ("department", "department_acronym"),
    "branch": ("branch", "branch_acronym"),
    "directorate": ("directorate", "directorate_acronym"),
}

CREDIT_TYPE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("amount", T.DoubleType()),
    ]
)

BILLING_SCHEMA = T.StructType(
    [
        T.StructField(USAGE_START_TIME, T.TimestampType()),
        T.StructField(PROJECT, T.StructType([T.StructField("id", T.StringType())])),
        T.StructField(COST, T.DoubleType()),
        T.StructField(CREDITS, T.ArrayType(CREDIT_TYPE)),
        T.StructField(CREDITS_SUM_AMOUNT, T.DoubleType()),
    ]
)

CARBON_SCHEMA = T.StructType(
    [
        T.StructField(USAGE_START_TIME, T.TimestampType()),
        T.StructField(PROJECT, T.StructType([T.StructField("id", T.StringType())])),
        T.StructField(CARBON_KG, T.DoubleType()),
    ]
)

PROJECT_DIM_SCHEMA = T.StructType(
    [T.StructField(PROJECT_ID, T.StringType()), T.StructField("classification", T.StringType())]
    + [T.StructField(c, T.StringType()) for pair in ORG_LEVELS.values() for c in pair]
)

REPORT_SCHEMA = T.StructType(
    [T.StructField(PROJECT_ID, T.StringType())]
    + [T.StructField(m, T.DoubleType()) for m in REPORT_METRICS]
    + [T.StructField(LAST_SIX_MONTHS, T.ArrayType(T.DoubleType()))]
)
