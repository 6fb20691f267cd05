"""Monthly cube: one row per (month, project) with every credit treatment.

Plan shape: scan -> partial HashAggregate -> Exchange(month, project_id) ->
final HashAggregate.  The map-side partial aggregation means only one row per
(month, project) per task crosses the network, so a project holding a third
of all usage lines costs no more shuffle than any other; the exchange is on
(month, project_id), which spreads even a hot project over its months.

Sums are taken in the input's own type (exact DECIMAL on the fixtures) and
added after aggregation: ``final_cost = SUM(cost) + SUM(credits_sum_amount)``,
so a month whose credit sums are all null has a null final cost.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import schema as S
from spendlens.functions.calendar import month_of
from spendlens.functions.measures import credit_amount_type, credit_total, exact_sum, first_credit_amount
from spendlens.sources.billing import load_billing, project_id_col, usage_date

_NEXT_LEVEL = "_sum_credits_sum_amount"


#: Suffix of a cube's column that counts usage up to the report date only.
TO_DATE = "_to_date"


def monthly_sums(df: DataFrame, sums: dict[str, Column], key: Column | None = None, month: Column | None = None) -> DataFrame:
    """Group usage lines by (month, key) and sum the given row expressions.

    Generic form behind the cost and the carbon cubes.  ``key`` defaults to
    ``project.id`` and comes out as ``project_id``, ``month`` to the usage month.
    """
    key = project_id_col() if key is None else key
    month = (month_of(usage_date(df)) if month is None else month).alias(S.MONTH)
    # Row expressions first: what has no generated code (a fold over credits) then stays out of the aggregates.
    rows = df.select(month, key.alias(S.PROJECT_ID), *[expr.alias(name) for name, expr in sums.items()])
    out = rows.groupBy(S.MONTH, S.PROJECT_ID).agg(*[F.sum(name).alias(name) for name in sums])
    return out.select(S.MONTH, F.year(S.MONTH).alias(S.YEAR), S.PROJECT_ID, *sums.keys())


# Additive partial sums of the cost cube: summing them again over any split of
# the usage lines (files, micro-batches) gives the same cube, nulls included.
PARTIAL_SUMS = (S.FINAL_COST_NO_CREDITS, S.FIRST_CREDIT_TOTAL, S.ALL_CREDITS_TOTAL, _NEXT_LEVEL)


def monthly_cost_partials(billing: DataFrame) -> DataFrame:
    """(month, project_id) + the four additive sums behind every cost measure."""
    billing = load_billing(billing)
    sums = {S.FINAL_COST_NO_CREDITS: F.col(S.COST)}
    if S.CREDITS in billing.columns:
        amount_type = credit_amount_type(billing)
        sums[S.FIRST_CREDIT_TOTAL] = first_credit_amount(amount_type)
        sums[S.ALL_CREDITS_TOTAL] = credit_total(amount_type)
    else:
        sums[S.FIRST_CREDIT_TOTAL] = F.lit(None).cast(billing.schema[S.COST].dataType)
        sums[S.ALL_CREDITS_TOTAL] = F.lit(None).cast(billing.schema[S.COST].dataType)
    sums[_NEXT_LEVEL] = F.col(S.CREDITS_SUM_AMOUNT)
    return monthly_sums(billing, sums).drop(S.YEAR)


def combine_cost_partials(partials: DataFrame) -> DataFrame:
    """Sum partial rows that share (month, project_id) (e.g. from several batches)."""
    keys = [c for c in (S.YEAR, S.MONTH, S.PROJECT_ID) if c in partials.columns]  # a stored year is a partition
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in PARTIAL_SUMS])


def finish_costs(partials: DataFrame) -> DataFrame:
    """Partial sums (one row per month and project) -> the five cube measures."""
    no_credits, first = F.col(S.FINAL_COST_NO_CREDITS), F.col(S.FIRST_CREDIT_TOTAL)
    kind = {f.name: f.dataType for f in partials.schema.fields}

    def plus(name: str) -> Column:
        return exact_sum(no_credits, F.col(name), kind[S.FINAL_COST_NO_CREDITS], kind[name])

    return partials.select(
        S.MONTH,
        F.col(S.YEAR) if S.YEAR in partials.columns else F.year(S.MONTH).alias(S.YEAR),
        S.PROJECT_ID,
        no_credits,
        first,
        F.col(S.ALL_CREDITS_TOTAL),
        plus(S.FIRST_CREDIT_TOTAL).alias(S.FINAL_COST_FIRST_CREDIT),
        plus(_NEXT_LEVEL).alias(S.FINAL_COST),
    )


def up_to(df: DataFrame, day: dt.date, value: str) -> Column:
    """A row's value if it was used on ``day`` (UTC) or before."""
    return F.when(usage_date(df) <= F.lit(day), F.col(value))


def final_cost_cube(billing: DataFrame, through: dt.date | None = None, month: Column | None = None) -> DataFrame:
    """(month, project_id, final_cost) only: the one measure every report reads.

    Same numbers as ``monthly_costs(...).final_cost`` (two sums, then added),
    with a smaller plan to build and analyse.  ``through`` adds
    ``final_cost_to_date``, the same over the lines up to that day: it splits
    that day's month, so that to-date figures need no scan of their own.
    """
    billing = load_billing(billing)
    parts = (S.COST, S.CREDITS_SUM_AMOUNT)
    rows = {c: F.col(c) for c in parts}
    if through is not None:
        rows |= {c + TO_DATE: up_to(billing, through, c) for c in parts}
    sums = monthly_sums(billing, rows, month=month)

    def total(suffix: str) -> Column:
        kinds = [sums.schema[c + suffix].dataType for c in parts]
        return exact_sum(*[F.col(c + suffix) for c in parts], *kinds).alias(S.FINAL_COST + suffix)

    return sums.select(S.MONTH, S.PROJECT_ID, *[total(x) for x in (("", TO_DATE) if through is not None else ("",))])


def cube_window(cube: DataFrame, lo: dt.date, hi: dt.date) -> DataFrame:
    """The months of a cube from ``lo`` until before ``hi``; the year, if it has one, prunes a stored cube's partitions."""
    inside = (F.col(S.MONTH) >= F.lit(lo)) & (F.col(S.MONTH) < F.lit(hi))
    if S.YEAR in cube.columns:
        inside &= F.col(S.YEAR).between(lo.year, (hi - dt.timedelta(days=1)).year)
    return cube.where(inside)


def monthly_costs(billing: DataFrame) -> DataFrame:
    """The original query's monthly cube (month, year, project_id + five measures).

    * ``final_cost_no_credits``   SUM(cost)
    * ``total_credits_computed1`` SUM(first credit, 0 when none)
    * ``total_credits_computed2`` SUM(all credits of the row, 0 when none)
    * ``final_cost_0``            SUM(cost) + total_credits_computed1
    * ``final_cost``              SUM(cost) + SUM(credits_sum_amount)

    Unused measures cost nothing: Catalyst drops them from the aggregate.
    """
    return finish_costs(monthly_cost_partials(billing))


def monthly_carbon(carbon: DataFrame, through: dt.date | None = None) -> DataFrame:
    """Carbon cube: (month, year, project_id, carbon_kg) with kilograms summed.

    ``through`` adds ``carbon_kg_to_date``, the kilograms up to that day."""
    sums = {S.CARBON_KG: F.col(S.CARBON_KG)}
    if through is not None:
        sums[S.CARBON_KG + TO_DATE] = up_to(carbon, through, S.CARBON_KG)
    return monthly_sums(carbon, sums)


def project_ids(billing: DataFrame) -> DataFrame:
    """Every project id seen in the export's whole history, the null id included.

    Reads only ``project.id``; partial aggregation keeps the shuffle at one
    row per id per task.
    """
    return billing.select(project_id_col().alias(S.PROJECT_ID)).distinct()


def is_cost_cube(df: DataFrame) -> bool:
    """True for an already aggregated cost cube (e.g. ``cube_store.read_cube``)."""
    cols = set(df.columns)
    return {S.MONTH, S.PROJECT_ID, S.FINAL_COST} <= cols and S.USAGE_START_TIME not in cols


def cost_cube(billing_or_cube: DataFrame) -> DataFrame:
    """The (month, project_id, final_cost) cube of an export, or the input itself
    when it already is a cube."""
    return billing_or_cube if is_cost_cube(billing_or_cube) else final_cost_cube(billing_or_cube)


def billed_project_ids(billing_or_cube: DataFrame) -> DataFrame:
    """Project ids of an export (id-only scan) or of a cube."""
    if is_cost_cube(billing_or_cube):
        return billing_or_cube.select(S.PROJECT_ID).distinct()
    return project_ids(billing_or_cube)
