"""Period-over-period report over a monthly cube.

Every figure of the report is a sum over some months, so one ``groupBy(key)``
with conditional sums (``sum(when(in_period, v))``) gives them all: one pass
over the cube, one shuffle, no joins.  The six-month series is six more
conditional sums with a flag each for whether the month has a row: the state of
a key has a fixed size and stays in whole-stage codegen, and a null monthly
total keeps its slot while a month without rows has none.

The sums are additive over any split of the rows, so sums per project can be
added up per organisational unit (``add_up``) before ``finish`` turns them into
the report.  Two details keep the results equal to the original's equality
joins: every metric of a null key is null (``valid`` mask), and a key without
a month in the range gets a null series, not an empty one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import schema as S
from spendlens.functions.calendar import ReportCalendar
from spendlens.functions.measures import as_double, pct_change

#: The report columns that are one period's sum, and their periods.
PERIOD_COLUMNS = {
    S.CURRENT_MONTH: "current_month",
    S.PREVIOUS_MONTH: "previous_month",
    S.CURRENT_CALENDAR_YEAR: "current_calendar_year",
    S.PREVIOUS_CALENDAR_YEAR: "previous_calendar_year",
    S.CURRENT_FISCAL_YEAR: "current_fiscal_year",
    S.PREVIOUS_FISCAL_YEAR: "previous_fiscal_year",
}
#: Sum and presence of each of the six months, newest first.
MONTH_SUMS = [f"_month_{i}" for i in range(1, 7)]
MONTH_SEEN = [f"_seen_{i}" for i in range(1, 7)]


def _lit(d: dt.date) -> Column:
    return F.lit(d)


def period_predicates(cal: ReportCalendar, month: Column) -> dict[str, Column]:
    """Month-level membership test of every period (bounds are literals)."""
    return {
        "current_month": month == _lit(cal.month_start),
        "previous_month": month == _lit(cal.prev_month_start),
        "last_six_months": (month >= _lit(cal.six_months_start)) & (month < _lit(cal.month_start)),
        "current_calendar_year": month.between(_lit(dt.date(cal.year, 1, 1)), _lit(dt.date(cal.year, 12, 1))),
        "previous_calendar_year": month.between(
            _lit(dt.date(cal.prev_year, 1, 1)), _lit(dt.date(cal.prev_year, 12, 1))
        ),
        "current_fiscal_year": month.between(_lit(cal.fy_start), _lit(cal.fy_end)),
        "previous_fiscal_year": month.between(_lit(cal.prev_fy_start), _lit(cal.prev_fy_end)),
    }


def valid_key(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def period_total(cube: DataFrame, as_of, period: str, keys: Sequence[str] = (S.PROJECT_ID,),
                 value: str = S.FINAL_COST, name: str | None = None) -> DataFrame:
    """One period on its own: total of ``value`` per key over the period's months.

    Keys without a month in the period are absent; the null key is its own
    group (its real total), as in a standalone grouped sub-query.
    """
    cal = ReportCalendar.for_date(as_of)
    pred = period_predicates(cal, F.col(S.MONTH))[period]
    out_name = name or period
    return cube.where(pred).groupBy(*keys).agg(as_double(F.sum(value)).alias(out_name))


def period_sums(as_of, value: str = S.FINAL_COST, valid: Column | None = None) -> list[Column]:
    """Aggregates over a cube (``month``, ``value``): the raw sums behind one report row."""
    cal = ReportCalendar.for_date(as_of)
    month, v = F.col(S.MONTH), F.col(value)
    valid = F.lit(True) if valid is None else valid
    inside = period_predicates(cal, month)
    aggs = [F.sum(F.when(valid & inside[p], v)).alias(c) for c, p in PERIOD_COLUMNS.items()]
    for start, total, seen in zip(cal.six_months, MONTH_SUMS, MONTH_SEEN):
        here = valid & (month == _lit(start))
        aggs += [F.sum(F.when(here, v)).alias(total), F.max(F.when(here, True)).alias(seen)]
    return aggs


def add_up() -> list[Column]:
    """Aggregates that combine rows of ``period_sums`` (of projects, say) into one such row."""
    return [F.sum(c).alias(c) for c in (*PERIOD_COLUMNS, *MONTH_SUMS)] + [F.max(c).alias(c) for c in MONTH_SEEN]


def _series() -> Column:
    """Newest-first array of the months that have rows; null when none has."""
    months = F.array(*[F.when(F.col(seen), F.struct(as_double(F.col(total)).alias("v")))
                       for total, seen in zip(MONTH_SUMS, MONTH_SEEN)])
    values = F.transform(F.filter(months, lambda m: m.isNotNull()), lambda m: m["v"])
    return F.when(F.size(values) > 0, values)


def finish(sums: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """``period_sums`` columns into the nine report metrics, with ``keys`` before and ``extra`` after them."""
    d = {c: as_double(F.col(c)) for c in PERIOD_COLUMNS}
    metrics = {
        S.CURRENT_MONTH: d[S.CURRENT_MONTH],
        S.PREVIOUS_MONTH: d[S.PREVIOUS_MONTH],
        S.MONTH_DELTA: pct_change(d[S.CURRENT_MONTH], d[S.PREVIOUS_MONTH]),
        S.CURRENT_CALENDAR_YEAR: d[S.CURRENT_CALENDAR_YEAR],
        S.PREVIOUS_CALENDAR_YEAR: d[S.PREVIOUS_CALENDAR_YEAR],
        S.CURRENT_FISCAL_YEAR: d[S.CURRENT_FISCAL_YEAR],
        S.PREVIOUS_FISCAL_YEAR: d[S.PREVIOUS_FISCAL_YEAR],
        S.FISCAL_DELTA: pct_change(d[S.CURRENT_FISCAL_YEAR], d[S.PREVIOUS_FISCAL_YEAR]),
        S.LAST_SIX_MONTHS: _series(),
    }
    return sums.select(*keys, *[c.alias(name) for name, c in metrics.items()], *extra)


def period_report(cube: DataFrame, as_of, keys: Sequence[str] = (S.PROJECT_ID,),
                  value: str = S.FINAL_COST) -> DataFrame:
    """All report metrics per key in one aggregation over the cube.

    ``cube`` needs the key columns, ``month`` (DATE, first of month) and ``value``.
    """
    return finish(cube.groupBy(*keys).agg(*period_sums(as_of, value, valid_key(keys))), keys)


def report_over_history(ids: DataFrame, windowed_cube: DataFrame, as_of, keys: Sequence[str] = (S.PROJECT_ID,),
                        value: str = S.FINAL_COST) -> DataFrame:
    """Report for every key in ``ids`` with metrics from a date-windowed cube.

    ``ids`` comes from the whole history (cheap: one column), the metrics only
    from the months the report can see.  Keys without rows in the window get
    null metrics, exactly as if the whole history had been aggregated.
    """
    metrics = period_report(windowed_cube, as_of, keys, value).where(valid_key(keys))
    return ids.join(metrics, on=list(keys), how="left")
