"""Running totals beside a stored cube: any period's figure is the difference of two rows.

For every project there is one row a month, from its first month to the last
month of the store, with what was spent up to and including that month, how many
months have a total and how many have rows.  A period is the row of its last
month less the row of the month before its first, so a report reads one month for
each period bound, whatever the length of its years.  The differences are exact
for DECIMAL money.

Rows have a version.  ``refresh_running_totals`` writes those of a batch's
projects again, from the cube that the batch is part of by then, as a new
version; a project counts by its newest one.  Projects that no later batch
touched end at an earlier month; that row, marked as their last, stands for every
month after it.  ``write_running_totals`` starts over with one version.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens import schema as S
from spendlens.functions.calendar import ReportCalendar
from spendlens.operators.periods import PERIOD_COLUMNS, MONTH_SEEN, MONTH_SUMS, finish
from spendlens.sources.cube_store import BATCH_ID, LAST_MONTH, RUN_ID, drop_store, read_batch_ids, read_cube, read_project_ids

_RUNNING = "_running"  # hidden from parquet readers of the store by its name
VERSION = "version"
TOTAL, TOTALS, ROWS, LAST = "total", "n_totals", "n_rows", "is_last"


def _running_rows(cube: DataFrame, last: dt.date) -> DataFrame:
    """One row per project and month up to ``last``, with sums over all months so far."""
    cube = cube.where(F.col(S.PROJECT_ID).isNotNull() & F.col(S.MONTH).isNotNull()).select(
        S.PROJECT_ID, S.MONTH, S.FINAL_COST, F.lit(True).alias("seen"))
    grid = cube.groupBy(S.PROJECT_ID).agg(F.min(S.MONTH).alias("first")).select(
        S.PROJECT_ID, F.explode(F.sequence("first", F.lit(last), F.expr("INTERVAL 1 MONTH"))).alias(S.MONTH))
    so_far = Window.partitionBy(S.PROJECT_ID).orderBy(S.MONTH).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = grid.join(cube, [S.PROJECT_ID, S.MONTH], "left").select(
        S.PROJECT_ID, S.MONTH, F.sum(S.FINAL_COST).over(so_far).alias(TOTAL), F.count(S.FINAL_COST).over(so_far).alias(TOTALS),
        F.count("seen").over(so_far).alias(ROWS), (F.col(S.MONTH) == F.lit(last)).alias(LAST))
    kind = rows.schema[TOTAL].dataType
    if isinstance(kind, T.DecimalType):  # a digit to spare, so that differences keep every place
        kind = T.DecimalType(min(37, kind.precision), kind.scale)
    return rows.withColumn(TOTAL, F.coalesce(F.col(TOTAL), F.lit(0)).cast(kind))


def _write(spark: SparkSession, path: str, cube: DataFrame, version: int) -> None:
    last = read_project_ids(spark, path).agg(F.max(LAST_MONTH)).first()[0]
    if last is None:
        return
    (_running_rows(cube, last).select("*", F.lit(version).alias(VERSION), F.year(S.MONTH).alias(S.YEAR))
     .hint("rebalance", S.YEAR).sortWithinPartitions(VERSION, S.YEAR, S.MONTH, S.PROJECT_ID)
     .write.mode("append").partitionBy(VERSION, S.YEAR).parquet(os.path.join(path, _RUNNING)))


def write_running_totals(spark: SparkSession, path: str) -> None:
    """Running totals of every project of a store, in place of any it had."""
    drop_store(spark, os.path.join(path, _RUNNING))
    _write(spark, path, read_cube(spark, path), 0)


def refresh_running_totals(spark: SparkSession, path: str, run_id: str, batch_id: int) -> None:
    """Write the totals of one batch's projects again; the rest stay.  A repeated refresh adds an equal version."""
    newest = spark.read.parquet(os.path.join(path, _RUNNING)).agg(F.max(VERSION)).first()[0]
    touched = read_batch_ids(spark, path).where((F.col(RUN_ID) == run_id) & (F.col(BATCH_ID) == batch_id))
    cube = read_cube(spark, path).join(touched.select(S.PROJECT_ID).distinct(), S.PROJECT_ID, "left_semi")
    _write(spark, path, cube, newest + 1)


def read_running_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, _RUNNING))


def _month_before(day: dt.date) -> dt.date:
    return (day.replace(day=1) - dt.timedelta(days=1)).replace(day=1)


def running_report(spark: SparkSession, path: str, as_of=None) -> DataFrame:
    """The raw project report of a store (``cube_store.stored_report``) as differences of running totals."""
    cal = ReportCalendar.for_date(as_of)
    ids = read_project_ids(spark, path).select(S.PROJECT_ID)
    windows = {c: cal.period_window(p) for c, p in PERIOD_COLUMNS.items()}
    months = {m: (m, (m + dt.timedelta(days=31)).replace(day=1)) for m in cal.six_months}
    # Each period's last month and the month before its first.
    bounds = sorted({b for lo, hi in (*windows.values(), *months.values()) for b in (_month_before(lo), _month_before(hi))})
    month = F.col(S.MONTH)
    needed = month.isin(bounds) | (F.col(LAST) & (month < F.lit(bounds[-1])))
    years = sorted({b.year for b in bounds})
    rows = read_running_totals(spark, path).where(needed & (F.col(S.YEAR).isin(years) | F.col(LAST)))

    def at(bound: dt.date) -> Column:
        """The newest version's row that holds for the month."""
        holds = (month == F.lit(bound)) | (F.col(LAST) & (month < F.lit(bound)))
        return F.max(F.when(holds, F.struct(VERSION, TOTAL, TOTALS, ROWS)))

    found = rows.groupBy(S.PROJECT_ID).agg(*[at(b).alias(f"at_{b:%Y_%m}") for b in bounds])

    def change(window: tuple[dt.date, dt.date], name: str) -> Column:
        before, last = (F.col(f"at_{_month_before(d):%Y_%m}") for d in window)
        return last[name] - F.coalesce(before[name], F.lit(0).cast(rows.schema[name].dataType))

    def figure(window: tuple[dt.date, dt.date]) -> Column:
        return F.when(change(window, TOTALS) > 0, change(window, TOTAL))

    sums = [figure(w).alias(c) for c, w in windows.items()]
    for start, total, seen in zip(cal.six_months, MONTH_SUMS, MONTH_SEEN, strict=True):
        sums += [figure(months[start]).alias(total), F.when(change(months[start], ROWS) > 0, True).alias(seen)]
    return ids.join(finish(found.select(S.PROJECT_ID, *sums), [S.PROJECT_ID]), S.PROJECT_ID, "left")
