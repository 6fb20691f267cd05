import datetime as dt

import brute
import pytest
from pyspark.sql import functions as F

from spendlens.functions.calendar import ReportCalendar, fiscal_calendar_columns


def _bounds(d: dt.date):
    """Fiscal bounds by walking: back to the last April 1, on to the day before the next one, and once more back."""
    start = brute.last_april_first(d)
    last = start
    while (last + brute.DAY).month != 4 or (last + brute.DAY).day != 1:
        last += brute.DAY
    return brute.last_april_first(start - brute.DAY), start - brute.DAY, start, last


@pytest.mark.parametrize("d", [dt.date(2000, 9, 17), dt.date(2000, 3, 31), dt.date(2000, 4, 1),
                               dt.date(2000, 1, 15), dt.date(2001, 12, 30), dt.date(1995, 5, 31),
                               dt.date(2000, 2, 29)])
def test_scalar_calendar(d):
    cal = ReportCalendar.for_date(d)
    assert (cal.prev_fy_start, cal.prev_fy_end, cal.fy_start, cal.fy_end) == _bounds(d)
    assert cal.month_start == d.replace(day=1)
    assert cal.prev_month_start < cal.month_start and cal.prev_month_start.day == 1
    assert (cal.month_start.year * 12 + cal.month_start.month) - (cal.six_months_start.year * 12
                                                                   + cal.six_months_start.month) == 6
    lo, hi = cal.scan_window()
    for p in ("current_month", "previous_month", "last_six_months", "current_calendar_year",
              "previous_calendar_year", "current_fiscal_year", "previous_fiscal_year"):
        a, b = cal.period_window(p)
        assert lo <= a < b <= hi


def test_month_end_clamp():
    # March 31 minus one month is Feb 29 in 2000; the month start is Feb 1 either way.
    assert ReportCalendar.for_date("2000-03-31").prev_month_start == dt.date(2000, 2, 1)


def test_column_calendar_matches_the_walk_every_day(spark):
    days = spark.range(0, 366 * 3).select(F.date_add(F.lit(dt.date(1999, 1, 1)), F.col("id").cast("int")).alias("d"))
    cols = fiscal_calendar_columns(F.col("d"))
    rows = days.select("d", cols["prev_fy_start"], cols["prev_fy_end"], cols["current_fy_start"],
                       cols["current_fy_end"], cols["fiscal_year"]).collect()
    assert len(rows) == 366 * 3
    for r in rows:
        expected = _bounds(r[0])
        assert tuple(r[1:5]) == expected
        assert r[5] == expected[2].year


def test_as_of_accepts_dates_datetimes_and_strings():
    expected = ReportCalendar.for_date(dt.date(2000, 9, 17))
    assert ReportCalendar.for_date("2000-09-17") == expected
    assert ReportCalendar.for_date("2000-09-17T23:59:59") == expected
    assert ReportCalendar.for_date(dt.datetime(2000, 9, 17, 8)) == expected


def test_zoned_as_of_is_the_utc_day():
    zone = dt.timezone(dt.timedelta(hours=5))
    for value in (dt.datetime(2000, 4, 1, 1, tzinfo=zone), "2000-04-01T01:00:00+05:00"):
        cal = ReportCalendar.for_date(value)
        assert cal.as_of == dt.date(2000, 3, 31) and cal.fy_start == dt.date(1999, 4, 1)
