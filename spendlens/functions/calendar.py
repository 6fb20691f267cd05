"""Report calendar: the report date and the periods derived from it.

Every period boundary of a report is a constant once the report date
(``as_of``) is known, so the boundaries are computed here on the driver and
enter the plan as literals; Catalyst folds the comparisons and can push the
scan window down to the parquet reader.  ``fiscal_year_start`` and friends are
the same rules as Column expressions, for per-row use.

Fiscal years run from April 1 to March 31; January to March belong to the
fiscal year that began the previous April.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the fiscal year starts on April 1.
FISCAL_START_MONTH = 4


def _month_start(d: dt.date) -> dt.date:
    return d.replace(day=1)


def _add_months(d: dt.date, n: int) -> dt.date:
    """First-of-month arithmetic (only used on month starts, so no clamping)."""
    idx = d.year * 12 + (d.month - 1) + n
    return dt.date(idx // 12, idx % 12 + 1, 1)


def utc_today() -> dt.date:
    return dt.datetime.now(dt.timezone.utc).date()


def _utc_date(value: dt.datetime) -> dt.date:
    return (value.astimezone(dt.timezone.utc) if value.tzinfo else value).date()


def to_date(value: dt.date | dt.datetime | str | None) -> dt.date:
    """The UTC day of a date, a datetime (zoned ones are shifted to UTC) or an ISO string of either."""
    if value is None:
        return utc_today()
    if isinstance(value, dt.datetime):
        return _utc_date(value)
    if isinstance(value, dt.date):
        return value
    text = str(value).strip()
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        return _utc_date(dt.datetime.fromisoformat(text))


@dataclass(frozen=True)
class ReportCalendar:
    """All period bounds of one report, as Python dates (month starts)."""

    as_of: dt.date
    month_start: dt.date
    prev_month_start: dt.date
    six_months_start: dt.date
    year: int
    prev_year: int
    fy_start: dt.date
    fy_end: dt.date
    prev_fy_start: dt.date
    prev_fy_end: dt.date

    @classmethod
    def for_date(cls, as_of: dt.date | dt.datetime | str | None = None) -> "ReportCalendar":
        d = to_date(as_of)
        m0 = _month_start(d)
        fy_year = d.year if d.month >= FISCAL_START_MONTH else d.year - 1
        fy_start = dt.date(fy_year, FISCAL_START_MONTH, 1)
        return cls(
            as_of=d,
            month_start=m0,
            prev_month_start=_add_months(m0, -1),
            six_months_start=_add_months(m0, -6),
            year=d.year,
            prev_year=d.year - 1,
            fy_start=fy_start,
            fy_end=_add_months(fy_start, 12) - dt.timedelta(days=1),
            prev_fy_start=_add_months(fy_start, -12),
            prev_fy_end=fy_start - dt.timedelta(days=1),
        )

    @property
    def six_months(self) -> list[dt.date]:
        """The six full months before the current one, newest first."""
        return [_add_months(self.month_start, -n) for n in range(1, 7)]

    def scan_window(self) -> tuple[dt.date, dt.date]:
        """[first day, day after the last day] covering every period of the report.

        Rows outside this window cannot change any metric, so a report may skip
        them; they still matter for *which* projects appear (all history).
        """
        lo = min(dt.date(self.prev_year, 1, 1), self.prev_fy_start, self.six_months_start)
        hi = max(dt.date(self.year + 1, 1, 1), self.fy_end + dt.timedelta(days=1))
        return lo, hi

    def period_window(self, period: str) -> tuple[dt.date, dt.date]:
        """[first day, day after the last day] of one named period."""
        windows = {
            "current_month": (self.month_start, _add_months(self.month_start, 1)),
            "previous_month": (self.prev_month_start, self.month_start),
            "last_six_months": (self.six_months_start, self.month_start),
            "current_calendar_year": (dt.date(self.year, 1, 1), dt.date(self.year + 1, 1, 1)),
            "previous_calendar_year": (dt.date(self.prev_year, 1, 1), dt.date(self.year, 1, 1)),
            "current_fiscal_year": (self.fy_start, self.fy_end + dt.timedelta(days=1)),
            "previous_fiscal_year": (self.prev_fy_start, self.fy_start),
        }
        if period not in windows:
            raise ValueError(f"unknown period {period!r}; expected one of {sorted(windows)}")
        return windows[period]

    def days_elapsed(self, start: dt.date) -> int:
        return (self.as_of - start).days + 1

    @property
    def fiscal_days(self) -> int:
        return (self.fy_end - self.fy_start).days + 1

    @property
    def calendar_days(self) -> int:
        return (dt.date(self.year + 1, 1, 1) - dt.date(self.year, 1, 1)).days


def month_of(date_col: Column) -> Column:
    """First day of the month of a DATE column (no session-zone shift)."""
    return F.trunc(date_col, "MM")


def fiscal_year_start(date_col: Column) -> Column:
    """April 1 of the fiscal year that contains ``date_col``."""
    y = F.year(date_col) - F.when(F.month(date_col) >= FISCAL_START_MONTH, 0).otherwise(1)
    return F.make_date(y, F.lit(FISCAL_START_MONTH), F.lit(1))


def fiscal_year_end(date_col: Column) -> Column:
    return F.date_sub(F.add_months(fiscal_year_start(date_col), 12), 1)


def previous_fiscal_year_start(date_col: Column) -> Column:
    return F.add_months(fiscal_year_start(date_col), -12)


def previous_fiscal_year_end(date_col: Column) -> Column:
    return F.date_sub(fiscal_year_start(date_col), 1)


def fiscal_calendar_columns(date_col: Column) -> dict[str, Column]:
    """The four fiscal bounds plus the fiscal year's start year, for a date column."""
    return {
        "fiscal_year": F.year(fiscal_year_start(date_col)),
        "prev_fy_start": previous_fiscal_year_start(date_col),
        "prev_fy_end": previous_fiscal_year_end(date_col),
        "current_fy_start": fiscal_year_start(date_col),
        "current_fy_end": fiscal_year_end(date_col),
    }
