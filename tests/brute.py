"""Brute-force report in plain Python, used as a test oracle on small inputs.

A ledger holds each project's monthly totals.  A period is a set of months,
found by walking the calendar from the report date; a figure adds up the
ledger's entries of those months.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

DAY = dt.timedelta(days=1)


def first_of_month(day: dt.date) -> dt.date:
    while day.day != 1:
        day -= DAY
    return day


def last_april_first(day: dt.date) -> dt.date:
    """The start of the fiscal year: the last April 1 on or before a day."""
    while (day.month, day.day) != (4, 1):
        day -= DAY
    return day


def months_on(start: dt.date, n: int) -> list[dt.date]:
    """``n`` month starts from ``start`` on."""
    out = [start]
    while len(out) < n:
        out.append(first_of_month(out[-1] + 31 * DAY))
    return out


def months_before(start: dt.date, n: int) -> list[dt.date]:
    """``n`` month starts before ``start``, newest first."""
    out = []
    for _ in range(n):
        start = first_of_month(start - DAY)
        out.append(start)
    return out


def _total(values):
    known = [v for v in values if v is not None]
    return sum(known) if known else None


def _change(now, then):
    if now is None or not then:
        return None
    return (now - then) / then * 100


def report(rows, as_of: dt.date) -> dict:
    """rows: (timestamp, project id or None, cost, credits_sum_amount); values Decimal or None."""
    lines = defaultdict(lambda: defaultdict(list))
    for ts, pid, cost, credit in rows:
        lines[pid][first_of_month(ts.date())].append((cost, credit))
    now = first_of_month(as_of)
    fiscal, january = last_april_first(as_of), dt.date(as_of.year, 1, 1)
    before = {12: months_before(fiscal, 12), 1: months_before(january, 12)}
    periods = [[now], months_before(now, 1), months_on(january, 12), before[1], months_on(fiscal, 12), before[12]]
    out = {}
    for pid, months in lines.items():
        ledger = {}
        for month, entries in months.items():
            cost, credit = _total(c for c, _ in entries), _total(c for _, c in entries)
            ledger[month] = None if cost is None or credit is None else cost + credit
        if pid is None:  # it is listed, without figures
            out[pid] = (None,) * 9
            continue
        sums = [_total(ledger.get(m) for m in p) for p in periods]
        month, prev, year, last_year, fy, last_fy = [None if v is None else float(v) for v in sums]
        series = [None if ledger[m] is None else float(ledger[m]) for m in months_before(now, 6) if m in ledger]
        out[pid] = (month, prev, _change(month, prev), year, last_year, fy, last_fy, _change(fy, last_fy), series or None)
    return out
