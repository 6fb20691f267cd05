"""The report on the driver's lines, both plan shapes, against the ledger walk of ``brute``, on edge dates."""

import datetime as dt

import pytest

import brute
from conftest import SF_SMALL
from spendlens import schema as S
from spendlens.operators.report import project_cost_report
from spendlens.sources import fixtures

DATES = [dt.date(2000, 9, 17), dt.date(2000, 3, 31), dt.date(2000, 1, 15), dt.date(2000, 4, 1),
         dt.date(2001, 12, 30), dt.date(1995, 5, 31)]


@pytest.fixture(scope="module")
def billing(spark):
    return fixtures.billing(spark, SF_SMALL)


@pytest.fixture(scope="module")
def lines(billing):
    return [tuple(r) for r in billing.select(S.USAGE_START_TIME, "project.id", S.COST, S.CREDITS_SUM_AMOUNT).collect()]


@pytest.mark.parametrize("as_of", DATES)
def test_report_equals_ledger(billing, lines, as_of):
    want = brute.report(lines, as_of)
    for prune in (True, False):
        rows = project_cost_report(billing, as_of, prune_history=prune).collect()
        assert {r[S.PROJECT_ID]: tuple(r[f] for f in S.REPORT_FIELDS) for r in rows} == want
