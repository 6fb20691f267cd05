"""Generated usage lines and report dates: Spark (both plan shapes) = brute force."""

import datetime as dt
import os
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

import brute
from spendlens import schema as S
from spendlens.operators.report import project_cost_report

SCHEMA = T.StructType([
    T.StructField(S.USAGE_START_TIME, T.TimestampNTZType()),
    T.StructField(S.PROJECT, T.StructType([T.StructField("id", T.StringType())])),
    T.StructField(S.COST, T.DecimalType(12, 2)),
    T.StructField(S.CREDITS, T.ArrayType(T.StructType([T.StructField("name", T.StringType()),
                                                       T.StructField("amount", T.DecimalType(12, 2))]))),
    T.StructField(S.CREDITS_SUM_AMOUNT, T.DecimalType(12, 2)),
])

money = st.decimals(min_value=Decimal("-50"), max_value=Decimal("500"), places=2, allow_nan=False)
moments = st.datetimes(min_value=dt.datetime(1998, 1, 1), max_value=dt.datetime(2002, 12, 31, 23, 59, 59))
credit_lists = st.one_of(st.none(), st.lists(st.one_of(st.none(), money), max_size=3))
line = st.tuples(moments, st.sampled_from(["p1", "p2", "p3", None]), money, credit_lists)
dates = st.one_of(
    st.dates(min_value=dt.date(1998, 1, 1), max_value=dt.date(2003, 6, 30)),
    st.sampled_from([dt.date(2000, 3, 31), dt.date(2000, 4, 1), dt.date(2000, 2, 29), dt.date(2001, 1, 1)]),
)


def _to_rows(lines):
    out = []
    for ts, pid, cost, credits in lines:
        credit_sum = None if credits is None else sum((a for a in credits if a is not None), Decimal("0.00"))
        arr = None if credits is None else [(f"c{i}", a) for i, a in enumerate(credits)]
        out.append((ts, (pid,), cost, arr, credit_sum))
    return out


@settings(max_examples=int(os.environ.get("SPENDLENS_PROPERTY_EXAMPLES", "12")), deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(line, min_size=1, max_size=40), as_of=dates)
def test_report_equals_brute_force(spark, lines, as_of):
    rows = _to_rows(lines)
    expected = brute.report([(ts, pid[0], cost, cs) for ts, pid, cost, _, cs in rows], as_of)
    df = spark.createDataFrame(rows, SCHEMA)
    for prune in (True, False):
        got = {r[S.PROJECT_ID]: tuple(r[f] for f in S.REPORT_FIELDS)
               for r in project_cost_report(df, as_of, prune_history=prune).collect()}
        assert got == expected, (prune, as_of)


@settings(max_examples=int(os.environ.get("SPENDLENS_PROPERTY_EXAMPLES", "6")), deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(st.tuples(moments, st.sampled_from(["p1", "p2", None]), st.one_of(st.none(), money),
                                credit_lists), min_size=1, max_size=30),
       cuts=st.lists(st.integers(min_value=0, max_value=30), max_size=3))
def test_batch_partials_add_up_to_the_cube(spark, lines, cuts):
    """Any split of the usage lines into batches sums back to the one-pass cube."""
    import tempfile

    from spendlens.operators.monthly import monthly_costs
    from spendlens.sources import cube_store
    from spendlens.streaming import cube_refresh

    rows = _to_rows(lines)
    bounds = sorted({0, len(rows), *[min(c, len(rows)) for c in cuts]})
    store = tempfile.mkdtemp(prefix="spendlens-partials-")
    for batch_id, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        if hi > lo:
            cube_refresh.write_batch(spark.createDataFrame(rows[lo:hi], SCHEMA), batch_id, store)
    cols = [S.MONTH, S.PROJECT_ID, S.FINAL_COST_NO_CREDITS, S.FIRST_CREDIT_TOTAL, S.ALL_CREDITS_TOTAL,
            S.FINAL_COST_FIRST_CREDIT, S.FINAL_COST]

    def rows_of(df):
        return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)

    assert rows_of(cube_store.read_cube(spark, store)) == rows_of(monthly_costs(spark.createDataFrame(rows, SCHEMA)))
