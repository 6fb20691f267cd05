import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens import schema as S
from spendlens.functions.measures import credit_total, first_credit_amount
from spendlens.sources import billing as B


def test_validate_reports_every_problem(spark):
    df = spark.createDataFrame([(1, "x")], "usage_start_time int, cost string")
    with pytest.raises(ValueError) as err:
        B.validate_billing(df)
    msg = str(err.value)
    assert "usage_start_time" in msg and "project" in msg and "cost" in msg


def test_normalize_ids():
    assert B.normalize_ids("a") == ["a"]
    assert B.normalize_ids(["b", "a", "b"]) == ["b", "a"]
    assert B.normalize_ids(None) == [] and B.normalize_ids([]) == []
    with pytest.raises(ValueError):
        B.normalize_ids(["a", None])


def _billing(spark):
    credit = T.StructType([T.StructField("name", T.StringType()), T.StructField("amount", T.DecimalType(18, 4))])
    schema = T.StructType([
        T.StructField(S.USAGE_START_TIME, T.TimestampType()),
        T.StructField(S.PROJECT, T.StructType([T.StructField("id", T.StringType())])),
        T.StructField(S.COST, T.DecimalType(12, 2)),
        T.StructField(S.CREDITS, T.ArrayType(credit)),
    ])
    from decimal import Decimal as D
    rows = [
        (dt.datetime(2000, 1, 1), ("p1",), D("10.00"), [("x", D("-1.5")), ("y", None), ("z", D("-0.25"))]),
        (dt.datetime(2000, 1, 2), ("p2",), D("5.00"), []),
        (dt.datetime(2000, 1, 3), ("p3",), D("7.00"), None),
        (dt.datetime(2000, 1, 4), (None,), D("1.00"), [("x", None)]),
        (dt.datetime(2000, 1, 5), ("p5",), D("2.00"),
         [("a", D("-1")), ("b", None), ("c", D("-2")), ("d", D("-3")), ("e", D("-0.5"))]),
    ]
    return spark.createDataFrame(rows, schema)


def test_credit_expressions(spark):
    df = _billing(spark)
    amount_type = T.DecimalType(18, 4)
    got = {r[0]: (r[1], r[2]) for r in df.select(
        F.col("project.id"), first_credit_amount(amount_type), credit_total(amount_type)).collect()}
    from decimal import Decimal as D
    assert got["p1"] == (D("-1.5"), D("-1.75"))      # nulls skipped in the total
    assert got["p2"] == (D("0"), D("0"))             # empty: both 0
    assert got["p3"][0] is None and got["p3"][1] == D("0")  # null array: first null, total 0
    assert got[None] == (None, D("0"))               # only a null amount
    assert got["p5"] == (D("-1"), D("-6.5"))         # longer than the unrolled sizes


def test_load_billing_derives_credit_sum(spark):
    df = B.load_billing(_billing(spark))
    assert S.CREDITS_SUM_AMOUNT in df.columns


def test_filter_projects_list_and_semi_join(spark):
    df = _billing(spark)
    by_list = sorted(r[0] for r in B.filter_projects(df, ["p1", "p3", "nope"]).select("project.id").collect())
    assert by_list == ["p1", "p3"]
    ids = spark.createDataFrame([("p2",), ("p2",), (None,)], "project_id string")
    by_df = [r[0] for r in B.filter_projects(df, ids).select("project.id").collect()]
    assert by_df == ["p2"]
    by_iterator = sorted(r[0] for r in B.filter_projects(df, iter(["p1", "p2"])).select("project.id").collect())
    assert by_iterator == ["p1", "p2"]


def test_usage_date_is_utc_whatever_the_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 8, 31, 23, 30),)], "usage_start_time timestamp")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Toronto")
        # 02:00 UTC on Sep 1 is still Aug 31 in Toronto; the report uses the UTC day.
        shifted = spark.createDataFrame([(dt.datetime(2000, 9, 1, 2, 0, tzinfo=dt.timezone.utc),)],
                                        "usage_start_time timestamp")
        assert shifted.select(F.to_date("usage_start_time")).first()[0] == dt.date(2000, 8, 31)
        assert shifted.select(B.usage_date(shifted)).first()[0] == dt.date(2000, 9, 1)
        assert B.usage_between(shifted, dt.date(2000, 9, 1), dt.date(2000, 9, 2)).count() == 1
        assert B.usage_between(shifted, dt.date(2000, 8, 31), dt.date(2000, 9, 1)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert df.select(B.usage_date(df)).first()[0] == dt.date(2000, 8, 31)


def test_numeric_project_ids_are_rejected(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1), (1,), 1.0, 0.0)],
                               "usage_start_time timestamp, project struct<id:bigint>, cost double, "
                               "credits_sum_amount double")
    with pytest.raises(ValueError, match="struct<id: string>"):
        B.validate_billing(df)
