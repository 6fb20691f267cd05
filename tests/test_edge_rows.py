"""Hand-made usage lines, one per tricky rule, with the report worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from spendlens import schema as S
from spendlens.operators.report import all_projects, project_cost_report, projects

AS_OF = dt.date(2000, 9, 17)
CREDIT = T.StructType([T.StructField("name", T.StringType()), T.StructField("amount", T.DoubleType())])
SCHEMA = T.StructType([
    T.StructField(S.USAGE_START_TIME, T.TimestampType()),
    T.StructField(S.PROJECT, T.StructType([T.StructField("id", T.StringType())])),
    T.StructField(S.COST, T.DoubleType()),
    T.StructField(S.CREDITS, T.ArrayType(CREDIT)),
    T.StructField(S.CREDITS_SUM_AMOUNT, T.DoubleType()),
])


def _row(pid, ts, cost, credits):
    total = None if credits is None else float(sum(credits))
    arr = None if credits is None else [(f"c{i}", float(a)) for i, a in enumerate(credits)]
    return (ts, (pid,), float(cost), arr, total)


ROWS = [
    _row("a", dt.datetime(2000, 9, 1, 0, 0, 0), 100, [-10]),    # first instant of the month
    _row("a", dt.datetime(2000, 8, 31, 23, 59, 59), 50, []),   # last instant of the previous month
    _row("a", dt.datetime(2000, 3, 31, 23, 59, 59), 7, [-1, -2]),  # last fiscal day, two credits
    _row("a", dt.datetime(2000, 4, 1, 0, 0, 0), 8, []),        # first fiscal day
    _row("a", dt.datetime(2000, 9, 30, 12, 0, 0), 1, []),      # after as_of, same month: counted
    _row("b", dt.datetime(2000, 9, 2), 5, []),                 # no previous month, no six-month rows
    _row("c", dt.datetime(2000, 9, 3), 5, []),                 # previous month nets to 0 -> delta null
    _row("c", dt.datetime(2000, 8, 3), 4, [-4]),
    _row("d", dt.datetime(1990, 1, 1), 9, []),                 # only ancient spend: row with nulls
    _row("e", dt.datetime(2000, 8, 1), 3, None),               # null credits -> null monthly total
    _row("e", dt.datetime(2000, 7, 1), 2, []),
    _row(None, dt.datetime(2000, 9, 5), 1000, []),             # null project: own row, all null
]

N = None
# project: month, prev, delta, cal, prev cal, fiscal, prev fiscal, fiscal delta, last six
EXPECTED = {
    "a": (91.0, 50.0, 82.0, 153.0, N, 149.0, 4.0, 3625.0, [50.0, 8.0, 4.0]),
    "b": (5.0, N, N, 5.0, N, 5.0, N, N, N),
    "c": (5.0, 0.0, N, 5.0, N, 5.0, N, N, [0.0]),
    "d": (N, N, N, N, N, N, N, N, N),
    "e": (N, N, N, 2.0, N, 2.0, N, N, [N, 2.0]),
    None: (N, N, N, N, N, N, N, N, N),
}


@pytest.fixture(scope="module")
def billing(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _as_dict(df):
    return {r[S.PROJECT_ID]: tuple(r[f] for f in S.REPORT_FIELDS) for r in df.collect()}


@pytest.mark.parametrize("prune", [True, False])
def test_raw_report(billing, prune):
    got = _as_dict(project_cost_report(billing, AS_OF, prune_history=prune))
    assert got == {k: tuple(v) for k, v in EXPECTED.items()}


@pytest.mark.parametrize("prune", [True, False])
def test_raw_report_ntz_input(billing, prune):
    ntz = billing.withColumn(S.USAGE_START_TIME, billing[S.USAGE_START_TIME].cast("timestamp_ntz"))
    got = _as_dict(project_cost_report(ntz, AS_OF, prune_history=prune))
    assert got == {k: tuple(v) for k, v in EXPECTED.items()}


def test_api_flavour(billing):
    got = _as_dict(all_projects(billing, AS_OF))

    def api(v):
        nums = tuple(0.0 if x is None else x for x in v[:-1])
        arr = None if v[-1] is None else [0.0 if x is None else x for x in v[-1]]
        return nums + (arr,)

    assert got == {("" if k is None else k): api(v) for k, v in EXPECTED.items()}


def test_id_filter_before_aggregation(billing):
    got = _as_dict(projects(billing, ["a", "a", "zzz", "c"], AS_OF, flavour="raw"))
    assert got == {"a": tuple(EXPECTED["a"]), "c": tuple(EXPECTED["c"])}


def test_empty_and_null_id_lists(billing):
    assert projects(billing, [], AS_OF).count() == 0
    assert projects(billing, None, AS_OF).count() == 0
    with pytest.raises(ValueError):
        projects(billing, ["a", None], AS_OF)


def test_derived_credit_sum_matches(billing):
    derived = project_cost_report(billing.drop(S.CREDITS_SUM_AMOUNT), AS_OF)
    got = _as_dict(derived)
    # A null credits array derives a credit sum of 0, so e's August total is 3.
    assert got["e"][-1] == [3.0, 2.0]
    assert got["a"] == tuple(EXPECTED["a"])


def test_id_tables_iterables_and_long_lists(spark, billing):
    ids = spark.createDataFrame([("a",), ("c",), ("c",), (None,), ("zzz",)], "project_id string")
    got = _as_dict(projects(billing, ids, AS_OF, flavour="raw"))
    assert got == {"a": tuple(EXPECTED["a"]), "c": tuple(EXPECTED["c"])}
    many = ["a", "c"] + [f"no-{i}" for i in range(20_000)]
    table = spark.createDataFrame([(i,) for i in many], "project_id string")
    for ids in (many, table, (i for i in ["a", "c", "a"])):
        got = _as_dict(projects(billing, ids, AS_OF, flavour="raw"))
        assert got == {"a": tuple(EXPECTED["a"]), "c": tuple(EXPECTED["c"])}


def test_through_as_of_drops_later_days(billing):
    got = _as_dict(project_cost_report(billing, AS_OF, through_as_of=True))
    assert got["a"][:8] == (90.0, 50.0, 80.0, 152.0, None, 148.0, 4.0, 3600.0)
    assert got["b"] == tuple(EXPECTED["b"])


def test_project_details_nested_record(spark, billing):
    from spendlens.operators.project_details import project_details

    dim = spark.createDataFrame(
        [("a", "PROTECTED_A", "D1", "DD1", "B1", "BB1", "R1", "RR1")],
        "project_id string, classification string, department string, department_acronym string, "
        "branch string, branch_acronym string, directorate string, directorate_acronym string")
    carbon = billing.select(S.USAGE_START_TIME, S.PROJECT, billing[S.COST].alias(S.CARBON_KG))
    rows = {r["id"]: r for r in project_details(billing, AS_OF, dim=dim, carbon=carbon).collect()}
    a = rows["a"]
    assert a["costs"][S.CURRENT_MONTH] == 91.0 and a["costs"][S.LAST_SIX_MONTHS] == [50.0, 8.0, 4.0]
    assert a["classification"] == "PROTECTED_A" and a["owner"]["name"] == "D1" and a["owner"]["acronym"] == "DD1"
    assert a["carbonFootprint"][S.CURRENT_MONTH] == 101.0      # kilograms = cost here, no credits
    assert rows["b"]["owner"] is None and rows["b"]["classification"] is None
    assert rows[""]["costs"][S.CURRENT_MONTH] == 0.0           # null project, API flavour


def test_json_export_reads_with_the_declared_schema(spark, billing):
    import os
    import tempfile

    from spendlens.sources.billing import read_billing

    path = os.path.join(tempfile.mkdtemp(prefix="spendlens-json-"), "export")
    billing.write.json(path)
    loaded = read_billing(spark, path, fmt="json")
    assert loaded.schema[S.COST].dataType == S.BILLING_SCHEMA[S.COST].dataType
    assert _as_dict(project_cost_report(loaded, AS_OF)) == {k: tuple(v) for k, v in EXPECTED.items()}


def test_report_schema_is_stable(billing):
    def shape(schema):
        return [(f.name, f.dataType.simpleString()) for f in schema.fields]

    assert shape(all_projects(billing, AS_OF).schema) == shape(S.REPORT_SCHEMA)
    assert shape(project_cost_report(billing, AS_OF, prune_history=False).schema) == shape(S.REPORT_SCHEMA)


def test_same_report_with_ansi_mode_off(spark):
    legacy = spark.newSession()
    legacy.conf.set("spark.sql.ansi.enabled", "false")
    df = legacy.createDataFrame(ROWS, SCHEMA)
    for prune in (True, False):
        got = _as_dict(project_cost_report(df, AS_OF, prune_history=prune))
        assert got == {k: tuple(v) for k, v in EXPECTED.items()}


def test_through_as_of_for_carbon_and_units(spark, billing):
    from spendlens.operators import org
    from spendlens.operators.carbon import carbon_report

    carbon = billing.select(S.USAGE_START_TIME, S.PROJECT, billing[S.COST].alias(S.CARBON_KG))
    kg = {r[S.PROJECT_ID]: r for r in carbon_report(carbon, AS_OF, through_as_of=True).collect()}
    assert kg["a"][S.CURRENT_MONTH] == 100.0            # 100 on Sep 1; the Sep 30 line is after as_of
    dim = spark.createDataFrame(
        [("a", "PROTECTED_A", "D1", "DD1", "B1", "BB1", "R1", "RR1")],
        "project_id string, classification string, department string, department_acronym string, "
        "branch string, branch_acronym string, directorate string, directorate_acronym string")
    units = {r["level"]: r for r in org.org_unit_costs(billing, dim, AS_OF, through_as_of=True).collect()}
    assert units["department"][S.CURRENT_MONTH] == 90.0   # project a without its Sep 30 line


def test_estimates_stop_at_the_report_date(spark, billing):
    from spendlens.operators.estimates import carbon_estimates, cost_estimates
    from spendlens.operators.project_details import project_details

    rows = {r[S.PROJECT_ID]: r for r in cost_estimates(billing, AS_OF).collect()}
    assert rows["a"][S.CURRENT_FISCAL_YEAR] == 148.0          # without the line of Sep 30
    assert rows["a"][S.CURRENT_FISCAL_ESTIMATED] == 148.0 * 365 / 170
    assert rows["a"][S.CURRENT_CALENDAR_ESTIMATED] == 152.0 * 366 / 261
    carbon = billing.select(S.USAGE_START_TIME, S.PROJECT, billing[S.COST].alias(S.CARBON_KG))
    kg = {r[S.PROJECT_ID]: r for r in carbon_estimates(carbon, AS_OF).collect()}
    assert kg["b"][S.CURRENT_FISCAL_ESTIMATED] == 5.0 * 365 / 170
    full = {r["id"]: r for r in project_details(billing, AS_OF, carbon=carbon, estimates=True).collect()}
    assert full["a"]["costs"][S.CURRENT_FISCAL_ESTIMATED] == rows["a"][S.CURRENT_FISCAL_ESTIMATED]
    assert full["b"]["carbonFootprint"][S.CURRENT_FISCAL_ESTIMATED] == kg["b"][S.CURRENT_FISCAL_ESTIMATED]
    assert full[""]["costs"][S.CURRENT_FISCAL_ESTIMATED] == 0.0
    plain = {r["id"]: r for r in project_details(billing, AS_OF, carbon=carbon).collect()}
    assert plain["a"]["costs"][S.CURRENT_FISCAL_ESTIMATED] is None


def test_full_precision_decimals_keep_every_place(spark):
    from decimal import Decimal

    from spendlens.operators.monthly import monthly_costs
    from spendlens.sources.billing import load_billing

    tiny = Decimal("0.000000001")
    rows = [(dt.datetime(2000, 9, 1), ("p",), tiny, [(tiny,), (2 * tiny,), (None,), (tiny,)])] * 2
    df = load_billing(spark.createDataFrame(rows, "usage_start_time timestamp, project struct<id:string>, "
                                                  "cost decimal(38,9), credits array<struct<amount:decimal(38,9)>>"))
    assert df.select(S.CREDITS_SUM_AMOUNT).first()[0] == 4 * tiny
    cube = monthly_costs(df).first()
    assert cube[S.ALL_CREDITS_TOTAL] == 8 * tiny and cube[S.FINAL_COST] == 10 * tiny
    assert cube[S.FINAL_COST_FIRST_CREDIT] == 4 * tiny
