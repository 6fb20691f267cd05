import datetime as dt

import pytest

from conftest import SF_SMALL
from spendlens.operators import org
from spendlens.sources import fixtures

AS_OF = dt.date(2000, 9, 17)


@pytest.fixture(scope="module")
def billing(spark):
    return fixtures.billing(spark, SF_SMALL)


@pytest.fixture(scope="module")
def dim(spark):
    return fixtures.project_dim(spark, SF_SMALL)


def test_unknown_level_and_missing_columns(spark, billing, dim):
    with pytest.raises(ValueError):
        org.org_unit_costs(billing, dim, AS_OF, levels=["division"])
    with pytest.raises(ValueError):
        org.org_unit_costs(billing, dim.drop("branch"), AS_OF)


def test_unknown_unit_gives_no_row(billing, dim):
    assert org.department(billing, dim, "ATLANTIS", AS_OF).count() == 0


def test_children_follow_the_hierarchy(dim):
    branches = {r["name"] for r in org.children(dim, "department", "AMERICA").collect()}
    expected = {r["branch"] for r in dim.where("department = 'AMERICA'").select("branch").distinct().collect()}
    assert branches == expected and branches
    dirs = org.children(dim, "branch", sorted(branches)[0]).collect()
    assert dirs and all(r["level"] == "directorate" for r in dirs)
    with pytest.raises(ValueError):
        org.children(dim, "directorate", "x")


def test_invalid_classification_flags_bad_and_null(spark):
    dim = spark.createDataFrame(
        [("1", "PROTECTED_B"), ("2", "SECRET"), ("3", None)], "project_id string, classification string")
    for c in ("department", "department_acronym", "branch", "branch_acronym", "directorate", "directorate_acronym"):
        dim = dim.withColumn(c, dim.project_id)
    bad = sorted(r["project_id"] for r in org.invalid_classification(dim).collect())
    assert bad == ["2", "3"]


def test_unit_record_has_all_fields(spark, billing, dim):
    carbon = fixtures.carbon(spark, SF_SMALL)
    name = sorted(r["branch"] for r in dim.select("branch").distinct().collect())[0]
    rec = org.branch(billing, dim, name, AS_OF, carbon=carbon).first()
    assert rec["level"] == "branch" and rec["name"] == name
    assert rec["projectCount"] > 0 and rec["totalCloudSpend"] is not None and rec["carbonFootprint"] > 0
    assert rec["lastSixMonths"] is None or len(rec["lastSixMonths"]) <= 6


def test_duplicate_projects_flags_repeats(spark):
    cols = ("department", "department_acronym", "branch", "branch_acronym", "directorate", "directorate_acronym")
    dim = spark.createDataFrame([("1", "UNCLASSIFIED"), ("2", "UNCLASSIFIED"), ("2", "PROTECTED_A")],
                                "project_id string, classification string")
    for c in cols:
        dim = dim.withColumn(c, dim.project_id)
    assert [(r[0], r[1]) for r in org.duplicate_projects(dim).collect()] == [("2", 2)]


def test_fixture_dimension_has_no_duplicates(dim):
    assert org.duplicate_projects(dim).count() == 0


def test_numeric_dimension_ids_are_rejected(spark, billing, dim):
    from pyspark.sql import functions as F

    numeric = dim.withColumn("project_id", F.col("project_id").cast("bigint"))
    with pytest.raises(ValueError, match="must be a string"):
        org.org_unit_costs(billing, numeric, AS_OF)


def test_fixture_tables_follow_the_declared_schemas(spark, tmp_path):
    from spendlens import schema as S
    from spendlens.operators.carbon import carbon_report, read_carbon

    dim = fixtures.project_dim(spark, SF_SMALL)
    assert [(f.name, f.dataType) for f in dim.schema.fields] == \
        [(f.name, f.dataType) for f in S.PROJECT_DIM_SCHEMA.fields]
    carbon = fixtures.carbon(spark, SF_SMALL)
    assert carbon.columns == S.CARBON_SCHEMA.fieldNames()
    path = str(tmp_path / "carbon")
    carbon.write.json(path)
    loaded = read_carbon(spark, path, fmt="json")
    assert loaded.schema[S.CARBON_KG].dataType == S.CARBON_SCHEMA[S.CARBON_KG].dataType
    key = lambda r: (r[0] is None, r[0] or "")
    got = sorted(carbon_report(loaded, AS_OF).collect(), key=key)
    want = sorted(carbon_report(carbon, AS_OF).collect(), key=key)
    assert [r[0] for r in got] == [r[0] for r in want]
    for a, b in zip(got, want):
        assert all((x is None and y is None) or abs(x - y) < 1e-6 for x, y in zip(a[1:-1], b[1:-1]))
        assert (a[-1] is None) == (b[-1] is None) and (a[-1] is None or a[-1] == pytest.approx(b[-1]))


DIM_COLUMNS = ("project_id string, classification string, department string, department_acronym string, branch string, "
               "branch_acronym string, directorate string, directorate_acronym string")


def _spend(spark, *rows):
    day = dt.datetime(2000, 9, 3)
    return spark.createDataFrame([(day, (pid,), cost, 0.0) for pid, cost in rows],
                                 "usage_start_time timestamp, project struct<id:string>, cost double, credits_sum_amount double")


def test_units_that_share_a_name_stay_apart(spark):
    billing = _spend(spark, ("p", 10.0), ("q", 5.0))
    dim = spark.createDataFrame([("p", "UNCLASSIFIED", "D1", "d1", "B1", "b1", "Corporate", "CS"),
                                 ("q", "UNCLASSIFIED", "D2", "d2", "B2", "b2", "Corporate", "CS")], DIM_COLUMNS)
    rows = {r["parent_branch"]: r for r in org.directorate(billing, dim, "Corporate", AS_OF).collect()}
    assert {b: (r["parent_department"], r["currentMonthToDate"], r["projectCount"], r["totalCloudSpend"])
            for b, r in rows.items()} == {"B1": ("D1", 10.0, 1, 10.0), "B2": ("D2", 5.0, 1, 5.0)}
    assert {r["project_id"] for r in org.unit_projects(billing, dim, "directorate", "Corporate", AS_OF).collect()} == {"p", "q"}
    below = org.children(dim, "department", "D2", "directorate").collect()
    assert [tuple(r) for r in below] == [("directorate", "Corporate", "CS", "D2", "B2")]


def test_null_acronyms_and_repeated_projects_keep_the_money(spark):
    billing = _spend(spark, ("p", 10.0), (None, 99.0), ("unlisted", 7.0))
    row = ("p", "UNCLASSIFIED", "D1", None, "B1", None, "R1", None)
    for dim in ([row], [row, row], [row, ("p", "UNCLASSIFIED", "D2", "d2", "B2", "b2", "R2", "r2")]):
        dim = spark.createDataFrame(dim, DIM_COLUMNS)
        units = org.org_units(billing, dim, AS_OF).collect()
        assert len(units) == 3
        assert {(r["name"], r["acronym"], r["currentMonthToDate"], r["projectCount"], r["totalCloudSpend"]) for r in units} \
            == {(n, None, 10.0, 1, 10.0) for n in ("D1", "B1", "R1")}
        grand = org.org_spend_rollup(billing, dim).where("grouping_level = 7").first()
        assert (grand["projectCount"], grand["totalCloudSpend"]) == (1, 10.0)


def test_one_scan_and_a_semi_join_for_a_named_unit(spark, dim, tmp_path):
    from spendlens.plans import inspect

    path = str(tmp_path / "export")
    fixtures.billing(spark, SF_SMALL).write.parquet(path)
    own = str(tmp_path / "dim")
    dim.write.parquet(own)
    df = org.department(spark.read.parquet(path), spark.read.parquet(own), "AMERICA", AS_OF)
    schemas = inspect.read_schemas(df)
    assert sum("cost" in s for s in schemas) == 1
    tree = inspect.plan_text(df, "formatted").split("\n\n", 1)[0].splitlines()
    semi = next(i for i, x in enumerate(tree) if "LeftSemi" in x)
    aggregates = [i for i, x in enumerate(tree) if "HashAggregate" in x and i < semi]
    assert aggregates and not any("Exchange (" in x and "Broadcast" not in x for x in tree[max(aggregates):semi])
    assert "cost" in " ".join(s for s in schemas)
