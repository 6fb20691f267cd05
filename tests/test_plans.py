"""Plan shape: scans, shuffles and what reaches the parquet reader."""

import datetime as dt
import os
import tempfile

import pytest

from conftest import SF_SMALL
from spendlens import schema as S
from spendlens.operators.report import all_projects, project_cost_report, projects, select_fields
from spendlens.plans import inspect
from spendlens.sources import fixtures

AS_OF = dt.date(2000, 9, 17)


@pytest.fixture(scope="module")
def billing(spark):
    return fixtures.billing(spark, SF_SMALL)


@pytest.fixture(scope="module")
def billing_parquet(spark, billing):
    """The fixture billing written as a real nested parquet export."""
    path = os.path.join(tempfile.mkdtemp(prefix="spendlens-billing-"), "billing")
    billing.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", ["all_projects", "org_unit_costs", "carbon_report", "project_cost_report_single_pass"])
def test_report_state_has_a_fixed_size(spark, name):
    from spendlens.plans.catalog import REGISTRY

    text = inspect.plan_text(REGISTRY[name].build(spark, SF_SMALL), "formatted")
    assert "collect_list" not in text and "ObjectHashAggregate" not in text


def test_credit_aggregates_are_generated_code(spark, billing_parquet):
    """The fold over credits stays in a projection; both aggregates above it are in whole-stage codegen."""
    from spendlens.operators.monthly import monthly_costs

    cube = monthly_costs(billing_parquet.drop(S.CREDITS_SUM_AMOUNT)).select(S.MONTH, S.PROJECT_ID, S.ALL_CREDITS_TOTAL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = [x for x in inspect.plan_text(cube, "simple").splitlines() if "HashAggregate" in x]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(lines) == 2 and all("*(" in x for x in lines), lines


def test_sql_ids_reach_the_reader(billing_parquet):
    from spendlens.plans.views import projects_sql

    spark = billing_parquet.sparkSession
    before = {t.name for t in spark.catalog.listTables()}
    df = projects_sql(billing_parquet, ["1", "2"], AS_OF)
    assert "In(project.id, [1,2])" in " ".join(inspect.pushed_filters(df))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_single_pass_report_is_one_scan_two_shuffles(billing):
    df = project_cost_report(billing, AS_OF, prune_history=False)
    assert inspect.scan_count(df) == 1
    assert inspect.shuffle_count(df) == 2


def test_pruned_report_pushes_window_and_reads_ids_only_once(billing):
    df = project_cost_report(billing, AS_OF)
    assert inspect.scan_count(df) == 2
    schemas = inspect.read_schemas(df)
    assert "struct<l_suppkey:bigint>" in schemas            # all history: id column only
    pushed = " ".join(inspect.pushed_filters(df))
    assert "GreaterThanOrEqual(l_shipdate,1999-01-01" in pushed and "LessThan(l_shipdate,2001-04-01" in pushed


def test_nested_id_filter_and_pruning_reach_parquet(billing_parquet):
    df = projects(billing_parquet, ["1", "2"], AS_OF)
    pushed = " ".join(inspect.pushed_filters(df))
    assert "In(project.id, [1,2])" in pushed
    assert "usage_start_time" in pushed
    # Only the needed leaves of the nested columns are read; the credits array is not.
    for schema in inspect.read_schemas(df):
        assert "credits:" not in schema and "name:" not in schema


def test_field_selection_prunes_measures(billing_parquet):
    one = select_fields(all_projects(billing_parquet, AS_OF, prune_history=False), [S.CURRENT_MONTH])
    tree = inspect.plan_text(one, "formatted").split("\n\n", 1)[1]
    assert "collect_list" not in tree
    assert "2000-04-01" not in tree          # no fiscal-year aggregate left


def test_no_python_in_the_plan(billing):
    text = inspect.plan_text(all_projects(billing, AS_OF), "formatted")
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
        assert node not in text


def test_credit_measures_read_only_the_amount_leaf(billing_parquet):
    from spendlens.operators.monthly import monthly_costs

    cube = monthly_costs(billing_parquet).select(S.MONTH, S.PROJECT_ID, S.ALL_CREDITS_TOTAL, S.FIRST_CREDIT_TOTAL)
    schemas = inspect.read_schemas(cube)
    assert any("credits:array<struct<amount:decimal(18,4)>>" in s for s in schemas), schemas
    assert not any("name:" in s for s in schemas)


@pytest.mark.parametrize("name", ["all_projects", "project_cost_report_single_pass", "projects_by_ids",
                                  "org_unit_costs", "department_report", "org_spend_rollup", "carbon_report",
                                  "monthly_cube", "last_six_months", "cost_estimates"])
def test_no_shuffle_moves_raw_usage_lines(spark, name):
    """Every shuffle is fed by a (partial) aggregate: a hot project or month adds at
    most one row per task to its partition, whatever its share of the data."""
    from spendlens.plans.catalog import REGISTRY

    inputs = inspect.shuffle_inputs(REGISTRY[name].build(spark, SF_SMALL))
    assert inputs, name
    assert all(op in ("HashAggregate", "ObjectHashAggregate", "SortAggregate") for op in inputs), inputs


@pytest.mark.parametrize("kind", ["usage", "export"])
def test_declared_date_partition_prunes_and_keeps_results(spark, kind):
    from pyspark.sql import functions as F

    from spendlens.sources.billing import declare_date_partition
    from test_edge_rows import ROWS, SCHEMA

    edge = spark.createDataFrame(ROWS, SCHEMA)
    day = F.to_date(S.USAGE_START_TIME)
    part = day if kind == "usage" else F.date_add(day, 3)        # exports land a few days after usage
    path = os.path.join(tempfile.mkdtemp(prefix="spendlens-part-"), "billing")
    edge.withColumn("pdate", part).write.partitionBy("pdate").parquet(path)
    stored = spark.read.parquet(path)
    declared = declare_date_partition(stored, "pdate", kind)
    text = inspect.plan_text(project_cost_report(declared, AS_OF))
    assert "PartitionFilters: [isnotnull(pdate" in text and ">= 1999-01-01)" in text
    assert ("< 2001-04-01)" in text) == (kind == "usage")
    key = lambda r: (r[0] is None, r[0] or "")
    for through in (False, True):
        assert sorted(project_cost_report(declared, AS_OF, through_as_of=through).collect(), key=key) == \
            sorted(project_cost_report(stored, AS_OF, through_as_of=through).collect(), key=key)
    with pytest.raises(ValueError):
        declare_date_partition(stored, S.USAGE_START_TIME)
