"""The driver's gate, locally: every registered query equals its DuckDB SQL."""

import pytest

import __spark_entry__ as entry_module
from compare import compare
from conftest import SF_GATE, SF_SMALL

QUERIES = entry_module.catalog.queries()
SQL = entry_module.catalog.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(entry_module.queries())


def test_a_file_added_later_is_read(spark, tmp_path):
    part = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").limit(100)
    part.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert QUERIES["billing_scan"](spark, str(tmp_path)).count() == 100
    part.write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert QUERIES["billing_scan"](spark, str(tmp_path)).count() == 200


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    result = compare(QUERIES[name](spark, SF_GATE), SQL[name], SF_GATE)
    assert result["ok"], result


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "project_id" and "lastSixMonths" in df.columns
    assert df.count() > 0
    result = compare(df, entry_module.catalog.REGISTRY["all_projects_api"].sql, SF_SMALL)
    assert result["ok"], result
