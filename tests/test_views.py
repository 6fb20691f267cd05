import datetime as dt

from conftest import SF_SMALL
from spendlens import schema as S
from spendlens.operators.report import projects
from spendlens.plans.views import projects_sql, register_views
from spendlens.sources import fixtures

AS_OF = dt.date(2000, 9, 17)


def _rows(df):
    return sorted(df.collect(), key=lambda r: (r[0] is None, r[0] or ""))


def test_sql_views_equal_dataframe_api(spark):
    billing = fixtures.billing(spark, SF_SMALL)
    dim = fixtures.project_dim(spark, SF_SMALL)
    views = register_views(billing, AS_OF, dim=dim, carbon=fixtures.carbon(spark, SF_SMALL))
    assert set(views) == {"billing", "monthly", "report", "org_units", "carbon_report"}
    n_ids = spark.sql(f"SELECT count(*) FROM {views['report']}").first()[0]
    assert n_ids == billing.select("project.id").distinct().count()
    units = spark.sql(f"SELECT level, count(*) AS n FROM {views['org_units']} GROUP BY level").collect()
    assert {r["level"] for r in units} == {"department", "branch", "directorate"}


def test_projects_sql_binds_ids(spark):
    billing = fixtures.billing(spark, SF_SMALL)
    ids = [r[0] for r in billing.select("project.id").distinct().where("id IS NOT NULL").limit(3).collect()]
    got = projects_sql(billing, ids + ["nope", "x' OR '1'='1"], AS_OF)
    want = projects(billing, ids + ["nope"], AS_OF)
    assert _rows(got.select(want.columns)) == _rows(want)
    assert projects_sql(billing, [], AS_OF).count() == 0
    assert S.LAST_SIX_MONTHS in got.columns
