"""Incremental cube: batches, replays and late files give the batch cube."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendlens import schema as S
from spendlens.operators.monthly import monthly_costs
from spendlens.operators.report import cube_cost_report, project_cost_report
from spendlens.plans import inspect
from spendlens.sources import cube_store, fixtures
from spendlens.streaming import cube_refresh


def _rows(df):
    cols = [S.MONTH, S.PROJECT_ID, S.FINAL_COST_NO_CREDITS, S.FIRST_CREDIT_TOTAL, S.ALL_CREDITS_TOTAL,
            S.FINAL_COST_FIRST_CREDIT, S.FINAL_COST]
    return sorted(tuple(r) for r in df.select(*cols).fillna("<null>", [S.PROJECT_ID]).collect())


@pytest.fixture(scope="module")
def billing(spark):
    return fixtures.billing(spark, SF_SMALL)


def _land(billing, folder, name, cond):
    billing.where(cond).coalesce(1).write.parquet(os.path.join(folder, name))


def test_stream_batches_replay_and_late_file(spark, billing):
    root = tempfile.mkdtemp(prefix="spendlens-stream-")
    src = os.path.join(root, "landing")
    os.makedirs(src)
    year = F.year(S.USAGE_START_TIME)
    _land(billing, src, "part-a", year <= 1996)
    _land(billing, src, "part-b", (year > 1996) & (year <= 1999))
    store, ckpt = cube_refresh.refresh_paths(root)

    def run():
        stream = cube_refresh.billing_stream(spark, os.path.join(src, "*"), billing.schema, max_files_per_trigger=1)
        q = cube_refresh.start_cube_refresh(stream, store, ckpt)
        q.awaitTermination()
        assert q.exception() is None

    run()
    early = billing.where(year <= 1999)
    assert _rows(cube_store.read_cube(spark, store)) == _rows(monthly_costs(early))
    assert spark.read.parquet(store).select(cube_store.RUN_ID, cube_store.BATCH_ID).distinct().count() == 2

    # Replaying batch 0 rewrites its partitions instead of adding to them.
    cube_refresh.write_batch(billing.where(year <= 1996), 0, store, cube_refresh.run_id_of(spark, ckpt))
    assert _rows(cube_store.read_cube(spark, store)) == _rows(monthly_costs(early))

    # A later file, including lines for months already stored, after a restart.
    _land(billing, src, "part-c", year > 1999)
    late = billing.where((year == 1996) & (F.month(S.USAGE_START_TIME) == 5))
    late.coalesce(1).write.parquet(os.path.join(src, "part-d-late"))
    run()
    expected = monthly_costs(billing.unionByName(late))
    assert _rows(cube_store.read_cube(spark, store)) == _rows(expected)


def test_report_from_stored_cube_equals_direct_report(spark, billing):
    as_of = dt.date(2000, 9, 17)
    cube = cube_store.materialize_costs(billing)
    direct = project_cost_report(billing, as_of)
    stored = cube_cost_report(cube, as_of)
    key = lambda r: (r[0] is None, r[0] or "")
    assert sorted(stored.collect(), key=key) == sorted(direct.collect(), key=key)
    text = inspect.plan_text(cube_cost_report(cube, as_of))
    assert "(year#" in text and ">= 1999)" in text and "<= 2001)" in text
    assert any("GreaterThanOrEqual(month,1999-01-01)" in f and "LessThan(month,2001-04-01)" in f
               for f in inspect.pushed_filters(cube_cost_report(cube, as_of)))


def test_compact_keeps_the_cube(spark, billing):
    path = cube_store.write_cube(billing, cube_store.new_store_path(spark))
    compacted = cube_store.compact(spark, path)
    assert _rows(cube_store.read_cube(spark, compacted)) == _rows(cube_store.read_cube(spark, path))


def test_lost_checkpoint_adds_and_compaction_goes_on(spark, tmp_path):
    def land(name, cost):
        spark.createDataFrame([(dt.datetime(2000, 9, 1), ("p",), cost, 0.0)], schema).write.parquet(str(tmp_path / name / "f"))

    schema = "usage_start_time timestamp, project struct<id:string>, cost double, credits_sum_amount double"
    store = str(tmp_path / "store")

    def refresh(landing, checkpoint, target):
        stream = cube_refresh.billing_stream(spark, str(tmp_path / landing / "*"), spark.createDataFrame([], schema).schema)
        query = cube_refresh.start_cube_refresh(stream, target, str(tmp_path / checkpoint))
        query.awaitTermination()
        assert query.exception() is None

    def total(path):
        return [r[S.FINAL_COST] for r in cube_store.read_cube(spark, path).collect()]

    land("one", 10.0)
    refresh("one", "first", store)
    land("two", 5.0)
    refresh("two", "second", store)                    # a new checkpoint starts at batch 0 again
    assert total(store) == [15.0]
    folded = cube_store.compact(spark, store, str(tmp_path / "folded"))
    assert total(folded) == [15.0]
    spark.createDataFrame([(dt.datetime(2000, 9, 2), ("p",), 1.0, 0.0)], schema).write.parquet(str(tmp_path / "one" / "g"))
    refresh("one", "first", folded)                    # the old checkpoint goes on, on the folded store
    assert total(folded) == [16.0]
    assert cube_store.read_partials(spark, folded).count() == 2
    cube_store.drop_store(spark, store)
    with pytest.raises(ValueError):
        cube_store.read_cube(spark, store)


def test_empty_export_gives_an_empty_store(spark, billing):
    cube = cube_store.materialize_costs(billing.limit(0))
    assert cube.count() == 0 and dict(cube.dtypes)[S.MONTH] == "date"
    assert cube_cost_report(cube, dt.date(2000, 9, 17)).count() == 0


def test_refresh_rejects_batch_input(spark, billing):
    with pytest.raises(ValueError):
        cube_refresh.start_cube_refresh(billing, "/nonexistent", "/nonexistent")


def test_every_report_from_one_stored_cube(spark, billing):
    from spendlens.operators import org
    from spendlens.operators.report import all_projects, projects
    from spendlens.operators.suite import spend_reports

    dim = fixtures.project_dim(spark, SF_SMALL)
    as_of = dt.date(2000, 9, 17)
    reports = spend_reports(billing, as_of, dim=dim, carbon=fixtures.carbon(spark, SF_SMALL))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(reports["projects"].collect(), key=key) == sorted(all_projects(billing, as_of).collect(), key=key)
    assert sorted(reports["org_spend_rollup"].collect(), key=key) == \
        sorted(org.org_spend_rollup(billing, dim).collect(), key=key)
    assert sorted(reports["org_units"].collect(), key=key) == \
        sorted(org.org_units(billing, dim, as_of, carbon=fixtures.carbon(spark, SF_SMALL)).collect(), key=key)
    cube = cube_store.materialize_costs(billing)
    ids = ["1", "2", "nope"]
    assert sorted(projects(cube, ids, as_of).collect(), key=key) == sorted(projects(billing, ids, as_of).collect(),
                                                                          key=key)
    assert "carbon_report" in reports and "classification_spend" in reports


def test_single_periods_from_a_stored_cube(spark, billing):
    from spendlens.operators.report import billing_period_total

    cube = cube_store.materialize_costs(billing)
    as_of = dt.date(2000, 1, 15)
    for period in ("current_month", "previous_fiscal_year", "current_calendar_year"):
        a = {r[0]: r[1] for r in billing_period_total(cube, as_of, period).collect()}
        b = {r[0]: r[1] for r in billing_period_total(billing, as_of, period).collect()}
        assert a == b, period


def test_a_cluster_session_must_name_the_shared_folder(spark, monkeypatch):
    from spendlens import session

    monkeypatch.setattr(session, "_configured_dir", lambda s: None)
    assert session.ensure_checkpoint_dir(spark) == spark.conf.get("spark.sql.warehouse.dir")
    monkeypatch.setattr(session, "_is_local", lambda s: False)
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(spark)
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(spark)


def test_landing_files_grow_with_the_lines(spark, monkeypatch):
    """Lines of one order and of none land in files of a bounded size; four batches add up to the batch cube."""
    from spendlens.plans import catalog

    folder = tempfile.mkdtemp(prefix="spendlens-landing-")
    rows = [(7 if i % 2 else None, i, i % 5, i % 7, float(i % 9), float(i), 0.01, 0.02, "RAN"[i % 3], "O",
             dt.datetime(1995 + i % 3, 1 + i % 12, 3)) for i in range(1200)]
    spark.createDataFrame(rows, fixtures.TABLE_SCHEMAS["lineitem"]).write.parquet(os.path.join(folder, "lineitem.parquet"))
    roots = []
    monkeypatch.setattr(catalog, "FILE_LINES", 50)
    monkeypatch.setattr(catalog, "_scratch_root", lambda _: roots.append(os.path.join(folder, "run")) or roots[-1])
    got = catalog.monthly_costs_many_files(spark, folder)
    landed = spark.read.parquet(os.path.join(roots[0], "landing"))
    sizes = [r["n"] for r in landed.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 24 and sum(sizes) == 1200 and max(sizes) <= 100
    batches = spark.read.parquet(os.path.join(roots[0], "cube")).select(cube_store.BATCH_ID).distinct().count()
    assert batches == catalog.LANDING_BATCHES
    want = monthly_costs(fixtures.billing(spark, folder)).select(*[F.col(c).cast(kind) for c, kind in got.dtypes])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
