"""Id filter, to-date split, nested pages, unit tree, requests of several root fields, observed checks, running totals."""

import datetime as dt
import decimal
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendlens import schema as S
from spendlens.operators import estimates, org
from spendlens.operators.carbon import carbon_report
from spendlens.operators.checks import CHECKS, checked_report
from spendlens.operators.project_details import project_details
from spendlens.operators.report import all_projects, cube_cost_report, project, project_cost_report, projects, select_fields
from spendlens.operators.request import RootField, answer, plan_request, shared_cube
from spendlens.plans import inspect
from spendlens.sources import billing as source
from spendlens.sources import cube_store, fixtures, running_totals
from spendlens.streaming import cube_refresh

AS_OF = dt.date(2000, 9, 17)


def rows(df):
    return sorted(df.collect(), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def billing(spark):
    return fixtures.billing(spark, SF_SMALL)


@pytest.fixture(scope="module")
def dim(spark):
    return fixtures.project_dim(spark, SF_SMALL)


@pytest.fixture(scope="module")
def carbon(spark):
    return fixtures.carbon(spark, SF_SMALL)


def ids_table(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "project_id string")


# --- id tables ------------------------------------------------------------------

def test_id_filter_is_below_the_first_aggregate(spark, billing):
    df = projects(billing, ids_table(spark, ["1", "2", None, "nope", "2"]), AS_OF)
    tree = inspect.plan_text(df, "formatted").split("\n\n", 1)[0].splitlines()
    scans = [i for i, x in enumerate(tree) if "Scan parquet" in x]
    for i in scans:  # upwards from each scan of the export: both cells before any aggregate
        above = []
        depth = len(tree[i]) - len(tree[i].lstrip(" :+-*"))
        for line in reversed(tree[:i]):
            at = len(line) - len(line.lstrip(" :+-*"))
            if at < depth:
                above.append(line.strip(" :+-*").split(" (")[0])
                depth = at
        aggregate = next(k for k, x in enumerate(above) if "HashAggregate" in x)
        assert above[:aggregate].count("BroadcastHashJoin LeftSemi BuildRight") == source.ID_HASHES, above
    assert len(scans) == 2


@pytest.mark.parametrize("cells", [1, 3, 1 << 18])
def test_false_positives_never_reach_the_result(spark, billing, monkeypatch, cells):
    monkeypatch.setattr(source, "ID_CELLS", cells)
    ids = ["1", "2", "5", "no such project", None]
    table = ids_table(spark, ids)
    assert rows(projects(billing, table, AS_OF)) == rows(projects(billing, [i for i in ids if i], AS_OF))
    kept = {r[0] for r in source.may_be_listed(billing, table).select("project.id").distinct().collect()}
    assert {"1", "2", "5"} <= kept and None not in kept
    if cells == 1 << 18:
        assert kept == {"1", "2", "5"}
    assert projects(billing, table.limit(0), AS_OF).count() == 0


# --- estimates in the report's own scans ------------------------------------------

@pytest.mark.parametrize("as_of", [AS_OF, dt.date(2000, 3, 31), dt.date(2000, 4, 1), dt.date(2001, 12, 30), dt.date(1995, 5, 31)])
def test_one_pass_estimates_equal_two_passes(billing, carbon, as_of):
    for one, two, report, data in ((estimates.cost_report_with_estimates, estimates.cost_estimates, project_cost_report, billing),
                                   (estimates.carbon_report_with_estimates, estimates.carbon_estimates, carbon_report, carbon)):
        got = one(data, as_of)
        assert rows(got.select(*report(data, as_of).columns)) == rows(report(data, as_of))
        names = [S.CURRENT_FISCAL_ESTIMATED, S.CURRENT_CALENDAR_ESTIMATED]
        guessed = {r[0]: tuple(r[1:]) for r in two(data, as_of).select(S.PROJECT_ID, *names).collect()}
        assert {r[0]: tuple(r[1:]) for r in got.select(S.PROJECT_ID, *names).collect()} == {
            r[0]: guessed.get(r[0], (None, None)) for r in got.collect()}


def test_details_with_estimates_scan_no_more(billing, carbon, dim):
    plain, guess = (inspect.scan_count(project_details(billing, AS_OF, dim, carbon, estimates=e)) for e in (False, True))
    assert plain == guess
    with pytest.raises(ValueError):
        estimates.cost_report_with_estimates(cube_store.materialize_costs(billing), AS_OF)


# --- nested projects and units ------------------------------------------------------

@pytest.mark.parametrize("level, name, size", [("directorate", None, 1), ("department", None, 3), ("branch", "NATION_7", 2),
                                               ("department", "no such unit", 3), ("department", None, 1000)])
def test_pages_hold_every_project_once(billing, dim, level, name, size):
    pages = org.unit_project_pages(billing, dim, level, AS_OF, name, page_size=size).collect()
    flat = {r.id: (r.classification, r.costs) for p in pages for r in p.projects}
    assert len(flat) == sum(len(p.projects) for p in pages)
    expected = [r for r in org.org_projects(billing, dim, AS_OF).collect() if name in (None, r[level])]
    assert set(flat) == {r.project_id for r in expected}
    costs = {r.project_id: r for r in all_projects(billing, AS_OF).collect()}
    for r in expected:
        assert flat[r.project_id][0] == r.classification
        assert all(flat[r.project_id][1][m] == costs[r.project_id][m] for m in S.REPORT_FIELDS)
    units = {}
    for p in pages:
        units.setdefault((p.parent_department, p.parent_branch, p.name), []).append(p)
    for mine in units.values():
        mine.sort(key=lambda p: p.page)
        assert [p.page for p in mine] == list(range(1, len(mine) + 1)) and {p.pages for p in mine} == {len(mine)}
        assert all(len(p.projects) == size for p in mine[:-1])
        ids = [r.id for p in mine for r in p.projects]
        assert ids == sorted(ids)
    with pytest.raises(ValueError):
        org.unit_project_pages(billing, dim, level, AS_OF, page_size=0)


def test_a_directorate_of_several_pages(spark):
    day = dt.datetime(2000, 9, 1)
    lines = spark.createDataFrame([(day, (f"p{k:03}",), 1.0, 0.0) for k in range(25)],
                                  "usage_start_time timestamp, project struct<id:string>, cost double, credits_sum_amount double")
    dim = spark.createDataFrame([(f"p{k:03}", "PROTECTED_A", "d", "D", "b", "B", "x", "X" if k else "W") for k in range(25)],
                                S.PROJECT_DIM_SCHEMA)
    pages = sorted(org.unit_project_pages(lines, dim, "directorate", AS_OF, page_size=10).collect(), key=lambda p: p.page)
    assert [(p.page, p.pages, len(p.projects), p.acronym) for p in pages] == [(1, 3, 10, "W"), (2, 3, 10, "W"), (3, 3, 5, "W")]


def test_tree_links_both_ways(spark):
    listed = [("1", "d", "b1", "x"), ("2", "d", "b1", "y"), ("3", "d", "b2", "x"), ("4", "e", "b1", None), ("5", "e", None, None),
              ("6", None, "q", "r"), ("7", "d", "b1", "x")]
    dim = spark.createDataFrame([(i, None, d, d and d.upper(), b, b and b.upper(), x, x and x.upper() + i) for i, d, b, x in listed],
                                S.PROJECT_DIM_SCHEMA)
    tree = {r.name: r for r in org.department_tree(dim).collect()}
    assert set(tree) == {"d", "e"}
    for r in tree.values():
        assert [x for b in r.branches for x in b.directorates] == list(r.directorates)
        assert all(b.department == r.name for b in r.branches)
        assert all(x.branch == b.name and x.department == r.name for b in r.branches for x in b.directorates)
    assert [(b.name, b.acronym, [x.name for x in b.directorates]) for b in tree["d"].branches] == [
        ("b1", "B1", ["x", "y"]), ("b2", "B2", ["x"])]
    assert tree["d"].directorates[0].acronym == "X1" and tree["e"].branches[0].directorates == []


# --- requests of several root fields --------------------------------------------------

REQUEST = {
    "month": RootField("allProjects", (S.CURRENT_MONTH, S.MONTH_DELTA)),
    "two": RootField("projects", (S.PREVIOUS_FISCAL_YEAR, S.LAST_SIX_MONTHS), ["1", "2", "nope"]),
    "guess": RootField("project", (S.CURRENT_CALENDAR_ESTIMATED,), "3"),
}


def test_request_is_one_scan_of_the_needed_columns(spark, billing, dim):
    cube = shared_cube(billing, REQUEST, AS_OF)
    assert inspect.scan_count(cube) == 1 and inspect.shuffle_count(cube) == 1
    answers = answer(billing, REQUEST, AS_OF)
    for df in answers.values():  # from the stored cube alone
        text = inspect.plan_text(df)
        assert "l_shipdate" not in text and inspect.scan_count(df) == 1
    limited = shared_cube(billing, {k: REQUEST[k] for k in ("two", "guess")}, AS_OF)
    assert {"1", "2", "3"} == {r[0] for r in limited.select(S.PROJECT_ID).distinct().collect()}
    units = {"u": RootField("department", (S.CURRENT_MONTH,), name="AMERICA")}
    assert "LeftSemi" in inspect.plan_text(shared_cube(billing, units, AS_OF, dim))


def test_plan_is_the_union_of_what_is_asked():
    plan = plan_request(REQUEST, AS_OF)
    assert plan.ids is None and plan.to_date and not plan.from_tables
    assert plan.months == ((dt.date(1999, 4, 1), dt.date(2001, 1, 1)),)
    apart = plan_request({"a": RootField("projects", (S.PREVIOUS_CALENDAR_YEAR,), ["b", "a"]),
                          "b": RootField("project", (S.CURRENT_MONTH,), "a")}, AS_OF)
    assert apart.ids == ("b", "a") and not apart.to_date
    assert apart.months == ((dt.date(1999, 1, 1), dt.date(2000, 1, 1)), (dt.date(2000, 9, 1), dt.date(2000, 10, 1)))
    assert plan_request({"t": RootField("department", ("totalCloudSpend",), name="x")}, AS_OF).months is None


@pytest.mark.parametrize("flavour, as_of", [("api", AS_OF), ("raw", dt.date(2000, 1, 15))])
def test_answers_equal_the_entry_points(spark, billing, dim, flavour, as_of):
    table = ids_table(spark, ["4", "5", "nope", None])
    request = REQUEST | {
        "table": RootField("projects", (S.CURRENT_FISCAL_YEAR, S.FISCAL_DELTA), table),
        "ids only": RootField("allProjects", ()),
        "unit": RootField("department", ("totalCloudSpend", S.CURRENT_FISCAL_YEAR, "projectCount"), name="AMERICA"),
        "branch": RootField("branch", (S.LAST_SIX_MONTHS, S.CURRENT_FISCAL_ESTIMATED), name="NATION_7"),
    }
    # All together, without those that need every project or all history, and single ones.
    some = ("two", "guess"), ("table", "branch"), ("month",)
    for names in (tuple(request), *(some if flavour == "raw" else ())):
        check(billing, dim, {k: request[k] for k in names}, as_of, flavour, table)


def check(billing, dim, request, as_of, flavour, table):
    got = answer(billing, request, as_of, dim, flavour)
    assert list(got) == list(request)
    for alias, df in got.items():
        field = request[alias]
        if field.entry == "allProjects":
            want = all_projects(billing, as_of, flavour)
        elif field.entry == "projects":
            want = projects(billing, field.ids, as_of, flavour)
        elif field.entry == "project":
            want = project(billing, field.ids, as_of, flavour)
            more = estimates.cost_estimates(billing, as_of).select(S.PROJECT_ID, S.CURRENT_CALENDAR_ESTIMATED)
            want = want.join(more, S.PROJECT_ID, "left")
        else:
            want = org.unit(billing, dim, field.entry, field.name, as_of)
            more = estimates.org_estimates(billing, dim, as_of, [field.entry]).select("name", S.CURRENT_FISCAL_ESTIMATED)
            want = want.join(more, "name", "left")
        keys = org.UNIT_COLUMNS if field.entry in S.ORG_LEVELS else (S.PROJECT_ID,)
        assert rows(df) == rows(want.select(*keys, *field.fields)), alias


def test_odd_requests(billing, dim):
    assert answer(billing, {}, AS_OF) == {}
    for bad in (RootField("owner", ()), RootField("allProjects", ("projectCount",)), RootField("department", ()),
                RootField("project", (), None), RootField("projects", ("nothing",), ["1"])):
        with pytest.raises(ValueError):
            answer(billing, {"a": bad}, AS_OF, dim)
    with pytest.raises(ValueError):
        answer(billing, {"a": RootField("department", (), name="x")}, AS_OF)
    assert answer(billing, {"a": RootField("projects", (S.CURRENT_MONTH,), [])}, AS_OF)["a"].count() == 0


# --- checks in the report's pass --------------------------------------------------------

def test_observed_checks_equal_separate_queries(spark, billing, dim):
    n = F.col(S.PROJECT_ID).cast("long")
    bad = fixtures.bad_classes_dim(dim)
    bad = bad.where(n % 10 != 3).unionByName(bad.where(n % 10 == 4))
    report, checks = checked_report(billing, bad, AS_OF)
    plain = project_cost_report(billing, AS_OF, prune_history=False)
    assert inspect.scan_count(report) == inspect.scan_count(plain) + inspect.scan_count(bad)
    got = rows(report.select(S.PROJECT_ID, *S.REPORT_FIELDS))
    assert got == rows(all_projects(billing, AS_OF).select(S.PROJECT_ID, *S.REPORT_FIELDS))
    found = checks.metrics()
    assert tuple(found) == CHECKS
    assert found["invalid_classifications"] == org.invalid_classification(bad).count()
    assert found["duplicate_projects"] == org.duplicate_projects(bad).count()
    owners = org.project_owner(billing, bad)
    assert found["projects_without_dimension"] == owners.where("project_id is not null and owner is null").count() > 0
    spend = billing.where("project.id is null").agg((F.sum(S.COST) + F.sum(S.CREDITS_SUM_AMOUNT)).cast("double")).first()[0]
    assert found["null_project_spend"] == spend
    empty, none = checked_report(billing.limit(0), bad.limit(0), AS_OF)
    assert empty.count() == 0


# --- id table and running totals of a store ------------------------------------------------

def late_store(billing, path):
    """A store of three batches, the last one late, and all its lines."""
    year = F.year(S.USAGE_START_TIME)
    late = billing.where((year == 1996) & (F.month(S.USAGE_START_TIME) == 5) & (F.col("project.id").isin("1", "2")))
    batches = [billing.where(year <= 1999), billing.where(year > 1999), late]
    for k, part in enumerate(batches):
        cube_refresh.write_batch(part, k, path, "run")
        yield k
    return


def test_report_reads_its_months_and_the_id_table(spark, billing, tmp_path):
    path = str(tmp_path / "store")
    for _ in late_store(billing, path):
        pass
    cube = cube_store.read_cube(spark, path)
    got = cube_store.stored_report(spark, path, AS_OF)
    assert rows(got) == rows(cube_cost_report(cube, AS_OF))
    unrun = cube_store.stored_report(spark, path, AS_OF)
    text = inspect.plan_text(unrun)
    assert inspect.scan_count(unrun) == 2 and len(re.findall(r"Location: InMemoryFileIndex.*/_ids\]", text)) == 1
    assert "(year#" in text and ">= 1999)" in text and "<= 2001)" in text
    assert any("GreaterThanOrEqual(month,1999-01-01)" in f and "LessThan(month,2001-04-01)" in f for f in inspect.pushed_filters(unrun))
    spans = {r[0]: (r[1], r[2]) for r in cube_store.read_project_ids(spark, path).collect()}
    real = {r[0]: (r[1], r[2]) for r in cube.groupBy(S.PROJECT_ID).agg(F.min(S.MONTH), F.max(S.MONTH)).collect()}
    assert spans == real
    folded = cube_store.compact(spark, path, str(tmp_path / "folded"))
    assert rows(cube_store.stored_report(spark, folded, AS_OF)) == rows(got)
    # A batch written again leaves the id table as it was.
    cube_refresh.write_batch(billing.where(F.year(S.USAGE_START_TIME) > 1999), 1, path, "run")
    assert {r[0]: (r[1], r[2]) for r in cube_store.read_project_ids(spark, path).collect()} == real


def test_running_totals_equal_the_cube_after_late_batches(spark, billing, tmp_path):
    path = str(tmp_path / "store")
    for k in late_store(billing, path):
        if k == 0:
            running_totals.write_running_totals(spark, path)
        else:
            running_totals.refresh_running_totals(spark, path, "run", k)
        for as_of in (AS_OF, dt.date(1996, 6, 30)):
            assert rows(running_totals.running_report(spark, path, as_of)) == rows(cube_cost_report(
                cube_store.read_cube(spark, path), as_of)), (k, as_of)
    # A report depends on the month of its date; three years of them, with both sides of January and April.
    cube = cube_store.read_cube(spark, path).cache()
    for n in (0, 2, 3, 11, 12, 14, 17, 23, 24, 27, 30, 35):
        as_of = dt.date(1999 + n // 12, n % 12 + 1, 1 + n % 28)
        assert rows(running_totals.running_report(spark, path, as_of)) == rows(cube_cost_report(cube, as_of)), as_of
    cube.unpersist()
    money = running_totals.read_running_totals(spark, path).schema[running_totals.TOTAL].dataType
    assert money.simpleString().startswith("decimal")
    running_totals.write_running_totals(spark, path)
    assert running_totals.read_running_totals(spark, path).select("version").distinct().count() == 1
    text = inspect.plan_text(running_totals.running_report(spark, path, AS_OF))
    assert "month" in text and "In(month" in " ".join(inspect.pushed_filters(running_totals.running_report(spark, path, AS_OF)))


def test_running_totals_keep_null_months(spark, tmp_path):
    schema = "usage_start_time timestamp, project struct<id:string>, cost decimal(12,2), credits_sum_amount decimal(18,4)"
    one = decimal.Decimal("1.10")
    lines = [(dt.datetime(2000, 8, 1), ("a",), one, None), (dt.datetime(2000, 7, 1), ("a",), one, -one), (dt.datetime(2000, 5, 1), ("a",), one, None),
             (dt.datetime(2000, 5, 2), ("a",), one, one), (dt.datetime(2002, 1, 1), ("b",), one, one), (dt.datetime(2000, 8, 1), (None,), one, one)]
    path = cube_store.write_cube(spark.createDataFrame(lines, schema), str(tmp_path / "store"))
    running_totals.write_running_totals(spark, path)
    for as_of in (AS_OF, dt.date(2000, 8, 5), dt.date(2001, 2, 1), dt.date(2003, 1, 1), dt.date(1990, 1, 1)):
        assert rows(running_totals.running_report(spark, path, as_of)) == rows(cube_store.stored_report(spark, path, as_of)), as_of
