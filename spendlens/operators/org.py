"""Organisational roll-ups: department > branch > directorate.

The original API declares these (department / branch / directorate queries,
``projectCount``, ``totalCloudSpend``, unit ``costs`` and ``projects``,
``classification``, ``owner``) but never computes them, so the definitions
here are this project's own:

* a unit is its full path: directorates of one name in two branches are two
  units, each with its own parents; the acronym is an attribute (the least one
  where the dimension has several), never a key;
* a unit's spend is the sum of its projects' spend, and its report adds up the
  projects' period sums, so deltas come from summed totals (never averaged
  percentages);
* ``projectCount`` counts the unit's projects that have billing rows, and only
  units with one are listed;
* ``totalCloudSpend`` sums the whole history;
* the null project and projects missing from the dimension belong to no unit;
* a project listed more than once in the dimension belongs to its least row
  (by classification, department, branch and directorate in the schema's
  order), so its money counts once; ``duplicate_projects`` lists them.

Every ``billing`` argument may also be an already aggregated monthly cost cube
(``cube_store.read_cube``).  The export is reduced to one row per project in
one scan: period sums, all-history total and the fact that it was billed.  That
table meets the memberships (one row per project and level) once and is added
up per unit.  A report on a named unit keeps that unit's projects by a
semi-join before anything is aggregated.  No broadcast is forced: the optimizer
and AQE pick the joins from measured sizes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens import schema as S
from spendlens.functions.calendar import ReportCalendar
from spendlens.functions.measures import as_double
from spendlens.operators.monthly import billed_project_ids, cost_cube, cube_window, is_cost_cube
from spendlens.operators.periods import add_up, finish, period_sums
from spendlens.operators.report import api_flavour, costs_struct, project_cost_report
from spendlens.sources.billing import load_billing, project_id_col, usage_before, usage_between

#: What identifies a unit: its level and path (null below its own level).
UNIT_KEYS = ("level", *S.ORG_LEVELS)
#: How a unit is shown.
UNIT_COLUMNS = ("level", "name", "acronym", "parent_department", "parent_branch")
_LEVEL_COLUMNS = [c for pair in S.ORG_LEVELS.values() for c in pair]


def validate_dim(dim: DataFrame) -> None:
    """The dimension needs the id, classification and level columns, with a
    string ``project_id`` (export ids are strings; a numeric key would make the
    join coerce every export id to a number)."""
    missing = [c for c in S.PROJECT_DIM_SCHEMA.fieldNames() if c not in dim.columns]
    if missing:
        raise ValueError(f"project dimension lacks columns {missing}")
    id_type = dim.schema[S.PROJECT_ID].dataType
    if not isinstance(id_type, T.StringType):
        raise ValueError(f"project dimension's {S.PROJECT_ID} must be a string, got {id_type.simpleString()}; "
                         f"cast it, e.g. dim.withColumn('{S.PROJECT_ID}', F.col('{S.PROJECT_ID}').cast('string'))")


def project_dimension(dim: DataFrame) -> DataFrame:
    """The dimension with one row per project (the least one), rows without an id left out."""
    validate_dim(dim)
    rest = [c for c in S.PROJECT_DIM_SCHEMA.fieldNames() if c != S.PROJECT_ID]
    return (dim.where(F.col(S.PROJECT_ID).isNotNull()).groupBy(S.PROJECT_ID)
            .agg(F.min(F.struct(*rest)).alias("_row")).select(S.PROJECT_ID, "_row.*"))


def _levels(levels: Sequence[str] | None) -> list[str]:
    levels = list(S.ORG_LEVELS) if levels is None else list(levels)
    unknown = [lv for lv in levels if lv not in S.ORG_LEVELS]
    if unknown:
        raise ValueError(f"unknown organisational levels {unknown}; expected some of {list(S.ORG_LEVELS)}")
    return levels


def unit_memberships(dim: DataFrame, levels: Sequence[str] | None = None) -> DataFrame:
    """(project_id, level, department, branch, directorate, acronym): one row per project and level."""
    order = list(S.ORG_LEVELS)
    units = []
    for level in _levels(levels):
        path = [F.col(lv) if order.index(lv) <= order.index(level) else F.lit(None).cast("string") for lv in order]
        units.append(F.struct(F.lit(level).alias("level"), *[c.alias(lv) for c, lv in zip(path, order)],
                              F.col(S.ORG_LEVELS[level][1]).alias("acronym")))
    return (project_dimension(dim).select(S.PROJECT_ID, F.explode(F.array(*units)).alias("_u"))
            .select(S.PROJECT_ID, "_u.*"))


def _shown() -> list[Column]:
    """``UNIT_COLUMNS`` from the key columns and the acronym."""
    level = F.col("level")
    name = F.when(level == "department", F.col("department")).when(level == "branch", F.col("branch")).otherwise(
        F.col("directorate"))
    return [level, name.alias("name"), F.col("acronym"),
            F.when(level != "department", F.col("department")).alias("parent_department"),
            F.when(level == "directorate", F.col("branch")).alias("parent_branch")]


def _per_unit(members: DataFrame, project_rows: DataFrame, aggs: Sequence[Column]) -> DataFrame:
    """Unit rows (keys, acronym, ``aggs``) over the project rows of each unit's members."""
    return members.join(project_rows, on=S.PROJECT_ID, how="inner").groupBy(*UNIT_KEYS).agg(
        F.min("acronym").alias("acronym"), *aggs)


def _known(cube: DataFrame) -> DataFrame:
    return cube.where(F.col(S.PROJECT_ID).isNotNull())


def _until(billing: DataFrame, as_of, through_as_of: bool) -> DataFrame:
    if not through_as_of:
        return billing
    if is_cost_cube(billing):
        raise ValueError("through_as_of needs usage lines, not an aggregated cube")
    return usage_before(load_billing(billing), ReportCalendar.for_date(as_of).as_of + dt.timedelta(days=1))


def org_unit_costs(billing: DataFrame, dim: DataFrame, as_of=None, levels: Sequence[str] | None = None,
                   prune_history: bool = True, through_as_of: bool = False) -> DataFrame:
    """The cost report per organisational unit (the nine metrics of a project report).

    With ``prune_history`` the money columns are read only for the report's
    months; which projects were ever billed comes from an id-only scan.
    ``through_as_of=True`` drops usage dated after ``as_of`` first (export only).
    """
    billing = _until(billing, as_of, through_as_of)
    cal = ReportCalendar.for_date(as_of)
    lo, hi = cal.scan_window()
    if not prune_history:
        window = cost_cube(billing)
    elif is_cost_cube(billing):
        window = cube_window(billing, lo, hi)
    else:
        window = cost_cube(usage_between(load_billing(billing), lo, hi))
    rows = _known(window).groupBy(S.PROJECT_ID).agg(*period_sums(cal.as_of))
    if prune_history:
        rows = _known(billed_project_ids(billing)).join(rows, on=S.PROJECT_ID, how="left")
    return _report(_per_unit(unit_memberships(dim, levels), rows, add_up()))


def _report(units: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    done = finish(units, [*UNIT_KEYS, "acronym"], extra)
    metrics = [c for c in done.columns if c not in (*UNIT_KEYS, "acronym")]
    return done.select(*_shown(), *metrics)


def _units(cube: DataFrame, dim: DataFrame, as_of, kilograms: DataFrame | None,
           levels: Sequence[str] | None) -> DataFrame:
    """Unit records from a cost cube and kilograms per project."""
    members = unit_memberships(dim, levels)
    rows = (_known(cube.select(S.PROJECT_ID, S.MONTH, S.FINAL_COST)).groupBy(S.PROJECT_ID)
            .agg(*period_sums(as_of), F.sum(S.FINAL_COST).alias("_total")).withColumn("_billed", F.lit(1)))
    extra = ["projectCount", "totalCloudSpend"]
    aggs = [*add_up(), F.count("_billed").alias("projectCount"), as_double(F.sum("_total")).alias("totalCloudSpend")]
    if kilograms is not None:
        rows = rows.join(kilograms, on=S.PROJECT_ID, how="full")
        extra.append("carbonFootprint")
        aggs.append(as_double(F.sum(S.CARBON_KG)).alias("carbonFootprint"))
    return _report(_per_unit(members, rows, aggs).where("projectCount > 0"), extra)


def org_units(billing: DataFrame, dim: DataFrame, as_of=None, carbon: DataFrame | None = None,
              levels: Sequence[str] | None = None) -> DataFrame:
    """One record per unit: path, report metrics, ``projectCount``, ``totalCloudSpend``
    and, when a carbon table is given, the all-history ``carbonFootprint`` (kg).

    One scan of the export gives metrics, count and total.
    """
    return _units(cost_cube(billing), dim, as_of, None if carbon is None else _carbon_totals(carbon), levels)


def _of_unit(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """The rows of some projects, from a table already reduced per project (and month).

    Catalyst moves this semi-join below the aggregate, onto the usage lines, if
    the projects are few enough to broadcast; else only reduced rows are shuffled.
    """
    return rows.join(projects.select(S.PROJECT_ID), on=S.PROJECT_ID, how="left_semi")


def _named(dim: DataFrame, level: str, name: str) -> DataFrame:
    """Dimension rows of the units of one name at a level (several, where branches share it)."""
    if name is None:
        raise ValueError("unit name must not be null")
    _levels([level])
    return project_dimension(dim).where(F.col(level) == F.lit(name))


def named_projects(dim: DataFrame, level: str, name: str) -> DataFrame:
    """The dimension's rows, one per project, of the units of that level and name."""
    return _named(dim, level, name)


def unit_answers(members: DataFrame, rows: DataFrame, aggs: Sequence[Column], extra: Sequence[str] = ()) -> DataFrame:
    """Unit reports from rows per project: ``aggs`` per unit give the period sums and the ``extra`` columns."""
    return _report(_per_unit(members, rows, aggs), extra)


def unit(billing: DataFrame, dim: DataFrame, level: str, name: str, as_of=None,
         carbon: DataFrame | None = None) -> DataFrame:
    """The record of every unit of that level and name, none when it is unknown.

    A semi-join keeps the unit's projects (see ``_of_unit``).
    """
    own = _named(dim, level, name)
    kilograms = None if carbon is None else _of_unit(_carbon_totals(carbon), own)
    return _units(_of_unit(cost_cube(billing), own), own, as_of, kilograms, [level])


def department(billing: DataFrame, dim: DataFrame, name: str, as_of=None, carbon: DataFrame | None = None) -> DataFrame:
    """One department's record (no row when the name is unknown)."""
    return unit(billing, dim, "department", name, as_of, carbon)


def branch(billing: DataFrame, dim: DataFrame, name: str, as_of=None, carbon: DataFrame | None = None) -> DataFrame:
    """The record of each branch of that name, with its department."""
    return unit(billing, dim, "branch", name, as_of, carbon)


def directorate(billing: DataFrame, dim: DataFrame, name: str, as_of=None,
                carbon: DataFrame | None = None) -> DataFrame:
    """The record of each directorate of that name, with its department and branch."""
    return unit(billing, dim, "directorate", name, as_of, carbon)


def unit_projects(billing: DataFrame, dim: DataFrame, level: str, name: str, as_of=None) -> DataFrame:
    """Report rows of the projects of the units of that level and name (flat, with their path)."""
    own = _named(dim, level, name)
    return org_projects(_of_unit(cost_cube(billing), own), own, as_of)


#: Projects on one page of a unit's nested project list.
PAGE_PROJECTS = 1000


def unit_project_pages(billing: DataFrame, dim: DataFrame, level: str, as_of=None, name: str | None = None,
                       page_size: int = PAGE_PROJECTS, flavour: str = "api") -> DataFrame:
    """Units with their projects nested: path, page, pages, projects array<struct<id, classification, costs>>.

    A unit's projects, in order of id, are cut into pages of ``page_size``,
    numbered from 1, so that no row grows with the unit.  All units of a level,
    or those of one ``name``; units without billed projects have no page.
    """
    if page_size < 1:
        raise ValueError("a page has at least one project")
    _levels([level])
    own = project_dimension(dim) if name is None else _named(dim, level, name)
    source = billing if name is None else _of_unit(cost_cube(billing), own)
    rows = org_projects(source, own, as_of)
    rows = api_flavour(rows) if flavour == "api" else rows
    order = list(S.ORG_LEVELS)
    path = order[:order.index(level) + 1]
    unit_rows = Window.partitionBy(*path)
    rows = rows.select(
        *path, *[F.lit(None).cast("string").alias(lv) for lv in order[len(path):]], F.lit(level).alias("level"),
        F.min(S.ORG_LEVELS[level][1]).over(unit_rows).alias("acronym"),
        F.ceil(F.row_number().over(unit_rows.orderBy(S.PROJECT_ID)) / page_size).cast("int").alias("page"),
        F.ceil(F.count("*").over(unit_rows) / page_size).cast("int").alias("pages"),
        F.struct(F.col(S.PROJECT_ID).alias("id"), "classification", costs_struct(rows)).alias("project"))
    pages = rows.groupBy(*UNIT_KEYS, "acronym", "page", "pages").agg(
        F.sort_array(F.collect_list("project")).alias("projects"))  # a page at most
    return pages.select(*_shown(), "page", "pages", "projects")


def project_totals(billing: DataFrame) -> DataFrame:
    """All-history spend per project (one row per billed project, null id dropped).

    Reducing to one row per project before any dimension join makes every
    count below a plain ``count`` instead of a distinct count.
    """
    cube = cost_cube(billing).select(S.PROJECT_ID, S.FINAL_COST)
    return _known(cube).groupBy(S.PROJECT_ID).agg(F.sum(S.FINAL_COST).alias(S.FINAL_COST))


def org_spend_rollup(billing: DataFrame, dim: DataFrame) -> DataFrame:
    """All-history spend at every level in one ``ROLLUP`` (grand total included).

    ``grouping_level`` is Spark's ``grouping_id()``: 0 directorate rows,
    1 branch subtotals, 3 department subtotals, 7 the grand total.
    """
    rows = project_totals(billing).join(project_dimension(dim).select(S.PROJECT_ID, "department", "branch", "directorate"),
                                        on=S.PROJECT_ID)
    return rows.rollup("department", "branch", "directorate").agg(
        F.grouping_id().cast("int").alias("grouping_level"),
        F.count(S.PROJECT_ID).alias("projectCount"),
        as_double(F.sum(S.FINAL_COST)).alias("totalCloudSpend"),
    )


def org_project_count(billing: DataFrame, dim: DataFrame, levels: Sequence[str] | None = None) -> DataFrame:
    """Unit and projectCount for every unit with billed projects."""
    rows = _known(billed_project_ids(billing))
    counted = _per_unit(unit_memberships(dim, levels), rows, [F.count(S.PROJECT_ID).alias("projectCount")])
    return counted.select(*_shown(), "projectCount")


def org_projects(billing: DataFrame, dim: DataFrame, as_of=None) -> DataFrame:
    """Project report rows with their department, branch and directorate (flat)."""
    return project_cost_report(billing, as_of).join(
        project_dimension(dim).select(S.PROJECT_ID, "classification", *_LEVEL_COLUMNS), on=S.PROJECT_ID, how="inner")


def org_hierarchy(dim: DataFrame) -> DataFrame:
    """Distinct department > branch > directorate paths with acronyms."""
    return project_dimension(dim).select(*_LEVEL_COLUMNS).distinct()


def children(dim: DataFrame, level: str, name: str, of_level: str | None = None) -> DataFrame:
    """Units below the units of ``level`` and ``name``: the next level, or ``of_level`` further down
    (a department's directorates, say), with their parents."""
    order = list(S.ORG_LEVELS)
    if level not in order[:-1]:
        raise ValueError(f"level must be one of {order[:-1]}")
    below = order[order.index(level) + 1] if of_level is None else of_level
    if below not in order[order.index(level) + 1:]:
        raise ValueError(f"{below!r} is not below {level!r}")
    members = unit_memberships(_named(dim, level, name), [below])
    return members.groupBy(*UNIT_KEYS).agg(F.min("acronym").alias("acronym")).select(*_shown())


def department_tree(dim: DataFrame) -> DataFrame:
    """One row per department: name, acronym, branches, directorates, with the links of each level both ways.

    Assembled from below: directorates into their branch, branches into their
    department.  A branch names its department, a directorate its branch and
    department; a department lists its branches and, across them, all its
    directorates.  Levels without a name are left out, lists are in order of
    name, an acronym is the least one of its unit.  A row holds the units of one
    department, never its projects.
    """
    units = project_dimension(dim).where(F.col("department").isNotNull())
    names = list(S.ORG_LEVELS)
    acronyms = [F.min(a).alias(a) for _, a in S.ORG_LEVELS.values()]
    low = units.groupBy(*names).agg(*acronyms)
    directorate_ = F.struct(F.col("directorate").alias("name"), F.col("directorate_acronym").alias("acronym"), "branch", "department")
    branches = low.groupBy("department", "branch").agg(
        *acronyms[:2], F.sort_array(F.collect_list(F.when(F.col("directorate").isNotNull(), directorate_))).alias("directorates"))
    branch_ = F.struct(F.col("branch").alias("name"), F.col("branch_acronym").alias("acronym"), "department", "directorates")
    tree = branches.groupBy("department").agg(
        acronyms[0], F.sort_array(F.collect_list(F.when(F.col("branch").isNotNull(), branch_))).alias("branches"))
    return tree.select(F.col("department").alias("name"), F.col("department_acronym").alias("acronym"), "branches",
                       F.flatten(F.transform("branches", lambda b: b["directorates"])).alias("directorates"))


def classification_spend(billing: DataFrame, dim: DataFrame) -> DataFrame:
    """Project count and all-history spend per classification."""
    rows = project_totals(billing).join(project_dimension(dim).select(S.PROJECT_ID, "classification"), on=S.PROJECT_ID)
    return rows.groupBy("classification").agg(
        F.count(S.PROJECT_ID).alias("projectCount"),
        as_double(F.sum(S.FINAL_COST)).alias("totalCloudSpend"),
    )


def duplicate_projects(dim: DataFrame) -> DataFrame:
    """Project ids listed more than once in the dimension, with their row count (a data check)."""
    validate_dim(dim)
    return dim.groupBy(S.PROJECT_ID).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def invalid_classification(dim: DataFrame) -> DataFrame:
    """Dimension rows whose classification is null or outside the declared domain."""
    validate_dim(dim)
    c = F.col("classification")
    return dim.where(c.isNull() | ~c.isin(list(S.CLASSIFICATIONS))).select(S.PROJECT_ID, "classification")


def project_owner(billing: DataFrame, dim: DataFrame) -> DataFrame:
    """Owner department of every billed project (null when not in the dimension)."""
    owners = project_dimension(dim).select(
        S.PROJECT_ID, F.col("department").alias("owner"), F.col("department_acronym").alias("owner_acronym")
    )
    return billed_project_ids(billing).join(owners, on=S.PROJECT_ID, how="left")


def _carbon_totals(carbon: DataFrame) -> DataFrame:
    """All-history kilograms per project, the null project left out."""
    return (carbon.select(project_id_col().alias(S.PROJECT_ID), S.CARBON_KG).where(F.col(S.PROJECT_ID).isNotNull())
            .groupBy(S.PROJECT_ID).agg(F.sum(S.CARBON_KG).alias(S.CARBON_KG)))


def org_carbon_total(carbon: DataFrame, dim: DataFrame, levels: Sequence[str] | None = None) -> DataFrame:
    """Per unit: all-history kilograms (the unit-level ``carbonFootprint`` scalar)."""
    total = as_double(F.sum(S.CARBON_KG)).alias("carbonFootprint")
    return _per_unit(unit_memberships(dim, levels), _carbon_totals(carbon), [total]).select(*_shown(), "carbonFootprint")
