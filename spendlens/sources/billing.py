"""Billing export source: read, validate, derive, filter.

A billing export has one row per usage line::

    usage_start_time   timestamp or timestamp_ntz
    project            struct<id: string>          (id may be null)
    cost               double or decimal
    credits            array<struct<amount, ...>>  (may be empty or null)
    credits_sum_amount same type as cost           (derived when absent)

Nothing here collects data: every function returns a lazy DataFrame whose
filters Catalyst pushes into the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens import schema as S
from spendlens.functions.measures import credit_amount_type, credit_total

_TIME_TYPES = (T.TimestampType, T.TimestampNTZType)
_NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.DecimalType, T.LongType, T.IntegerType)


def validate_billing(df: DataFrame, require_credit_sum: bool = False) -> None:
    """Raise ``ValueError`` naming every missing or mistyped billing column."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    ts = fields.get(S.USAGE_START_TIME)
    if not isinstance(ts, _TIME_TYPES):
        problems.append(f"{S.USAGE_START_TIME}: timestamp expected, got {ts and ts.simpleString()}")
    project = fields.get(S.PROJECT)
    if not (isinstance(project, T.StructType) and "id" in project.fieldNames()
            and isinstance(project["id"].dataType, T.StringType)):
        problems.append(f"{S.PROJECT}: struct<id: string> expected, got {project and project.simpleString()}")
    cost = fields.get(S.COST)
    if not isinstance(cost, _NUMERIC_TYPES):
        problems.append(f"{S.COST}: numeric expected, got {cost and cost.simpleString()}")
    credits = fields.get(S.CREDITS)
    if credits is not None:
        try:
            credit_amount_type(df)
        except (TypeError, KeyError) as exc:
            problems.append(str(exc))
    if S.CREDITS_SUM_AMOUNT not in fields and (credits is None or require_credit_sum):
        problems.append(f"{S.CREDITS_SUM_AMOUNT}: missing and cannot be derived without {S.CREDITS}")
    if problems:
        raise ValueError("not a billing export: " + "; ".join(problems))


def load_billing(df: DataFrame) -> DataFrame:
    """Adapter for any DataFrame with the billing columns.

    Adds ``credits_sum_amount`` (the sum of the credit amounts, 0 when there
    are none) when the export does not carry it.
    """
    validate_billing(df)
    if S.CREDITS_SUM_AMOUNT not in df.columns:
        df = df.withColumn(S.CREDITS_SUM_AMOUNT, credit_total(credit_amount_type(df)))
    return df


def read_billing(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None,
                 **options) -> DataFrame:
    """Read an export.  Self-describing formats (parquet, orc, delta-style
    tables) keep their own schema; text formats (json, csv) get
    ``schema.BILLING_SCHEMA`` unless one is given, so nothing is inferred."""
    reader = spark.read.format(fmt).options(**options)
    if schema is None and fmt.lower() in ("json", "csv", "text"):
        schema = S.BILLING_SCHEMA
    if schema is not None:
        reader = reader.schema(schema)
    return load_billing(reader.load(path))


def project_id_col() -> Column:
    return F.col(f"{S.PROJECT}.id")


def usage_date(df: DataFrame) -> Column:
    """Calendar date (UTC) of ``usage_start_time``.

    Zone-less timestamps are taken as UTC wall time.  Zoned timestamps are
    shifted from the session zone so that the date is the UTC date whatever the
    session zone is.
    """
    ts_type = df.schema[S.USAGE_START_TIME].dataType
    ts = F.col(S.USAGE_START_TIME)
    if isinstance(ts_type, T.TimestampType):
        tz = df.sparkSession.conf.get("spark.sql.session.timeZone")
        if tz not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
            ts = F.to_utc_timestamp(ts, tz)
    return F.to_date(ts)


def _bound(df: DataFrame, day: dt.date) -> Column:
    """Midnight UTC of ``day`` as a literal of the column's own type (so it pushes down)."""
    ts_type = df.schema[S.USAGE_START_TIME].dataType
    if isinstance(ts_type, T.TimestampNTZType):
        return F.lit(day).cast(T.TimestampNTZType())
    return F.lit(f"{day.isoformat()} 00:00:00Z").cast(T.TimestampType())


# Column-metadata keys on usage_start_time naming a date partition column.
PARTITION_COLUMN_META = "spendlens.partition_date_column"
PARTITION_KIND_META = "spendlens.partition_date_kind"


def declare_date_partition(billing: DataFrame, column: str, kind: str = "usage") -> DataFrame:
    """Declare the export's date partition column so report windows prune partitions.

    * ``kind="usage"``: ``column`` is the UTC date of ``usage_start_time``;
      both ends of a window also filter the partition column.
    * ``kind="export"``: ``column`` is the date a line was exported, never
      before its usage day; only the lower end of a window can use it.

    The declaration travels as metadata on ``usage_start_time``.
    """
    if kind not in ("usage", "export"):
        raise ValueError("kind must be 'usage' or 'export'")
    if column not in billing.columns or not isinstance(billing.schema[column].dataType, T.DateType):
        raise ValueError(f"partition column {column!r} must be a DATE column of the export")
    meta = dict(billing.schema[S.USAGE_START_TIME].metadata)
    meta.update({PARTITION_COLUMN_META: column, PARTITION_KIND_META: kind})
    return billing.withMetadata(S.USAGE_START_TIME, meta)


def _partition_bounds(df: DataFrame, start: dt.date | None, end_exclusive: dt.date | None) -> Column | None:
    meta = df.schema[S.USAGE_START_TIME].metadata
    column = meta.get(PARTITION_COLUMN_META)
    if not column or column not in df.columns:
        return None
    p = F.col(column)
    cond = None
    if start is not None:
        cond = p >= F.lit(start)
    if end_exclusive is not None and meta.get(PARTITION_KIND_META) == "usage":
        upper = p < F.lit(end_exclusive)
        cond = upper if cond is None else cond & upper
    return cond


def usage_between(df: DataFrame, start: dt.date, end_exclusive: dt.date) -> DataFrame:
    """Rows with a usage day in [start, end_exclusive), as a scan-pushable filter
    (plus a partition filter when a date partition was declared)."""
    ts = F.col(S.USAGE_START_TIME)
    cond = (ts >= _bound(df, start)) & (ts < _bound(df, end_exclusive))
    extra = _partition_bounds(df, start, end_exclusive)
    return df.where(cond if extra is None else cond & extra)


def usage_before(df: DataFrame, end_exclusive: dt.date) -> DataFrame:
    """Rows with a usage day before ``end_exclusive`` (scan-pushable)."""
    cond = F.col(S.USAGE_START_TIME) < _bound(df, end_exclusive)
    extra = _partition_bounds(df, None, end_exclusive)
    return df.where(cond if extra is None else cond & extra)


def normalize_ids(ids: str | Iterable[str] | None) -> list[str]:
    """Validate a project id list: a bare string is a one-element list, duplicates
    collapse, ``None`` or an empty list select nothing, a null element is an error."""
    if ids is None:
        return []
    if isinstance(ids, str):
        ids = [ids]
    out: list[str] = []
    seen = set()
    for i in ids:
        if i is None:
            raise ValueError("project id list contains a null element")
        if i not in seen:
            seen.add(i)
            out.append(str(i))
    return out


#: Cells of each hash of an id filter: the most rows that one of its broadcasts can have.
ID_CELLS, ID_HASHES = 1 << 18, 2


def _cell(seed: int, key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key.cast("string")), F.lit(ID_CELLS))


def may_be_listed(billing: DataFrame, ids: DataFrame) -> DataFrame:
    """Billing rows whose project may be among ``ids`` (project_id): a Bloom filter before any aggregate.

    Every hash of the ids marks a cell, and a line stays if all its cells are
    marked.  The marked cells are at most ``ID_CELLS`` rows of a number each,
    however many ids there are, so they are broadcast and no line is shuffled.
    Lines of other projects may stay (a few per cent up to some ten thousand
    ids, all of them far beyond), so the exact test must follow.
    """
    kept = billing.where(project_id_col().isNotNull())
    for seed in range(ID_HASHES):
        cells = ids.where(F.col(S.PROJECT_ID).isNotNull()).select(_cell(seed, F.col(S.PROJECT_ID)).alias("_cell")).distinct()
        kept = kept.join(F.broadcast(cells), _cell(seed, project_id_col()) == F.col("_cell"), "left_semi")
    return kept


def filter_projects(billing: DataFrame, ids: str | Iterable[str] | DataFrame | None) -> DataFrame:
    """Keep the billing rows of the given projects (null ids never match).

    * Python ids (a string, list or any iterable) become ``project.id IN (...)``,
      pushed to parquet as a nested ``In`` filter;
    * a DataFrame with a ``project_id`` column becomes a left-semi join; the
      optimizer decides between broadcast and shuffle from the measured size
      (AQE).  It is the way for long id lists, which need not pass the driver.
    """
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(S.PROJECT_ID).alias("_pid")).where(F.col("_pid").isNotNull())
        return billing.join(keys, project_id_col() == F.col("_pid"), "left_semi")
    return billing.where(project_id_col().isin(normalize_ids(ids)))
