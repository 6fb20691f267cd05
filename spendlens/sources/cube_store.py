"""Stored monthly cube: additive partial sums on shared storage, by month.

A report over years of a large export re-reads every usage line.  Writing the
cube's partial sums once (``write_cube``) and reporting from them
(``read_cube`` + ``cube_cost_report``) reads a table the size of
projects x months instead, and cuts the lineage: a lost executor recomputes
from the stored files, not from the raw export.

Layout: parquet partitioned by ``year``, ``run_id`` and ``batch_id``, each file in
order of month, with the schema beside it, so that an empty store reads as an
empty cube.  The cube is the sum over all runs and batches.  A report's window
becomes a partition filter on the year and a filter on the month that skips row
groups, and a batch writes a few files a year instead of some for each month.

Each batch also keeps an id table: its projects with their first and last
month.  ``read_project_ids`` adds these up, so a report knows every project of
all history without reading a month outside its window (``stored_report``).

The store lives under the shared folder named by ``spark.checkpoint.dir`` unless
a path is given; ``drop_store`` deletes one.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens import schema as S
from spendlens.operators.monthly import PARTIAL_SUMS, combine_cost_partials, finish_costs, monthly_cost_partials
from spendlens.session import checkpoint_dir

RUN_ID = "run_id"
BATCH_ID = "batch_id"
PARTITIONS = (S.YEAR, RUN_ID, BATCH_ID)
# Hidden from parquet readers of the store by their names.
_SCHEMA = "_schema"
_IDS = "_ids"

FIRST_MONTH, LAST_MONTH = "first_month", "last_month"
_IDS_SCHEMA = T.StructType([T.StructField(S.PROJECT_ID, T.StringType()), T.StructField(FIRST_MONTH, T.DateType()),
                            T.StructField(LAST_MONTH, T.DateType()), T.StructField(RUN_ID, T.StringType()),
                            T.StructField(BATCH_ID, T.LongType())])


def new_store_path(spark: SparkSession, name: str = "monthly-cost-cube") -> str:
    """A fresh folder for a cube under the session's shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def drop_store(spark: SparkSession, path: str) -> None:
    """Delete a store (or any folder) on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def store_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema kept with a store; None where there is no store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, _SCHEMA))
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return T.StructType.fromJson(json.loads(spark.read.text(os.path.join(path, _SCHEMA)).first()[0]))


def write_partials(partials: DataFrame, path: str, run_id: str, batch_id: int, mode: str = "overwrite") -> None:
    """Write (month, project_id, sums) rows as one batch; a batch written again replaces itself.

    ``rebalance`` lets AQE split a year that holds most of the rows and put small
    ones together.  The batch's id table is read off what was written.
    """
    spark = partials.sparkSession
    rows = partials.select(S.MONTH, S.PROJECT_ID, *PARTIAL_SUMS)
    batch = [F.lit(run_id).alias(RUN_ID), F.lit(batch_id).cast("long").alias(BATCH_ID)]
    if store_schema(spark, path) is None:
        kept = T.StructType([*rows.schema.fields, T.StructField(S.YEAR, T.IntegerType()), T.StructField(RUN_ID, T.StringType()),
                             T.StructField(BATCH_ID, T.LongType())])
        _write_text(spark, os.path.join(path, _SCHEMA, "part-00000.txt"), kept.json())
    (rows.select("*", F.year(S.MONTH).alias(S.YEAR), *batch).hint("rebalance", S.YEAR)
     .sortWithinPartitions(*PARTITIONS, S.MONTH, S.PROJECT_ID)
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path))
    written = _read(spark, path).where((F.col(RUN_ID) == run_id) & (F.col(BATCH_ID) == batch_id))
    ids = written.groupBy(S.PROJECT_ID).agg(F.min(S.MONTH).alias(FIRST_MONTH), F.max(S.MONTH).alias(LAST_MONTH))
    (ids.select("*", *batch).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(RUN_ID, BATCH_ID)
     .parquet(os.path.join(path, _IDS)))


def write_cube(billing: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Aggregate the export once and store the partial sums; ``overwrite`` replaces what the store held."""
    if mode == "overwrite":
        drop_store(billing.sparkSession, path)
    write_partials(monthly_cost_partials(billing), path, f"export-{uuid.uuid4().hex[:12]}", 0)
    return path


def _read(spark: SparkSession, path: str) -> DataFrame:
    schema = store_schema(spark, path)
    if schema is None:
        raise ValueError(f"no stored cube at {path}")
    return spark.read.schema(schema).parquet(path)


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """Raw stored partial rows (several per month and project when written in batches)."""
    return _read(spark, path).select(S.YEAR, S.MONTH, S.PROJECT_ID, *PARTIAL_SUMS)


def read_batch_ids(spark: SparkSession, path: str) -> DataFrame:
    """The id table: project_id, first_month, last_month of each run and batch."""
    if store_schema(spark, path) is None:
        raise ValueError(f"no stored cube at {path}")
    return spark.read.schema(_IDS_SCHEMA).parquet(os.path.join(path, _IDS))


def read_project_ids(spark: SparkSession, path: str) -> DataFrame:
    """project_id, first_month, last_month of every project in a store, the null id included; reads the id table only."""
    return (read_batch_ids(spark, path).groupBy(S.PROJECT_ID)
            .agg(F.min(FIRST_MONTH).alias(FIRST_MONTH), F.max(LAST_MONTH).alias(LAST_MONTH)))


def stored_report(spark: SparkSession, path: str, as_of=None) -> DataFrame:
    """The raw project report of a store: the years and months of its window, and the id table."""
    from spendlens.operators.report import cube_cost_report

    return cube_cost_report(read_cube(spark, path), as_of, read_project_ids(spark, path))


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """The monthly cost cube (same columns as ``monthly_costs``) from a store."""
    return finish_costs(combine_cost_partials(read_partials(spark, path)))


def materialize_costs(billing: DataFrame, path: str | None = None) -> DataFrame:
    """Write the cube of ``billing`` to shared storage and return it read back."""
    spark = billing.sparkSession
    path = path or new_store_path(spark)
    write_cube(billing, path)
    return read_cube(spark, path)


def compact(spark: SparkSession, path: str, target: str | None = None) -> str:
    """Fold a store of many batches into one row per (month, project) in a new folder.

    The new store has the same layout, its rows under a run of their own, so a
    refresh may go on writing to it.  To switch over: stop the refresh, compact,
    start the refresh again with the same checkpoint on the new folder, and
    drop the old one.  The sums keep the stored types.
    """
    target = target or new_store_path(spark, "monthly-cost-cube-compacted")
    drop_store(spark, target)
    stored = read_partials(spark, path)
    kinds = {f.name: f.dataType for f in stored.schema.fields}
    folded = combine_cost_partials(stored.drop(S.YEAR)).select(*[F.col(c).cast(kinds[c]).alias(c) for c in stored.columns if c != S.YEAR])
    write_partials(folded, target, f"compacted-{uuid.uuid4().hex[:12]}", 0)
    return target


def months_stored(spark: SparkSession, path: str) -> DataFrame:
    return read_partials(spark, path).select(S.MONTH).distinct().orderBy(F.col(S.MONTH))
