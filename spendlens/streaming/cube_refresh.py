"""Keep the stored monthly cube current as export files arrive.

A billing export grows by appended files, and credits for old usage can arrive
late.  Every micro-batch is aggregated into (month, project) partial sums and
written under its own ``run_id`` and ``batch_id`` inside its months; the cube is
the sum over all of them (``cube_store.read_cube``).  The run id is made once
for a checkpoint and kept in it, so a stream that starts over with a new
checkpoint (batch numbers from 0 again) adds to the store and replaces nothing.
Consequences:

* no streaming state and no watermark: nothing is ever finalised, so a late
  line simply adds a partial row to its month, however late it is;
* exactly-once effect: a replayed batch id rewrites the same
  ``(month, run_id, batch_id)`` partitions (dynamic partition overwrite), never
  duplicating them;
* with the stream's checkpoint and the store on shared storage (for example
  under ``spark.checkpoint.dir``, see ``cube_store.new_store_path``) the job
  survives lost executors and driver restarts.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spendlens.operators.monthly import monthly_cost_partials
from spendlens.sources.cube_store import write_partials


def write_batch(batch: DataFrame, batch_id: int, store: str, run_id: str = "manual") -> None:
    """Aggregate one batch of usage lines and (re)write its partitions."""
    write_partials(monthly_cost_partials(batch), store, run_id, int(batch_id))


def run_id_of(spark: SparkSession, checkpoint: str) -> str:
    """The run id kept in a checkpoint folder; made when the folder has none."""
    path = os.path.join(checkpoint, "_run_id")
    spark.createDataFrame([(uuid.uuid4().hex[:12],)], "run_id string").coalesce(1).write.mode("ignore").text(path)
    return spark.read.text(path).first()[0]


def billing_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over export files landing under ``path``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def start_cube_refresh(billing: DataFrame, store: str, checkpoint: str, available_now: bool = True,
                       processing_time: str | None = None, query_name: str | None = None) -> StreamingQuery:
    """Start the refresh: ``billing`` is a streaming DataFrame of usage lines.

    ``available_now`` processes everything present and stops (a scheduled
    job); otherwise ``processing_time`` (e.g. ``"10 minutes"``) runs it
    continuously.
    """
    if not billing.isStreaming:
        raise ValueError("billing must be a streaming DataFrame (spark.readStream...)")
    run_id = run_id_of(billing.sparkSession, checkpoint)
    writer = (billing.writeStream
              .foreachBatch(lambda df, batch_id: write_batch(df, batch_id, store, run_id))
              .option("checkpointLocation", checkpoint))
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def refresh_paths(root: str) -> tuple[str, str]:
    """(store, checkpoint) folders under one root."""
    return os.path.join(root, "cube"), os.path.join(root, "checkpoint")
