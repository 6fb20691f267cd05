"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of ``cells`` equal arcs; a row
hashes to a cell and belongs to the first point clockwise of it.  A shard's
capacity is its exact share of the rows (shares differ by one at most), so
rows that meet a full shard go on clockwise to the next point whose shard has
room.  Counts per shard are then equal to within one row, and only the
overflow of full shards leaves its ring position.

Main path: DataFrame functions only.  Rows are counted per ring cell, the
counts (one row per cell, a fixed number) become the ring plan, and each row
finds its shard from its cell and its rank in that cell.  No task holds more
than one cell's narrow (id, size, crc) rows; nothing grows on the driver.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm import common

CELLS = 1 << 14
VNODES = 64


def _ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) points in clockwise order."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"{shard}/{v}".encode()).hexdigest()
            points.append((int(digest[:8], 16) % cells, shard))
    return sorted(points)


def ring_plan(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple]:
    """(cell, from_rank, to_rank, shard, slot of the first row) covering every counted row once.

    Round by round, each shard with room takes waiting rows in clockwise order
    of their cells until it is full; the rest move on to the next point of a
    shard with room.  A round either ends the plan or fills at least one shard.
    """
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    taken = [0] * shards
    points = _ring(shards, vnodes, cells)
    at = [c for c, _ in points]
    done = {cell: 0 for cell in counts}
    place = {cell: bisect.bisect_left(at, cell) for cell in counts}
    waiting = {cell: n for cell, n in counts.items() if n}
    plan = []
    while waiting:
        open_at = [i for i, (_, s) in enumerate(points) if free[s]]
        for cell in waiting:
            i = bisect.bisect_left(open_at, place[cell] % len(points))
            place[cell] = open_at[i % len(open_at)]
        left = {}
        for cell in sorted(waiting):
            n, shard = waiting[cell], points[place[cell]][1]
            take = min(n, free[shard])
            if take:
                plan.append((cell, done[cell], done[cell] + take, shard, taken[shard]))
                done[cell] += take
                free[shard] -= take
                taken[shard] += take
            if n > take:
                left[cell] = n - take
        waiting = left
    return plan


def ring_cell(key: Column, cells: int = CELLS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % cells).cast("int")


def assign_shards(docs: DataFrame, shards: int = 16, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A null text counts as an empty one (size 1, crc 0); a null doc_id hashes as
    the empty key.  Rows of one doc_id are told apart by crc and size; exact
    repeats are interchangeable and take neighbouring slots.  An empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    common.shared_dir(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(common.text_or_empty()).cast("long") + 1).alias("size"),
        F.crc32(common.text_or_empty().cast("binary")).alias("text_crc32"),
        ring_cell(F.col("doc_id"), cells).alias("cell"),
    )
    counts = {r["cell"]: r["n"] for r in docs.select(ring_cell(F.col("doc_id"), cells).alias("cell"))
              .groupBy("cell").agg(F.count("*").alias("n")).collect()}  # ``cells`` rows at most
    plan = spark.createDataFrame(ring_plan(counts, shards, vnodes, cells),
                                 "plan_cell int, lo long, hi long, shard int, first long")
    parts = plan.groupBy("plan_cell").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard", "first")))
                                          .alias("parts"))  # ``shards`` parts a cell at most
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("rank", rank.cast("long"))
    part = F.filter("parts", lambda p: (F.col("rank") >= p["lo"]) & (F.col("rank") < p["hi"]))[0]
    return (
        ranked.join(F.broadcast(parts), ranked["cell"] == parts["plan_cell"])  # ``cells`` rows at most
        .withColumn("part", part)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("part.shard").alias("shard"),
                (F.col("part.first") + F.col("rank") - F.col("part.lo")).alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"))
    )


def op7_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(common.read_table(spark, sf_dir, "documents"))
