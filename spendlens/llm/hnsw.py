"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt by hash into shards of about ``SHARD_ROWS``; one task
builds a shard's graph and returns it as rows: node number, vector, and the
node's neighbours as flat arrays, one for each level it is on.  Nodes are
numbered from the highest level down, so a level is a prefix of the numbers.
Queries go to every shard in blocks, each shard answers from its graph, and the
shard results are merged by distance.

Equal vectors are one node.  A query can only ever return the k + 1 smallest
ids of such a group, so no more than those are kept beside it (the rank limit
is applied before the shuffle), and results are expanded from them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm import common

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
#: Neighbours kept on upper levels, and on the lowest.
LINKS, LINKS_0 = 16, 32
EF_BUILD, EF_SEARCH = 80, 160
BUILD_BATCH = 1024

INDEX = "shard int, node int, rep long, vector array<double>, links array<array<int>>"
FOUND = "query_id long, rep long, score double"


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``a`` (n, d) to its own candidates ``b`` (n, m, d)."""
    gap = b - a[:, None, :]
    return np.einsum("nmd,nmd->nm", gap, gap)


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int,
          count: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level's graph for many queries in step.

    Returns the ``ef`` nearest nodes met (-1 where fewer) and their squared
    distances, nearest first.  ``entry`` has start nodes of each query.
    """
    n = len(queries)
    rows = np.arange(n)
    seen = np.zeros((n, count), bool)
    ids = np.full((n, ef), -1, np.int64)
    dist = np.full((n, ef), np.inf)
    width = min(ef, entry.shape[1])
    start = entry[:, :width]
    ids[:, :width] = start
    dist[:, :width] = np.where(start >= 0, _apart(queries, vectors[np.maximum(start, 0)]), np.inf)
    seen[rows[:, None], np.maximum(start, 0)] |= start >= 0
    open_ = ids >= 0
    while True:
        waiting = np.where(open_, dist, np.inf)
        best = waiting.argmin(1)
        live = np.flatnonzero(np.isfinite(waiting[rows, best]))
        if not len(live):
            break
        at = best[live]
        open_[live, at] = False
        near = links[ids[live, at]].astype(np.int64)
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        part, col = np.nonzero(fresh)
        seen[live[part], near[part, col]] = True
        gap = np.full(near.shape, np.inf)
        diff = vectors[near[part, col]] - queries[live[part]]
        gap[part, col] = np.einsum("nd,nd->n", diff, diff)
        all_ids = np.concatenate([ids[live], near], 1)
        all_dist = np.concatenate([dist[live], gap], 1)
        all_open = np.concatenate([open_[live], fresh], 1)
        keep = np.argpartition(all_dist, ef - 1, axis=1)[:, :ef]
        ids[live] = np.take_along_axis(all_ids, keep, 1)
        dist[live] = np.take_along_axis(all_dist, keep, 1)
        open_[live] = np.take_along_axis(all_open, keep, 1) & np.isfinite(dist[live])
    order = np.lexsort((ids, dist), axis=1)
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def _select(vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
    """Choose up to ``width`` of each row's candidates (nearest first, -1 for none).

    A candidate nearer to a chosen one than to the node itself waits; waiting
    ones fill the places that are left, nearest first.
    """
    n, m = ids.shape
    chosen = np.full((n, width), -1, np.int64)
    gaps = np.zeros((n, width, vectors.shape[1]))
    filled = np.zeros(n, np.int64)
    taken = np.zeros((n, m), bool)
    for j in range(m):
        able = np.flatnonzero((ids[:, j] >= 0) & (filled < width))
        if not len(able):
            continue
        mine = vectors[ids[able, j]]
        between = _apart(mine, gaps[able])
        between[np.arange(width)[None, :] >= filled[able][:, None]] = np.inf
        good = able[between.min(1) > dist[able, j]]
        chosen[good, filled[good]] = ids[good, j]
        gaps[good, filled[good]] = vectors[ids[good, j]]
        taken[good, j] = True
        filled[good] += 1
    for j in range(m):
        more = np.flatnonzero((ids[:, j] >= 0) & ~taken[:, j] & (filled < width))
        chosen[more, filled[more]] = ids[more, j]
        filled[more] += 1
    return chosen


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add the reverse of each new edge; a full node keeps the best of old and new."""
    width = links.shape[1]
    src = np.repeat(new, chosen.shape[1])
    dst = chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    if not len(dst):
        return
    gap = vectors[src] - vectors[dst]
    order = np.lexsort((np.einsum("nd,nd->n", gap, gap), dst))
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    most = min(int(count.max()), 2 * width)
    rank = np.arange(len(dst)) - np.repeat(first, count)
    add = np.full((len(nodes), most), -1, np.int64)
    near = rank < most
    add[np.repeat(np.arange(len(nodes)), count)[near], rank[near]] = src[near]
    both = np.concatenate([links[nodes].astype(np.int64), add], 1)
    dist = np.where(both >= 0, _apart(vectors[nodes], vectors[np.maximum(both, 0)]), np.inf)
    both = np.sort(np.where(both >= 0, both, np.iinfo(np.int64).max), 1)
    twice = np.concatenate([np.zeros((len(nodes), 1), bool), both[:, 1:] == both[:, :-1]], 1)
    both = np.where(twice | (both == np.iinfo(np.int64).max), -1, both)
    dist = np.where(both >= 0, _apart(vectors[nodes], vectors[np.maximum(both, 0)]), np.inf)
    order = np.argsort(dist, axis=1, kind="stable")
    links[nodes] = _select(vectors, np.take_along_axis(both, order, 1), np.take_along_axis(dist, order, 1), width)


class Graph:
    """Vectors with the highest levels first, and per level the flat neighbour array of its nodes."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.links = vectors, links

    @classmethod
    def build(cls, vectors: np.ndarray, counts: list[int]) -> Graph:
        """``counts[l]``: nodes on level ``l`` or above; ``counts[0]`` is all of them."""
        graph = cls(vectors, [])
        for level in reversed(range(len(counts))):
            graph._build_level(counts[level], LINKS if level else LINKS_0)
        return graph

    def _build_level(self, count: int, width: int) -> None:
        links = np.full((count, width), -1, np.int32)
        done = 0
        while done < count:
            size = min(count - done, BUILD_BATCH, max(64, done // 2))
            new = np.arange(done, done + size)
            mine = self.vectors[new]
            own = ((mine ** 2).sum(1)[:, None] + (mine ** 2).sum(1)[None, :] - 2 * mine @ mine.T)
            own[np.arange(size), np.arange(size)] = np.inf
            near = np.argsort(own, axis=1, kind="stable")[:, :width]
            ids, dist = new[near], np.take_along_axis(own, near, 1)
            ids, dist = np.where(np.isfinite(dist), ids, -1), np.maximum(dist, 0)
            if done:
                entry = self._descend(mine, np.zeros((size, 1), np.int64), 0)
                entry = np.where(entry < done, entry, 0)
                a, b = _beam(self.vectors, links, mine, entry, EF_BUILD, done)
                ids, dist = np.concatenate([ids, a], 1), np.concatenate([dist, b], 1)
                order = np.argsort(dist, axis=1, kind="stable")
                ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            chosen = _select(self.vectors, ids, dist, width // 2 if width > LINKS else width)
            links[new, :chosen.shape[1]] = chosen
            _link_back(self.vectors, links, new, chosen)
            done += size
        self.links.insert(0, links)

    def _descend(self, queries: np.ndarray, entry: np.ndarray, level: int) -> np.ndarray:
        """Entry nodes for the level below the built levels from ``level`` up."""
        for links in reversed(self.links[level:]):
            entry, _ = _beam(self.vectors, links, queries, entry, 4, len(links))
        return entry

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest nodes met by each query (-1 where fewer) and their squared distances."""
        entry = self._descend(queries, np.zeros((len(queries), 1), np.int64), 1)
        ids, dist = _beam(self.vectors, self.links[0], queries, entry, max(EF_SEARCH, k), len(self.vectors))
        return ids[:, :k], dist[:, :k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arrays = column.combine_chunks()
    return np.asarray(arrays.flatten()).reshape(len(arrays), -1)


def _levels(ids: np.ndarray) -> np.ndarray:
    """Random level of each node, from its id: one in ``LINKS`` goes on to the next."""
    draw = np.array([(xxhash.xxh64_intdigest(str(i)) + 1) / 2.0**64 for i in ids.tolist()])
    return (-np.log(draw) / np.log(LINKS)).astype(np.int64)


def _build(shard: pa.Table) -> pa.Table:
    rep = shard["rep"].to_numpy()
    level = _levels(rep)
    order = np.lexsort((rep, -level))
    level, rep = level[order], rep[order]
    vectors = _matrix(shard["vector"])[order]
    counts = [int((level >= h).sum()) for h in range(int(level.max()) + 1)]
    graph = Graph.build(vectors, counts)
    links = [[x[i].tolist() for x in graph.links if i < len(x)] for i in range(len(rep))]
    return pa.table({"shard": pa.array([shard["shard"][0].as_py()] * len(rep), pa.int32()),
                     "node": pa.array(np.arange(len(rep)), pa.int32()), "rep": pa.array(rep, pa.int64()),
                     "vector": pa.array(vectors.tolist(), pa.list_(pa.float64())),
                     "links": pa.array(links, pa.list_(pa.list_(pa.int32())))})


def _searcher(k: int):
    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": np.empty(0, np.int64), "rep": np.empty(0, np.int64), "score": np.empty(0)}
        if nodes.num_rows and queries.num_rows:
            nodes = nodes.sort_by("node")
            vectors, rep = _matrix(nodes["vector"]), nodes["rep"].to_numpy()
            flat = nodes["links"].to_pylist()
            links = []
            for h in range(max(map(len, flat))):
                links.append(np.array([x[h] for x in flat if len(x) > h], np.int32))
            asked = _matrix(queries["vector"])
            ids, _ = Graph(vectors, links).search(asked, k)
            row, col = np.nonzero(ids >= 0)
            hit = ids[row, col]
            out = {"query_id": queries["query_id"].to_numpy()[row], "rep": rep[hit],
                   "score": np.sqrt(((asked[row] - vectors[hit]) ** 2).sum(1))}
        return pa.table(out)
    return run


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graph rows of ``vectors`` (rep long, dim int, vector array<double>, all distinct), stored in the shared folder.

    Vectors of one length share shards; a shard's number is its own across lengths.
    """
    counts = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shard, base = F.lit(0), 0
    for dim, n in sorted(counts.items()):  # the lengths in use, a handful
        parts = max(1, round(n / shard_rows))
        shard = F.when(F.col("dim") == dim, F.lit(base) + F.pmod(F.xxhash64("rep"), F.lit(parts))).otherwise(shard)
        base += parts
    # A task a shard: building one is long work on few bytes, by which Spark would join several.
    dealt = vectors.withColumn("shard", shard.cast("int")).repartition(max(1, base), "shard")
    return common.cut(dealt.groupBy("shard").applyInArrow(_build, INDEX))


def nearest(rows: DataFrame, queries: Column, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``k`` nearest other rows found.

    ``rows`` has vec_id and embedding; ``queries`` is a condition on vec_id.
    Unusable vectors (see ``usable``) and rows without a vec_id take no part;
    only vectors of one length are compared.  Rows of one vec_id and vector are
    one row; fewer candidates give fewer rows; ties go to the smaller vec_id.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = (rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("vector"))))
    same = Window.partitionBy("vector")
    few = (rows.withColumn("place", F.dense_rank().over(same.orderBy("vec_id"))).where(F.col("place") <= k + 1)
           .dropDuplicates(["vector", "vec_id"]).withColumn("rep", F.min("vec_id").over(same)))
    few = common.cut(few.withColumn("dim", F.size("vector")))
    index = build_index(few.where("vec_id = rep").select("rep", "dim", "vector"), shard_rows)
    asked = (rows.where(queries).select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("q_dim"))
             .dropDuplicates(["query_id", "vector"]))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    shards = index.where("node = 0").select(F.col("shard").alias("q_shard"), F.size("vector").alias("dim"))
    # Every query meets every shard of its length once; a shard is at most ``shard_rows`` rows, a block QUERY_BLOCK.
    asked = asked.join(shards, F.col("q_dim") == F.col("dim")).select("q_shard", "block", "query_id", "vector")
    nodes = index.withColumn("of_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (nodes.groupBy("shard", "of_block").cogroup(asked.groupBy("q_shard", "block"))
             .applyInArrow(_searcher(k + 1), FOUND))
    order = Window.partitionBy("query_id")
    best = (found.withColumn("at", F.row_number().over(order.orderBy("score", "rep"))).where(F.col("at") <= k + 1))
    members = few.select("rep", "vec_id")
    rank = F.row_number().over(order.orderBy("score", "vec_id"))
    return (best.join(members, "rep").where("vec_id != query_id")
            .withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
