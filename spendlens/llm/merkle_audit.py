"""Merkle fixity audit of WARC replicas.

A manifest has one row for each run of equal records: the file, the offset in
it, the record's id, length and SHA-256, and the number of copies on end.  The
lowest nodes of the tree cover ``RANGE`` bytes of offsets each and hash the
(offset, id, length, digest, copies) of the runs that begin there, in order of
offset; a node above hashes ``FAN`` consecutive ranges, up to a file's root.
Records of one file don't overlap, so a node holds a bounded number of them
however often an id occurs.  The replicas' roots are compared, and on each
level only the children of nodes that differ, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm import common

FAN = 16
#: Bytes of a file that a lowest node covers.
RANGE = 64 << 10
#: Record ids of one file.
FILE_IDS = 1024
#: Runs without an offset are spread over this many nodes of their file.
NOWHERE = 1 << 20


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A resource record; a null url has no header line, a null body no content."""
    end = F.lit("\r\n")
    body = F.coalesce(html, F.lit(""))
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, end), F.lit(""))
    return F.concat(F.lit("WARC/1.1"), end, F.lit("WARC-Type: resource"), end, F.lit("WARC-Record-ID: "),
                    F.coalesce(page_id.cast("string"), F.lit("")), end, target, F.lit("Content-Length: "),
                    F.octet_length(body).cast("string"), end, end, body, end, end)


def records(pages: DataFrame) -> DataFrame:
    """file, id, digest, copies, length: the distinct records of ``pages`` (page_id, url, html).

    Equal records are one row with their number, so a record repeated very often
    is counted before it is shuffled.  Records without an id share a file of
    their own, with a null file and id.
    """
    text = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    return (pages.select(F.floor(F.col("page_id") / FILE_IDS).alias("file"), F.col("page_id").cast("long").alias("id"),
                         F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("length"))
            .groupBy("file", "id", "digest").agg(F.count("*").alias("copies"), F.first("length").alias("length")))


def manifest(pages: DataFrame) -> DataFrame:
    """file, offset, id, length, digest, copies of ``pages`` written in order of id and digest.

    Offsets are running sums in two steps, over the parts of a file (an id and
    the first 12 bits of the digest) and inside each part, so the records of a
    hot id, or of none, don't meet in one task.
    """
    recs = common.cut(records(pages)).withColumn("part", F.substring("digest", 1, 3))
    size = F.col("length") * F.col("copies")

    def before(value: Column, order: list[str], *keys: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    parts = (recs.groupBy("file", "id", "part").agg(F.sum(size).alias("size"))
             .select(F.col("file").alias("of_file"), F.col("id").alias("of_id"), F.col("part").alias("of_part"),
                     before(F.col("size"), ["id", "part"], "file").alias("base")))
    placed = recs.withColumn("inside", before(size, ["digest"], "file", "id", "part"))
    same = F.col("file").eqNullSafe(F.col("of_file")) & F.col("id").eqNullSafe(F.col("of_id"))
    return (placed.join(parts, same & (F.col("part") == F.col("of_part")))
            .select("file", (F.col("base") + F.col("inside")).alias("offset"), "id", "length", "digest", "copies"))


def leaves(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Runs of both manifests with their side (p or r) and lowest node; repeated rows add up."""
    names = ["file", "offset", "id", "length", "digest"]
    both = (primary.select(*names, "copies", F.lit("p").alias("side"))
            .unionByName(replica.select(*names, "copies", F.lit("r").alias("side"))))
    nowhere = -1 - F.crc32(F.coalesce(F.col("digest"), F.lit("")).cast("binary")) % NOWHERE
    node = F.coalesce(F.floor(F.col("offset") / RANGE), nowhere)
    return (both.groupBy("side", *names).agg(F.sum(F.coalesce("copies", F.lit(0))).alias("copies"))
            .withColumn("node", node))


def _digest(order: Column, content: Column) -> Column:
    """SHA-256 over a group's ``content`` in the given order."""
    ordered = F.sort_array(F.collect_list(F.struct(order.alias("at"), content.alias("content"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["content"]), "|"), 256)


def tree(runs: DataFrame) -> list[DataFrame]:
    """Nodes (side, file, node, digest) of each level, the ranges of offsets first and the roots last.

    Each level is computed once, from the one below it.
    """
    run = F.to_json(F.struct("offset", "id", "length", "digest", "copies"))
    levels = [common.cut(runs.groupBy("side", "file", "node").agg(_digest(F.col("offset"), run).alias("digest")))]
    last = levels[0].agg(F.max(F.abs("node"))).first()[0] or 0  # a number: how many ranges the longest file has
    while last > 0:
        last //= FAN
        child = F.concat_ws(":", F.col("node").cast("string"), F.col("digest"))
        up = levels[-1].groupBy("side", "file", F.floor(F.col("node") / FAN).alias("up"))  # FAN children at most
        levels.append(common.cut(up.agg(_digest(F.col("node"), child).alias("digest")).withColumnRenamed("up", "node")))
    return levels


def _of(side: str, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def differing(nodes: DataFrame) -> DataFrame:
    """file and node of the nodes whose digests differ or that one side lacks."""
    return (nodes.groupBy("file", "node").agg(*(F.max(_of(s, F.col("digest"))).alias(s) for s in "pr"))
            .where(~F.col("p").eqNullSafe(F.col("r"))).select(F.col("file").alias("of_file"), F.col("node").alias("of_node")))


def _under(rows: DataFrame, node: Column, bad: DataFrame) -> DataFrame:
    """``rows`` whose ``node`` is one of ``bad``."""
    return rows.join(bad, F.col("file").eqNullSafe(F.col("of_file")) & (node == F.col("of_node")), "left_semi")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Runs that the two manifests don't have alike.

    Returns file, page_id, offset, length, digest, primary_copies,
    replica_copies and status.  ``status`` is displaced where the other side has
    the record elsewhere in the file only, changed where it has another record
    (or another number of copies) at the offset, else missing (from the replica)
    or extra.  Nulls equal nulls, also offsets; a null number of copies is 0.
    Equal sides, two empty ones included, give no rows.  Both sides have the
    columns of ``manifest``; other columns are not read.
    """
    runs = common.cut(leaves(primary, replica))
    levels = tree(runs)
    bad = differing(levels[-1])
    for nodes in reversed(levels[:-1]):
        bad = differing(_under(nodes, F.floor(F.col("node") / FAN), bad))
    copies = [F.coalesce(F.sum(_of(s, F.col("copies"))), F.lit(0)).alias(s) for s in "pr"]
    rows = common.cut(_under(runs, F.col("node"), bad).groupBy("file", "offset", "id", "length", "digest")
                      .agg(*copies).where(F.col("p") != F.col("r")))

    def sides(*keys: str) -> DataFrame:
        """Whether both sides have rows of a key."""
        both = (F.max("p") > 0) & (F.max("r") > 0)
        return rows.groupBy(*(F.col(k).alias(f"{k}_") for k in keys)).agg(both.alias("both_" + keys[-1]))

    def same(*keys: str) -> Column:
        condition = F.lit(True)
        for k in keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"{k}_"))
        return condition

    record, place = ("file", "id", "length", "digest"), ("file", "offset")
    rows = rows.join(sides(*record), same(*record)).drop(*(f"{k}_" for k in record))
    rows = rows.join(sides(*place), same(*place))
    status = (F.when((F.col("p") > 0) & (F.col("r") > 0), "changed").when(F.col("both_digest"), "displaced")
              .when(F.col("both_offset") & F.col("offset").isNotNull(), "changed")
              .when(F.col("p") > 0, "missing").otherwise("extra"))
    return rows.select("file", F.col("id").alias("page_id"), "offset", "length", "digest",
                       F.col("p").alias("primary_copies"), F.col("r").alias("replica_copies"), status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults by a digest of the id: 1 in 256 with a byte changed, 1 in 4,096 lost, or there twice."""
    fault = F.substring(F.md5(F.concat(F.lit("replica/"), F.col("page_id").cast("string")).cast("binary")), 1, 3)
    pages = pages.select("page_id", "url", "html", F.coalesce(fault, F.lit("")).alias("fault"))
    copies = F.when(F.col("fault") == "100", 0).when(F.col("fault") == "200", 2).otherwise(1)
    flipped = F.concat(F.lit("\x00"), F.expr("substring(html, 2)"))
    html = F.when(F.col("fault").startswith("00"), flipped).otherwise(F.col("html"))
    return (pages.withColumn("html", html).withColumn("again", F.explode(F.array_repeat(F.lit(1), copies)))
            .select("page_id", "url", "html"))


def op3_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read_table(spark, sf_dir, "pages")
    return audit(manifest(pages), manifest(damaged(pages)))


SQL = f"""
WITH faults AS (
  SELECT page_id, url, html, substr(md5('replica/' || CAST(page_id AS VARCHAR)), 1, 3) AS fault FROM pages),
both_sides AS (
  SELECT 'p' AS side, page_id, url, html FROM pages
  UNION ALL SELECT 'r', page_id, url, CASE WHEN starts_with(fault, '00') THEN chr(0) || substr(html, 2) ELSE html END
            FROM faults WHERE fault IS DISTINCT FROM '100'
  UNION ALL SELECT 'r', page_id, url, html FROM faults WHERE fault = '200'),
texts AS (
  SELECT side, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
         || 'WARC-Record-ID: ' || coalesce(CAST(page_id AS VARCHAR), '') || chr(13) || chr(10)
         || coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), '')
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM both_sides),
recs AS (
  SELECT side, page_id, CAST(floor(page_id / {FILE_IDS}) AS BIGINT) AS file, sha256(record) AS digest,
         CAST(any_value(strlen(record)) AS BIGINT) AS length, count(*) AS copies FROM texts GROUP BY ALL),
placed AS (
  SELECT *, CAST(coalesce(sum(length * copies) OVER (PARTITION BY side, file ORDER BY page_id NULLS FIRST, digest
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM recs),
diff AS (
  SELECT file, page_id, place, length, digest, CAST(coalesce(sum(copies) FILTER (side = 'p'), 0) AS BIGINT) AS p,
         CAST(coalesce(sum(copies) FILTER (side = 'r'), 0) AS BIGINT) AS r
  FROM placed GROUP BY file, page_id, place, length, digest HAVING p <> r)
SELECT file, page_id, place AS "offset", length, digest, p AS primary_copies, r AS replica_copies,
       CASE WHEN p > 0 AND r > 0 THEN 'changed'
            WHEN max(p) OVER record > 0 AND max(r) OVER record > 0 THEN 'displaced'
            WHEN max(p) OVER spot > 0 AND max(r) OVER spot > 0 THEN 'changed'
            WHEN p > 0 THEN 'missing' ELSE 'extra' END AS status
FROM diff WINDOW record AS (PARTITION BY file, page_id, length, digest), spot AS (PARTITION BY file, place)"""
