"""A corpus pipeline over ``documents``: each stage works on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs.  All stages but the last keep
the columns of documents.  Nulls: a row with a null doc_id is scored and coded
like any other, but groups, spans and leaks are told by doc_id, so it passes
those stages unchanged.  An empty table passes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import bm25_leaks, common, knn_quality, signature_tree, suffix_dedup, word_bpe

#: Near-duplicates: word 5-grams, Jaccard similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, (80, 100)
TOKENIZER = "word_bpe_49k.json"

# No SQL: stages learn a model, compare sets and run a tokenizer.  tests/llm compares them with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the nearest-neighbour classifier takes for low quality.

    A null text is scored as an empty one, a row without a doc_id like any other.
    """
    model = knn_quality.fit(docs, common.read_table(spark, sf_dir, "labels"))
    column = common.fresh(docs.columns, "quality")
    scored = knn_quality.score(docs, model, column)
    return scored.where(F.col(column) >= knn_quality.THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each linked group.

    Rows that share a doc_id are one document; each of its different texts stays,
    rows that repeat one stay once (the first as JSON).  Texts without words and
    rows without a doc_id are in no group; all of them stay.
    """
    # Used more than once below; three numbers a row, cut so that its joins are planned and run once.
    groups = common.cut(signature_tree.link_groups(docs, SHINGLE, *SIMILARITY))
    gone, again, row, met = (common.fresh(docs.columns, c) for c in ("gone", "again", "row", "met"))
    fates = (groups.where("doc_id is not null").groupBy("doc_id")
             .agg(F.bool_or(F.col("component_id") != F.col("doc_id")).alias(gone), (F.count_if(F.col("n_shingles") > 0) > 1).alias(again))
             .where(F.col(gone) | F.col(again)))
    # Most rows have none; their texts needn't be shuffled to find that.
    marked = common.told(docs, fates, ["doc_id"], met)
    kept = (marked.where(met).select(docs.columns).join(fates, "doc_id", "left").where(~F.coalesce(gone, F.lit(False))))
    twice = F.coalesce(again, F.lit(False)) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.struct(*docs.columns)
    once = (kept.where(twice).groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*"))
    return (marked.where(~F.col(met)).select(docs.columns)
            .unionByName(kept.where(~F.coalesce(twice, F.lit(False))).select(docs.columns)).unionByName(once))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that occur at an earlier place already; a text left empty goes.

    ``n_chars`` follows the text.  Texts of a doc_id that has several are left
    whole, and so are null texts and rows without a doc_id.
    """
    before = common.fresh(docs.columns, "before")
    cut = suffix_dedup.remove_repeats(docs.withColumn(before, F.xxhash64("text")))
    changed = ~F.col(before).eqNullSafe(F.xxhash64("text"))
    cut = cut.where(~(changed & (F.trim(F.col("text")) == "")))
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(
        docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak a benchmark item; null and empty texts leak none, rows without a doc_id stay."""
    return bm25_leaks.drop_leaks(docs, common.read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left; a null text is coded as an empty one."""
    return word_bpe.encode_decode(docs, word_bpe.load_tokenizer(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    root = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
