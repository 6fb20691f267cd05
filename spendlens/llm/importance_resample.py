"""Importance resampling of a corpus towards a target distribution.

Separators collapse to single spaces, so that a word begins after a space or at
the start and ends before a space or at the end.  A regular expression with
these two boundaries as lookarounds, searched with overlapping matches, then
gives the span of every run of k words straight from the text; the CRC of the
span's bytes names its bucket.  A bucket's gain is the log ratio of its smoothed
shares in the target and in the corpus, a document's weight the mean gain of its
features.  Weight plus a Gumbel value drawn from the id is the score; the
highest scores are a sample without replacement, in proportion to the weights.

Counts cover every document and every target text.  What is collected and sent
to the tasks is one number a bucket; to find the lowest drawn score, one count a
distinct score, a whole number within some 60,000 of zero.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spendlens.llm import common

BUCKETS = 10_000
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
#: Rows of one range while ranks are counted.
RANK_ROWS = 1_000_000

#: Bytes that words hold, lower-cased (digits, letters, all of UTF-8 beyond ASCII); others are separators.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
              for c in range(256))

RESULTS = ("n_features", "weight", "score", "rank")


def collapse(raw: bytes) -> bytes:
    """The words of a UTF-8 text, A-Z lower-cased, with one space between each two."""
    return b" ".join(raw.translate(_FOLD).split())


def spans(text: bytes, low: int = 1, high: int = 1) -> Iterator[tuple[int, int]]:
    """Where every run of ``low`` to ``high`` words of a collapsed text begins and ends."""
    for k in range(low, high + 1):
        run = regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (k - 1))
        for match in run.finditer(text, overlapped=True):
            yield match.span()


def features(text: bytes, low: int, high: int, buckets: int) -> np.ndarray:
    """The bucket of each feature of a collapsed text."""
    return np.fromiter((crc32(text[a:b]) % buckets for a, b in spans(text, low, high)), np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.large_binary()):
        yield collapse(value.as_py() or b"")


def bucket_counts(texts: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of each bucket occur in all of ``texts`` (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in common.slices(batches):
            for text in _texts(batch):
                total += np.bincount(features(text, low, high, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    common.bounded_batches(texts.sparkSession)
    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target to its share in the corpus, rounded down."""
    buckets = len(corpus)
    own, aim = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * own / ((s + 1) * aim)))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id, seed: str) -> int:
    """Thousandths of the Gumbel value that an id draws, rounded down; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, low: int = 1, high: int = 1, seed: str = SEED,
          keep: Sequence[str] | None = None, n_words: str = "n_words") -> DataFrame:
    """``keep`` (all columns of ``docs``) and n_words (by that name), n_features, weight, score of every row."""
    added = (n_words, *RESULTS[:3])
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*added, *RESULTS)]
    common.bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in common.slices(batches):
            rows = []
            for text, doc_id in zip(_texts(batch), batch.column("doc_id").to_pylist(), strict=True):
                found = features(text, low, high, len(gain))
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                rows.append((text.count(b" ") + 1 if text else 0, len(found), weight, weight + gumbel(doc_id, seed)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))],
                names=[*keep, *added])

    kinds = [docs.schema[c] for c in keep] + [StructField(c, LongType()) for c in added]
    return docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).mapInArrow(run, StructType(kinds))


def _lowest_drawn(eligible: DataFrame, percent: int) -> tuple[int, int]:
    """How many rows to draw and the lowest score that is drawn."""
    counts = eligible.groupBy("score").agg(F.count("*").alias("n")).collect()  # a row a distinct score
    left = draw = percent * sum(r["n"] for r in counts) // 100
    for row in sorted(counts, key=lambda r: -r["score"]):
        left -= row["n"]
        if left <= 0:
            return draw, row["score"]
    return draw, 0


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, seed: str = SEED,
             min_words: int = MIN_WORDS, percent: int = PERCENT, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (``keep`` columns of it; all without) with n_features, weight, score and rank, every row once.

    ``percent`` of the rows with at least ``min_words`` words are drawn, rounded
    down: those of the highest scores, ties to the smaller doc_id, null ids
    last.  They get ranks from 1; the rest have a null rank.  Null and empty
    texts have no features and weight 0.  Rows that share a doc_id draw the same
    Gumbel value and are rows of their own, in any order where their weights
    agree too.  Columns of ``docs`` with a name of the results are replaced.
    Without documents there are no rows, without target texts all of them have
    gains from smoothing alone.
    """
    if not 1 <= low <= high:
        raise ValueError("features have 1 to any number of words: 1 <= low <= high")
    gain = gains(bucket_counts(docs, low, high, buckets), bucket_counts(target, low, high, buckets))
    keep = docs.columns if keep is None else list(keep)
    shown = [c for c in keep if c.lower() not in RESULTS]
    words = common.fresh([*keep, *RESULTS], "n_words")
    weighed = common.cut(weigh(docs, gain, low, high, seed, dict.fromkeys([*keep, "doc_id"]), words))
    draw, lowest = _lowest_drawn(weighed.where(F.col(words) >= min_words), percent)
    inside = (F.col(words) >= min_words) & (F.col("score") >= lowest) & F.lit(draw > 0)
    order, place, part = (common.fresh([*weighed.columns, "rank"], n) for n in ("order", "place", "part"))
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col(order)]
    # Ranges of the candidates, each sorted; a row's rank is the rows of earlier ranges and those above it in its own.
    ranges = (weighed.where(inside).withColumn(order, F.monotonically_increasing_id())
              .repartitionByRange(max(1, -(-draw // RANK_ROWS)), *keys).sortWithinPartitions(*keys)
              .withColumn(place, F.monotonically_increasing_id()))
    ranges = common.cut(ranges.withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1)))
    before, rows = 0, []
    for row in sorted(ranges.groupBy(part).agg(F.count("*").alias("n")).collect()):  # a row a range
        rows.append((row[0], before))
        before += row["n"]
    starts = docs.sparkSession.createDataFrame(rows, f"{part} long, rank long")
    rank = F.col("rank") + F.col(place) + 1
    ranked = ranges.join(starts, part).withColumn("rank", F.when(rank <= draw, rank))
    rest = weighed.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*shown, *RESULTS).unionByName(rest.select(*shown, *RESULTS))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return resample(docs, common.read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
