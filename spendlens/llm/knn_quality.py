"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are the shapes of its characters: letters, digits, marks and
white space become classes, runs of letters shrink to one, and each run of four
classes is a term, hashed to one of ``TERMS`` dimensions; a word that repeats
the one before it is a term of its own.  Log counts are weighted by inverse
document frequency over the whole corpus and projected on the leading singular
vectors of the labelled sample.  Each document meets every labelled vector in
exact cosine blocks; its ``NEIGHBOURS`` nearest vote for their label with
a power of their similarity as weight.

The labelled sample holds ``PER_LABEL`` rows a label at most (smallest hash of
the id first), so the projection and the labelled vectors, all that is
broadcast, have a fixed size of about 3 MB.  Document frequencies are added up
over all documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from spendlens.llm import common

TERMS = 2048
DIMS = 64
#: Labelled rows of each label that the model keeps, at most.
PER_LABEL = 2000
NEIGHBOURS = 15
#: Power of the similarity that weights a neighbour's label.
SHARPNESS = 8
BLOCK = 256
THRESHOLD = 0.3
#: What a model gets from the labelled sample.
LEARNT = ("axes", "vectors", "labels")


@cache
def _classes() -> np.ndarray:
    """Class of each code point below 2**16: 1 lower case, 2 upper case, 3 digit, 4 line end, 5 space,
    32.. each ASCII mark by itself, 8 other marks, 9 other letters."""
    table = np.full(1 << 16, 8, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        if kind == "Ll" or kind == "Mn":
            table[c] = 1
        elif kind == "Lu":
            table[c] = 2
        elif kind[0] == "L":
            table[c] = 9
        elif kind[0] == "N":
            table[c] = 3
        elif c in (10, 13):
            table[c] = 4
        elif kind[0] == "Z" or c in (9, 11, 12):
            table[c] = 5
        elif c < 128:
            table[c] = 32 + c
    return table


def term_counts(text: str) -> np.ndarray:
    """Counts of a text's ``TERMS`` hashed shape terms; the last one counts repeated words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shape = _classes()[np.minimum(points, (1 << 16) - 1)]
    if len(shape):
        letter = (shape == 1) | (shape == 2) | (shape == 9)
        keep = np.ones(len(shape), bool)
        keep[1:] = ~letter[1:] | (shape[1:] != shape[:-1])
        shape = shape[keep]
    padded = np.concatenate([[4], shape, [4, 4]]).astype(np.uint32)
    code = padded[:-3] if len(padded) > 3 else np.empty(0, np.uint32)
    for i in (1, 2, 3):
        code = code * np.uint32(0x01000193) ^ padded[i:len(padded) - 3 + i][:len(code)]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(8)
    counts = np.bincount(code % np.uint32(TERMS - 1), minlength=TERMS).astype(np.float32)
    words = text.split()
    counts[TERMS - 1] = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    return counts


def _counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their term counts."""
    for batch in common.slices(batches):
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            yield part, np.stack([term_counts(t or "") for t in part.column("text").to_pylist()])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a term and task: documents of the task that have the term."""
    total, docs = np.zeros(TERMS, np.int64), 0
    for part, counts in _counts_of(batches):
        total += (counts > 0).sum(0)
        docs += part.num_rows
    if docs:
        yield pa.RecordBatch.from_pydict({"term": list(range(TERMS)) + [-1], "n": total.tolist() + [docs]})


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and counts of each row, the ones it has only."""
    for part, counts in _counts_of(batches):
        at = [np.flatnonzero(c) for c in counts]
        yield pa.RecordBatch.from_pydict({
            "label": part.column("label"), "terms": pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()),
            "counts": pa.array([c[a].astype(np.uint32).tobytes() for a, c in zip(at, counts, strict=True)], pa.binary())})


def _dense(rows: list) -> np.ndarray:
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, (_, terms, count) in enumerate(rows):
        counts[i, np.frombuffer(terms, np.uint16)] = np.frombuffer(count, np.uint32)
    return counts


@dataclass
class Model:
    """Inverse document frequencies, projection, labelled unit vectors and their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts) * self.idf
        vectors = weighted @ self.axes
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / np.where(norm > 0, norm, 1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors.

        Without a similar one (an empty text, say) it is the labels' mean; without labels, one half.
        """
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1)
        return np.where(total > 0, vote / np.where(total > 0, total, 1), self.labels.mean())


def _learn(idf: np.ndarray):
    """The projection and the labelled vectors, from all labelled rows (``PER_LABEL`` a label at most)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        blocks = [slice(lo, lo + BLOCK) for lo in range(0, len(rows), BLOCK)]
        gram = np.zeros((TERMS, TERMS))
        for block in blocks:
            weighted = np.log1p(_dense(rows[block])) * idf
            norm = np.linalg.norm(weighted, axis=1, keepdims=True)
            weighted /= np.where(norm > 0, norm, 1)
            gram += weighted.T @ weighted
        axes = np.ascontiguousarray(np.linalg.eigh(gram)[1][:, ::-1][:, :DIMS], np.float32)
        model = Model(idf, axes, np.zeros((len(rows), DIMS), np.float32), np.array([r[0] for r in rows], np.float64))
        for block in blocks:
            model.vectors[block] = model.embed(_dense(rows[block]))
        yield pa.RecordBatch.from_pydict({k: pa.array([getattr(model, k).tobytes()], pa.binary()) for k in LEARNT})
        del rows, gram
        common.release()
    return run


def fold(doc_id=None):
    """0 for held-out rows: crc32 of the id as text, modulo 5."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows outside the held-out fold.

    A doc_id labelled more than once counts by its smallest label, one with
    several texts by the least of them; null ids and null labels are left out.
    One task holds the labelled rows' term counts, a few MB, and some square
    matrices of ``TERMS``; the driver gets the model alone.
    """
    common.bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = (labels.where("doc_id is not null and quality is not null").where(fold() != 0)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label")))
    sample = None
    for label in (0, 1):
        some = (known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_LABEL))
        sample = some if sample is None else sample.unionByName(some)
    # PER_LABEL rows a label at most, so that the texts needn't be shuffled to meet them.
    rows = (texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
            .select("text", "label").mapInArrow(_raw, "label int, terms binary, counts binary"))  # some MB a label
    found = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(_frequencies, "term long, n long")
             .groupBy("term").agg(F.sum("n").alias("n")).collect()}  # TERMS + 1 rows
    df = np.array([found.get(t, 0) for t in range(TERMS)], np.float64)
    idf = np.log((1 + found.get(-1, 0)) / (1 + df)).astype(np.float32)
    learnt = rows.repartition(1).mapInArrow(_learn(idf), ", ".join(f"{k} binary" for k in LEARNT)).first()
    if learnt is None:
        return Model(idf, np.zeros((TERMS, DIMS), np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0))
    return Model(idf, np.frombuffer(learnt["axes"], np.float32).reshape(TERMS, DIMS),
                 np.frombuffer(learnt["vectors"], np.float32).reshape(-1, DIMS), np.frombuffer(learnt["labels"], np.float64))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score as ``column``, which replaces one of that name.

    Null texts are scored as empty ones.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)
    docs = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in _counts_of(batches):
            values = held.value.score(counts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())],
                                             names=[*part.schema.names, column])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(column, DoubleType()))


def op5_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, common.read_table(spark, sf_dir, "labels"))
    return (score(docs, model)
            .select("doc_id", (F.coalesce(fold(), F.lit(1)) == 0).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
