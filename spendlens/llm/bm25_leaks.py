"""Benchmark decontamination by a BM25 index of the test items with block maxima.

The test items are the indexed documents; every passage of every training text
is a query.  Impacts are BM25 weights divided by the item's score against
itself, so one threshold says which share of an item's weight a passage has.

Items lie in blocks of ``BLOCK``, and for each term the index keeps the largest
impact in a block.  As in block-max WAND, the sum of a passage's block maxima
bounds every score in the block; blocks whose bound is below the threshold are
skipped unscored, so all items above it are found.  Block maxima of a slice's
passages are added up at once.  What is retrieved is then verified: a leak has
enough of the word n-grams of the item's question (all but its last sentence)
and of its answer (the last sentence) in the passage.

The index is broadcast.  Items beyond ``INDEX_BYTES`` of text go into further
indexes, each with a pass of its own over the training texts.  Document
frequencies, the number of items, their mean length and the span are those of
all items, so the rows do not depend on how many indexes there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import common

K1, B = 1.2, 0.75
BLOCK = 4
#: Share of an item's own score that a passage must reach to be retrieved.
THRESHOLD = 0.6
#: Share of the n-grams of question and of answer that verify a leak.
OVERLAP = 0.6
GRAM = 5
INDEX_BYTES = 4 << 20
#: Block maxima or their sums held at once.
CELLS = 4 << 20

LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, " \
        "start int, stop int"
_WORD = re.compile(r"\w+")
_WORD_OR_END = re.compile(r"\w+|\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of a part's n-grams in a passage; a shorter part is one gram, an empty one is found."""
    n = min(GRAM, len(part))
    return len(grams_of(part, n) & grams_of(passage, n)) / len(grams_of(part, n)) if n else 1.0


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all but the last sentence, and of the last; a single sentence is both."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(parts) < 2:
        return words_of(text), words_of(text)
    return [w for p in parts[:-1] for w in p], parts[-1]


@dataclass
class Stats:
    """Of all items, whatever the index: how many, their words, the longest one, and items by word."""

    count: int
    words: int
    span: int
    found: dict[str, int]


@dataclass
class Index:
    """Terms, items, impacts as sparse postings, and block maxima as one row a term."""

    terms: dict[str, int]
    items: list[tuple[int, str]]
    postings: list[tuple[np.ndarray, np.ndarray]]
    span: int

    @classmethod
    def build(cls, items: list[tuple[int, str]], stats: Stats | None = None) -> Index:
        """An index of ``items``, weighted by ``stats`` (without them, by these items alone)."""
        items = sorted((i, t) for i, t in items if i is not None and words_of(t))
        texts = [words_of(t) for _, t in items]
        stats = stats or Stats(len(texts), sum(map(len, texts)), max(map(len, texts), default=1),
                               Counter(w for t in texts for w in set(t)))
        mean = stats.words / max(1, stats.count)
        terms = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        idf = {w: np.log1p((stats.count - stats.found[w] + 0.5) / (stats.found[w] + 0.5)) for w in terms}
        lists: list[list[tuple[int, float]]] = [[] for _ in terms]
        for k, text in enumerate(texts):
            weight = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(text) / mean))
                      for w, n in Counter(text).items()}
            own = sum(weight.values())
            for w, x in weight.items():
                lists[terms[w]].append((k, x / own))
        postings = [(np.array([k for k, _ in p], np.int64), np.array([x for _, x in p])) for p in lists]
        return cls(terms, items, postings, stats.span)

    @property
    def blocks(self) -> int:
        return -(-len(self.items) // BLOCK)

    @cached_property
    def block_lists(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each term its blocks and the largest impact in each."""
        out = []
        for ids, impacts in self.postings:
            blocks, first = np.unique(ids // BLOCK, return_index=True)  # ids ascend
            out.append((blocks, np.maximum.reduceat(impacts, first).astype(np.float32)))
        return out

    @cached_property
    def table(self) -> np.ndarray | None:
        """``maxima`` of all terms where they are no more than ``CELLS``."""
        return self._dense(range(len(self.terms))) if len(self.terms) * self.blocks <= CELLS else None

    def _dense(self, terms: Iterable[int]) -> np.ndarray:
        terms = list(terms)
        out = np.zeros((len(terms), self.blocks), np.float32)
        for row, t in zip(out, terms, strict=True):
            blocks, largest = self.block_lists[t]
            row[blocks] = largest
        return out

    def _rows(self, terms: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[terms]
        distinct, at = np.unique(terms, return_inverse=True)
        return self._dense(distinct.tolist())[at]

    def sums(self, terms: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """Block maxima added up by group (ascending), about ``CELLS`` at a time."""
        total = np.zeros((groups, self.blocks), np.float32)
        step = max(1, CELLS // max(1, self.blocks))
        for lo in range(0, len(terms), step):
            some, mine = terms[lo:lo + step], group[lo:lo + step]
            first = np.flatnonzero(np.diff(mine, prepend=-1))
            total[mine[first]] += np.add.reduceat(self._rows(some), first, axis=0)
        return total

    @cached_property
    def parts(self) -> list[tuple[list[str], list[str]]]:
        return [question_answer(t) for _, t in self.items]

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers (-1 for words not in the index) of all texts on end, and where each text's begin."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        # Words of the distinct runs between white space, each run closed by a line end.
        words = _WORD_OR_END.findall("\n".join([*coded.dictionary.to_pylist(), ""]).lower())
        number = np.fromiter((-2 if w == "\n" else self.terms.get(w, -1) for w in words), np.int64, len(words))
        end = np.flatnonzero(number == -2)
        first = np.concatenate([[0], end[:-1] + 1])[:len(end)]
        index = coded.indices.to_numpy()
        each = (end - first)[index]
        before = np.concatenate([[0], np.cumsum(each)])
        flat = number[np.repeat(first[index] - before[:-1], each) + np.arange(before[-1])]
        offsets = np.asarray(lists.offsets, np.int64)
        return flat, before[offsets - offsets[0]]

    def retrieve(self, flat: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, from word, to word, item, score) of passages that reach the threshold.

        Passages are two spans of words long and begin one span apart, a span
        being the longest item, so every item's words lie whole in one of them.
        """
        size = np.diff(at)
        count = np.maximum(1, -(-size // self.span))
        start = np.repeat(at[:-1] - self.span * (np.cumsum(count) - count), count) + self.span * np.arange(count.sum())
        text = np.repeat(np.arange(len(size)), count)
        for p in self._bounded(flat, start, text, threshold * 0.999):
            lo, hi = int(start[p]), int(min(start[p] + 2 * self.span, at[text[p] + 1]))
            terms = np.unique(flat[lo:hi])
            terms = terms[terms >= 0]
            # Each term once: the query's own bound.
            if len(terms) * self.blocks <= CELLS:
                sure = self._rows(terms).sum(0) >= threshold * 0.999
            else:
                sure = self.sums(terms, np.zeros(len(terms), np.int64), 1)[0] >= threshold * 0.999
            if not sure.any():
                continue
            scores = np.zeros(len(self.items))
            for t in terms.tolist():
                ids, impacts = self.postings[t]
                open_ = sure[ids // BLOCK]
                scores[ids[open_]] += impacts[open_]
            for k in np.flatnonzero(scores >= threshold).tolist():
                yield int(text[p]), lo - int(at[text[p]]), hi - int(at[text[p]]), k, float(scores[k])

    def _bounded(self, flat: np.ndarray, start: np.ndarray, text: np.ndarray, least: float) -> Iterator[int]:
        """Passages (a span and the next one of the same text) that have a block whose bound is ``least`` or more."""
        known = np.flatnonzero(flat >= 0)
        edge = np.append(np.searchsorted(known, start), len(known))
        span = np.repeat(np.arange(len(start)), np.diff(edge))
        goes_on = np.append(text[:-1] == text[1:], False)
        step = max(1, CELLS // max(1, self.blocks))
        for a in range(0, len(start), step):
            b = min(a + step, len(start))
            lo, hi = edge[a], edge[min(b + 1, len(start))]
            total = self.sums(flat[known[lo:hi]], span[lo:hi] - a, b - a + 1)
            total[:-1] += np.where(goes_on[a:b, None], total[1:], 0)
            yield from (np.flatnonzero((total[:-1] >= least).any(1)) + a).tolist()


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "part": batch.column("part"), "n_words": pa.array(map(len, words), pa.int64()),
            "words": pa.array([list(set(w)) for w in words], pa.list_(pa.string()))})


def _searcher(index, threshold: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Index = index.value
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                            ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()),
                            ("start", pa.int32()), ("stop", pa.int32())])
        for batch in common.slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            best: dict[tuple[int, int], tuple] = {}
            words: dict[int, list[str]] = {}
            for i, lo, hi, k, score in items.retrieve(*items.numbers(texts), threshold):
                if i not in words:
                    words = {i: words_of(texts[i].as_py())}
                passage = words[i][lo:hi]
                question, answer = (overlap(part, passage) for part in items.parts[k])
                if min(question, answer) >= least:
                    row = (ids[i], items.items[k][0], score, question, answer, lo, hi)
                    best[i, k] = max(best.get((i, k), row), row, key=lambda r: (r[2], -r[5]))
            if best:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in best.values()], schema)
    return run


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """One row for each row of ``docs`` and test item it leaks, with its best passage.

    ``docs`` has doc_id and text, ``items`` item_id and text.  Null or wordless
    texts match nothing; items without id or words are left out; a null doc_id
    is kept as such.  Without items there are no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    indexes = max(1, -(-size // INDEX_BYTES))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(indexes)))
    words = common.cut(items.select("part", "text").mapInArrow(_item_words, "part long, n_words long, words array<string>")
                       .where("n_words > 0"))
    count, total, span = words.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0)),
                                   F.coalesce(F.max("n_words"), F.lit(1))).first()
    each = words.select("part", F.explode("words").alias("word")).groupBy("word", "part").agg(F.count("*").alias("n"))
    each = common.cut(each)
    every = common.cut(each.groupBy("word").agg(F.sum("n").alias("n")))
    found = None
    for k in range(indexes):
        mine = items.where(F.col("part") == k).select("item_id", "text").collect()  # INDEX_BYTES of text
        of_part = every.join(each.where(F.col("part") == k).select("word"), "word").select("word", "n").collect()  # their words
        stats = Stats(count, total, span, dict(map(tuple, of_part)))
        index = spark.sparkContext.broadcast(Index.build([tuple(r) for r in mine], stats))
        rows = docs.mapInArrow(_searcher(index, threshold, least), LEAKS)
        found = rows if found is None else found.unionByName(rows)
    return found


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak a test item; rows with a null doc_id stay."""
    leaks = find_leaks(docs, items).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def op8_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
