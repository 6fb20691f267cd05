"""Spelling variants: words one edit apart, and the frequent form behind a rare word.

The vocabulary is sorted and cut into blocks.  A sorted block is scanned with
the edit matrix of a query, list word down, query across, of which only the
three cells around the diagonal can matter.  Words that follow each other share
their first LCP letters and hence these rows of the matrix: a row is computed
once for all words that share its prefix, and where no cell of it is below two,
the whole range of words with that prefix is skipped.  Many queries go through a
block at once, a row of theirs at a time.

Two words of one edit share at least about half of the shorter one at their
beginning or at their end.  So each word starts at the range of the sorted list
that has its first half, and once more, read backwards, in the sorted list of
reversed words; the length of the common beginning decides which scan may
report a pair.  A word visits the blocks that its range meets; of several, those
whose common prefix its matrix allows.
"""

from __future__ import annotations

import os.path
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import common

MIN_LENGTH = 7
MIN_COUNT = 2
#: How many times as frequent as a word its form must be.
RATIO = 10
#: One of so many runs loses a code point.
DROP_EVERY = 31
#: Words of a block, words a task counts before it hands them on, and queries that a block is scanned with at once.
BLOCK_WORDS = 50_000
COUNTED_WORDS = 300_000
QUERY_ROWS = 5_000
#: Code points of a block's first and last word that are sent to all tasks.
EDGE = 64

#: Letters of a run, and the ones that have a lower case here.
LETTERS = "A-Za-zÀ-ÿ"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

NEAR = "word string, n_near long, best_n long, best string"


def _counted(min_length: int, drop_every: int):
    run_of_letters = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()),
                                              "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return out

        for batch in common.slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(run_of_letters.findall(text)).items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    if drop_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < min_length:
                                continue
                    total[word] += n
                if len(total) >= COUNTED_WORDS:
                    yield emit()
        yield emit()
    return run


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = 0) -> DataFrame:
    """(word, n) of the runs of letters in all whole texts, A-Z lower-cased, that are long and frequent enough.

    With ``drop_every``, a run whose crc32 of ``doc_id:run`` it divides loses the
    code point at the crc modulo its length first.  Null and empty texts have no
    words, a null doc_id counts as an empty one; other columns aren't read.
    """
    common.bounded_batches(docs.sparkSession)
    return (docs.select("doc_id", "text").mapInArrow(_counted(min_length, drop_every), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def half(shorter: int) -> int:
    """Code points that two words of one edit, the shorter of this length, share at one of their ends at least."""
    return shorter // 2  # all but the edited one, in two parts: (shorter - 1) / 2 rounded up


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words on end, where each begins, and their lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.cumsum(size) - size, size


def _next_row(e, c: np.ndarray, q: np.ndarray, at: np.ndarray, size: np.ndarray, d: int):
    """Row d + 1 of the matrices from row d: cells of the query's first d, d + 1 and d + 2 code points, 2 for more.

    ``c`` is the list word's code point d, ``q``, ``at`` and ``size`` the queries' code points, starts and lengths.
    """
    last = max(len(q) - 1, 0)

    def differs(j: int) -> np.ndarray:
        return q[np.minimum(at + max(j, 0), last)] != c

    low = np.minimum(e[0] + differs(d - 1), e[1] + 1) if d else e[1] + 1
    mid = np.minimum(np.minimum(e[1] + differs(d), e[2] + 1), low + 1)
    high = np.minimum(e[2] + differs(d + 1), mid + 1)
    cells = [np.where(size >= d + k, np.minimum(x, 2), 2).astype(np.int8) for k, x in enumerate((low, mid, high))]
    return cells


class Block:
    """Sorted distinct words with the LCPs of neighbours."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.flat, self.at, self.size = _points(words)
        lcp = np.zeros(len(words), np.int64)
        same = np.arange(1, len(words))
        while len(same):
            d = int(lcp[same[0]])
            same = same[(self.size[same - 1] > d) & (self.size[same] > d)]
            same = same[self.flat[self.at[same - 1] + d] == self.flat[self.at[same] + d]]
            lcp[same] += 1
        #: Places where a word departs from the one above it after d code points, for each d.
        self.departs = np.argsort(lcp[1:], kind="stable") + 1
        self.level = np.searchsorted(lcp[self.departs], np.arange(int(lcp.max(initial=0)) + 2))

    def departures(self, d: int) -> np.ndarray:
        if d + 1 >= len(self.level):
            return self.departs[:0]
        return self.departs[self.level[d]:self.level[d + 1]]

    def prefix_range(self, prefix: str) -> tuple[int, int]:
        beyond = prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix[-1] < "\U0010ffff" else None
        lo = bisect_left(self.words, prefix)
        return lo, bisect_left(self.words, beyond, lo) if beyond else len(self.words)

    def near(self, queries: list[str], shared: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs one edit apart that share the query's first ``shared`` code points."""
        ranges = np.array([self.prefix_range(q[:k]) for q, k in zip(queries, shared, strict=True)], np.int64).reshape(-1, 2)
        points, starts, sizes = _points(queries)
        shared = np.array(shared, np.int64)
        found_q, found_w = [], []
        waiting = np.flatnonzero(ranges[:, 0] < ranges[:, 1])
        waiting = waiting[np.argsort(shared[waiting], kind="stable")]
        begins = shared[waiting]
        # The frontier: query, range of words that share d code points, and the matrix row of these.
        query, lo, hi = (np.empty(0, np.int64) for _ in range(3))
        row = [np.empty(0, np.int8) for _ in range(3)]
        d = int(begins[0]) if len(begins) else 0
        while len(query) or len(waiting):
            if not len(query):
                d = int(begins[0])
            new = waiting[:np.searchsorted(begins, d, side="right")]
            waiting, begins = waiting[len(new):], begins[len(new):]
            if len(new):
                query = np.concatenate([query, new])
                lo, hi = np.concatenate([lo, ranges[new, 0]]), np.concatenate([hi, ranges[new, 1]])
                exact = [np.ones(len(new), np.int8), np.zeros(len(new), np.int8),
                         np.where(sizes[new] > d, 1, 2).astype(np.int8)]
                row = [np.concatenate([a, b]) for a, b in zip(row, exact, strict=True)]
            # Words that end here.
            ends = self.size[lo] == d
            cell = sizes[query] - d + 1  # the query's end, among the three cells
            inside = ends & (cell >= 0) & (cell <= 2)
            hit = inside.copy()
            hit[inside] = np.stack(row)[cell[inside], np.flatnonzero(inside)] == 1
            found_q.append(query[hit])
            found_w.append(lo[hit])
            # Ranges of one code point more: at the first word, if it goes on, and at each departure after d.
            at_d = self.departures(d)
            a, b = np.searchsorted(at_d, lo, side="right"), np.searchsorted(at_d, hi)
            goes_on = ~ends
            count = b - a + goes_on
            parent = np.repeat(np.arange(len(query)), count)
            place = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
            first = goes_on[parent] & (place == 0)
            start = np.where(first, lo[parent], 0)
            start[~first] = at_d[(a[parent] + place - goes_on[parent])[~first]]
            stop = np.append(start[1:], 0)
            final = place == count[parent] - 1
            stop[final] = hi[parent[final]]
            query = query[parent]
            row = _next_row([e[parent] for e in row], self.flat[self.at[start] + d], points, starts[query], sizes[query], d)
            alive = np.minimum(np.minimum(row[0], row[1]), row[2]) < 2
            query, lo, hi, row = query[alive], start[alive], stop[alive], [e[alive] for e in row]
            d += 1
        nothing = [np.empty(0, np.int64)]
        return np.concatenate(found_q or nothing), np.concatenate(found_w or nothing)


def allows(query: str, prefix: str) -> bool:
    """Whether words that begin with ``prefix`` can be one edit from the query: its matrix row has a cell below two."""
    q, _, _ = _points([query])
    e = [np.array([2]), np.array([0]), np.array([1 if query else 2])]
    for d, c in enumerate(prefix):
        e = _next_row(e, np.array([ord(c)], np.uint32), q, np.array([0]), np.array([len(query)]), d)
        if min(x[0] for x in e) > 1:
            return False
    return True


def _shared_start(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def _route(edges, min_length: int):
    """Each word as a query of the blocks that its range meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, first, last = edges.value
        own = [os.path.commonprefix(pair) for pair in zip(first, last, strict=True)]
        for batch in batches:
            to, at = [], []
            for i, word in enumerate(batch.column("key").to_pylist()):
                prefix = word[:half(max(len(word) - 1, min_length))][:EDGE]
                k = bisect_left(last, prefix)
                stop = k
                while stop < len(blocks) and first[stop][:len(prefix)] <= prefix:
                    stop += 1
                met = range(k, stop) if stop - k < 2 else [j for j in range(k, stop) if allows(word, own[j])]
                to += [blocks[j] for j in met]
                at += [i] * len(met)
            keys = batch.column("key").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([True] * len(to)), keys,
                                              pa.array([None] * len(to), pa.int64())], names=["block", "query", "key", "n"])
    return run


def _scan(backward: bool, min_length: int):
    """Blocks' words, each followed by the block's queries; gives a summary of each query's near words there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        words: list[str] = []
        counts: list[int] = []

        def answer(queries: list[str]) -> pa.RecordBatch:
            found: dict[int, list] = {}
            if block and queries:
                shared = [half(max(len(q) - 1, min_length)) for q in queries]
                for q, w in zip(*(x.tolist() for x in block.near(queries, shared)), strict=True):
                    mine, other, n = queries[q], block.words[w], block.counts[w]
                    if backward:
                        mine, other = mine[::-1], other[::-1]
                    # A common beginning of half of the shorter word or more: the forward scan's pair.
                    if (_shared_start(mine, other) < half(min(len(mine), len(other)))) != backward:
                        continue
                    seen = found.setdefault(q, [mine, 0, (0, "")])
                    seen[1] += 1
                    if seen[1] == 1 or (-n, other) < seen[2]:
                        seen[2] = (-n, other)
            rows = list(found.values())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([-r[2][0] for r in rows], pa.int64()), pa.array([r[2][1] for r in rows], pa.string())],
                names=["word", "n_near", "best_n", "best"])

        for batch in batches:
            place, is_query = batch.column("block").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(place * 2 + is_query)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if place[lo] != number:
                    number, block, words, counts = place[lo], None, [], []
                keys = batch.column("key").slice(lo, hi - lo).to_pylist()
                if not is_query[lo]:
                    words += keys
                    counts += batch.column("n").slice(lo, hi - lo).to_pylist()
                    continue
                if block is None and words:
                    block = Block(words, counts)
                for k in range(0, len(keys), QUERY_ROWS):
                    yield answer(keys[k:k + QUERY_ROWS])
    return run


def _one_way(vocab: DataFrame, backward: bool, min_length: int, parts: int) -> DataFrame:
    spark = vocab.sparkSession
    keyed = vocab.select((F.reverse("word") if backward else F.col("word")).alias("key"), "n")
    listed = common.cut(keyed.repartitionByRange(parts, "key").sortWithinPartitions("key")
                        .select(F.spark_partition_id().alias("block"), F.lit(False).alias("query"), "key", "n"))
    edges = sorted((r["first"], r["last"], r["block"]) for r in listed.groupBy("block").agg(
        F.substring(F.min("key"), 1, EDGE).alias("first"), F.substring(F.max("key"), 1, EDGE).alias("last")).collect())
    # Two short strings a block of BLOCK_WORDS words.
    held = spark.sparkContext.broadcast(([b for _, _, b in edges], [a for a, _, _ in edges], [z for _, z, _ in edges]))
    asked = listed.select("key").mapInArrow(_route(held, min_length), "block int, query boolean, key string, n long")
    return (listed.unionByName(asked).repartition(parts, "block").sortWithinPartitions("block", "query", "key")
            .mapInArrow(_scan(backward, min_length), NEAR))


def near_words(vocab: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n_near, best_n, best: words with a near word, and the most frequent one (ties: the least) of these.

    ``vocab`` has (word, n), each word once and of ``min_length`` code points or more.
    """
    common.bounded_batches(vocab.sparkSession)
    parts = max(1, -(-vocab.count() // BLOCK_WORDS))
    both = [_one_way(vocab, backward, min_length, parts) for backward in (False, True)]
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (both[0].unionByName(both[1]).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round doubles the way, and a form is ``RATIO`` times as frequent as its word."""
    links = common.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = common.cut(links.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not step.where("moved").limit(1).count():
            return links
        links = step.drop("moved")


def variant_groups(vocab: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocab`` (word, n).

    Two words are near if one inserted, deleted or replaced code point makes one
    the other.  ``form`` is the near word of largest n (ties: the least), if that
    is at least ``ratio`` times the word's n, else null; ``root`` the last of
    word, form, form's form and so on.  No words, no rows; words shorter than
    ``min_length`` or null are left out, and a repeated word counts by the sum of its n.
    """
    if min_length < 2 or ratio < 2:
        raise ValueError("min_length and ratio must be 2 or more")
    vocab = common.cut(vocab.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")))
    known = common.cut(vocab.join(near_words(vocab, min_length), "word", "left").withColumn(
        "form_n", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n"))).withColumn(
        "form", F.when(F.col("form_n").isNotNull(), F.col("best"))))
    roots = _roots(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return variant_groups(vocabulary(docs, drop_every=DROP_EVERY))
