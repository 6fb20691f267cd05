"""Repeated passages by sparse suffix arrays.

A passage of ``MIN_WORDS`` words or more that occurs again later (in the order
of doc_id and position) is found as follows; words are compared by A-Z
lower-cased hashes.

1. Texts that are equal throughout become one entry; copies repeat it whole.
2. Anchors: of each ``SPAN`` word ``GRAM``-grams in a row the one with the least
   hash is kept (a minimiser), so every passage of MIN_WORDS words has an anchor,
   chosen by its own content, and equal passages have equal anchors.
3. Around an anchor, a repeated passage reaches at least ``REACH`` words on to
   the right or to the left of the gram.  So the suffix at the anchor (or, read
   backwards, the prefix) shares its first GRAM + REACH words with its
   counterpart; suffixes whose key is alone are dropped.  A text that repeats a
   line over and over has one row for all places of the same surrounding.
4. The rest are sorted: by key, the words beyond it, the words on the other
   side.  In this sparse suffix array each suffix is compared with its nearest
   neighbours of earlier place, above and below, and the match extended left
   and right.  Sorted runs may be cut anywhere: what a partition's ends still
   need (its stacks of nearest earlier places, a few rows) meets in a second,
   small pass.
5. A neighbour shares the most words on the sorted side, perhaps not on the
   other.  So the first suffix of each surrounding also gives a digest of each
   passage of MIN_WORDS words that its anchor stands for, and equal digests of different
   places are matches as well.
6. Matches of one document are merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm import common

MIN_WORDS = 50
GRAM = 16
#: Suffixes of one sorted range.
RANGE_SUFFIXES = 100_000

#: ``places`` holds those of all ``keys`` on end, the ones of key i from ``at[i]`` to before ``at[i + 1]``: a flat
#: row takes two thirds of the room that a struct and a list for each key do.
ANCHORS = "entry long, doc_id long, h1 long, h2 long, n_words int, keys array<long>, at array<int>, places array<int>"
#: ``own``: the least number of words beyond the key (times 64) and how many more, of the passages whose anchor this is.
#: ``more``: the further places of the same surrounding in the same text.
SUFFIXES = "key long, further binary, other binary, doc_id long, pos int, back boolean, own int, more array<int>"
MATCHES = "doc_id long, start int, stop int, of_doc_id long, of_start int, edge boolean, first boolean, " \
          "key long, further binary, other binary, pos int, back boolean, own int"
WINDOWS = "passage long, doc_id long, start int"
SPANS = "doc_id long, start int, stop int, of_doc_id long, of_start int"


def _reach(min_words: int) -> int:
    return (min_words - GRAM) // 2


def anchors(words: np.ndarray, min_words: int) -> np.ndarray:
    """Positions of the minimisers: least gram hash of each window, the last of equal ones."""
    return _minimisers(words, np.array([0, len(words)]), min_words)[0]


def _minimisers(words: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts between ``offsets``; first and last start of the passages that each is chosen by.

    All texts at once: most are short, and a call for each costs more than its words.
    """
    if len(words) < min_words:
        return (np.empty(0, np.int64),) * 3
    chosen = _anchor_of_windows(common.gram_hashes(words, GRAM), min_words - GRAM + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:len(chosen)]
    start = np.flatnonzero(np.arange(min_words, min_words + len(chosen)) <= ends)  # no passage runs into the next text
    new = np.flatnonzero(np.diff(chosen[start], prepend=-1))
    return chosen[start[new]], start[new], start[np.concatenate([new[1:], [len(start)]])[:len(new)] - 1]


def _anchor_of_windows(grams: np.ndarray, span: int) -> np.ndarray:
    """For each passage, by its start, the position of its anchor.

    Least values of 2, 4, 8 .. grams in a row, the last of equal ones; two such runs cover a passage.
    """
    least, at, width = grams, np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        later = least[step:] <= least[:-step]
        least, at = np.minimum(least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        width += step
    return at


def _keys(words: np.ndarray, at: np.ndarray, min_words: int, low=0, high=None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the gram and the reach to its right, and to its left; 0 where the text (``low`` to ``high``) ends before."""
    size = GRAM + _reach(min_words)
    ahead, behind = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    fits = at + size <= (len(words) if high is None else high)
    ahead[fits] = common.gram_hashes(words, size, at[fits])
    first = at + GRAM - size
    fits = first >= low
    behind[fits] = ~common.gram_hashes(words, size, first[fits])  # another key space
    return ahead, behind


def _text_keys() -> dict[str, Column]:
    """What tells texts apart: two 64-bit hashes of different seeds."""
    return {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("text"), "text")}


def _lists(counts: np.ndarray, values: np.ndarray, kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.astype(kind)))


def _anchor_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = TaskContext.get().partitionId() << 36
        for batch in common.slices(batches, share=common.WORDS_SHARE):
            words, offsets = common.word_hashes(batch.column("text"))
            n = batch.num_rows
            anchor = _minimisers(words, offsets, min_words)[0]
            text = np.searchsorted(offsets, anchor, side="right") - 1
            both = np.stack(_keys(words, anchor, min_words, offsets[text], offsets[text + 1]), 1).ravel()
            # place 2 i is the key ahead of anchor i, 2 i + 1 the one behind
            place = np.flatnonzero(both)
            key, text = both[place], np.repeat(text, 2)[place]
            order = np.lexsort((key, text))  # a stable sort
            place, key, text = place[order], key[order], text[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            n_keys, n_places = np.bincount(text[first], minlength=n), np.bincount(text, minlength=n)
            before = np.cumsum(n_places) - n_places
            starts = np.insert(first - before[text[first]], np.cumsum(n_keys), n_places)
            place = place - 2 * np.searchsorted(anchor, offsets)[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(entry, entry + n)), *(batch.column(c) for c in ("doc_id", "h1", "h2")),
                 pa.array(np.diff(offsets), pa.int32()), _lists(n_keys, common.as_signed(key[first]), np.int64),
                 _lists(n_keys + 1, starts, np.int32), _lists(n_places, place, np.int32)],
                names=["entry", "doc_id", "h1", "h2", "n_words", "keys", "at", "places"])
            entry += n
    return run


def _codes(words: np.ndarray, start: np.ndarray, step: np.ndarray, low: np.ndarray, high: np.ndarray, most: int
           ) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` words from ``start`` on, forwards or backwards, within a text; 4 bytes each, 0 beyond it, and how many."""
    at = start[:, None] + step[:, None] * np.arange(most)
    there = (at >= low[:, None]) & (at < high[:, None])
    return np.where(there, words.astype(np.uint32)[np.clip(at, 0, len(words) - 1)], 0).astype(np.uint32), there.sum(1)


def _binary(codes: np.ndarray, n: np.ndarray) -> pa.Array:
    data = codes.astype(">u4")[np.arange(codes.shape[1]) < n[:, None]]
    ends = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _suffix_rows(min_words: int):
    """Suffixes of the wanted anchors (``places``: the anchor's number doubled, odd for the backward one).

    Those of one text that have the same surrounding are one row, however often the text repeats it.
    """
    reach = _reach(min_words)
    most = min_words - GRAM - reach  # words beyond the key, and on its other side, that a window can still need
    weights = common.mix(np.arange(1, 2 * most + 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, share=common.WORDS_SHARE):
            words, offsets = common.word_hashes(batch.column("text"))
            anchor, first, last = _minimisers(words, offsets, min_words)
            places = batch.column("places")
            place = places.flatten().to_numpy()
            text = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            mine, back = np.searchsorted(anchor, offsets)[text] + (place >> 1), place % 2 == 1
            order = np.lexsort((anchor[mine], back, text))
            text, mine, back = text[order], mine[order], back[order]
            p, first, last, low, high = anchor[mine], first[mine], last[mine], offsets[text], offsets[text + 1]
            key = np.where(back, *_keys(words, p, min_words, low, high)[::-1])
            step = np.where(back, -1, 1)
            edge = np.where(back, p - reach, p + GRAM + reach)  # passages of a backward one reach less than ``reach`` beyond the gram
            further, n_further = _codes(words, np.where(back, edge - 1, edge), step, low, high, most)
            other, n_other = _codes(words, np.where(back, p + GRAM, p - 1), -step, low, high, most)
            least = np.maximum(np.where(back, edge - last, first + min_words - edge), 0)
            own = least * 64 + np.maximum(
                np.minimum(np.where(back, edge - first, last + min_words - edge), most) - least + 1, 0)
            # Equal ones of a text, of ascending place: brought together by a hash, then compared.
            whole = np.column_stack([further, other, n_further, n_other])
            order = np.lexsort(((whole.astype(np.uint64) * weights).sum(1), key, text))
            same = np.ones(max(len(order) - 1, 0), bool)
            for column in (text, key, own, whole):
                equal = column[order[1:]] == column[order[:-1]]
                same &= equal if equal.ndim == 1 else equal.all(1)
            new = np.flatnonzero(np.concatenate([[True], ~same])[:len(order)])
            pos, keep = (p - low)[order], order[new]
            counts = np.diff(new, append=len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array(common.as_signed(key[keep])), _binary(further[keep], n_further[keep]), _binary(other[keep], n_other[keep]),
                 batch.column("doc_id").take(pa.array(text[keep])), pa.array(pos[new], pa.int32()), pa.array(back[keep]),
                 pa.array(own[keep], pa.int32()), _lists(counts - 1, np.delete(pos, new), np.int32)],
                names=["key", "further", "other", "doc_id", "pos", "back", "own", "more"])
    return run


def _shared(a: bytes, b: bytes) -> int:
    """Words that two codes have in common from the start."""
    low = min(len(a), len(b))
    if a[:low] == b[:low]:
        return low // 4
    differ = int.from_bytes(a[:low], "big") ^ int.from_bytes(b[:low], "big")
    return (low - (differ.bit_length() + 7) // 8) // 4


def _neighbours(min_words: int, edges: bool):
    """Compare each suffix of a sorted run with its nearest ones of earlier place above and below it."""
    reach = _reach(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[tuple] = []  # rows of the current key, of ascending place
        key, first_key, firsts, last = None, None, [], (None,) * 6

        def match(late: tuple, early: tuple, more: list[int] | None = None) -> None:
            _, further, other, (doc_id, pos), back, _ = late
            beyond, side = _shared(further, early[1]), _shared(other, early[2])
            if beyond + side + reach + GRAM < min_words:
                return
            left, right = (beyond + reach, side) if back else (side, beyond + reach)
            of_doc_id, of_start = early[3][0], early[3][1] - left
            if more is None:
                more = [pos]
            # Of spans that overlap the first gives the source; the others are one row.
            i = 0
            while i < len(more):
                end = i + 1
                while end < len(more) and more[end] - left <= more[end - 1] + GRAM + right:
                    end += 1
                for a, b in ((i, i), (i + 1, end - 1))[:min(end - i, 2)]:
                    out.append((doc_id, more[a] - left, more[b] + GRAM + right, of_doc_id, of_start, False, False,
                                None, None, None, None, None, None))
                i = end

        def keep(row: tuple, edge: bool) -> None:
            out.append((row[3][0], None, None, None, None, edge, not edge, row[0], row[1], row[2], row[3][1], row[4], row[5]))

        def emit() -> pa.RecordBatch:
            names = ["doc_id", "start", "stop", "of_doc_id", "of_start", "edge", "first", "key", "further", "other", "pos",
                     "back", "own"]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(),
                     pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.int32())
            columns = list(zip(*out)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            rows = zip(column["key"], column["further"], column["other"], zip(column["doc_id"], column["pos"]), column["back"],
                       column["own"])
            for row, more in zip(rows, column.get("more") or [None] * batch.num_rows, strict=True):
                place = row[3]
                again = row[0] == last[0] and row == last  # the same place again, from a repeated input row
                if not again:
                    if edges and (row[0] != last[0] or row[1] != last[1] or row[2] != last[2]):
                        keep(row, False)  # ties are in order of place, so the first stands for its surrounding
                    last = row
                    if row[0] != key:
                        stack, key = [], row[0]
                        first_key = key if first_key is None else first_key
                    while stack and stack[-1][3] > place:
                        match(stack.pop(), row)
                    # Texts that share a doc_id may have suffixes of equal place, which is not an earlier one.
                    above = next((r for r in reversed(stack) if r[3] < place), None) if stack else None
                    if above:
                        match(row, above)
                    elif key == first_key:
                        firsts.append(row)  # no earlier place above it in this run
                    if not (stack and stack[-1][1] == row[1] and stack[-1][2] == row[2]):  # else the one there stands for it
                        stack.append(row)
                if more:
                    match(row, stack[-1], more)
            common.handled(batch.nbytes)
            yield emit()
        if edges and key is not None:
            ends = {(r[0], *r[3:]): r for r in [*firsts, *stack]}
            for row in ends.values():
                keep(row, True)
            yield emit()
        common.release()
    return run


def _passages(min_words: int):
    """A digest of each passage of ``min_words`` words whose anchor the suffix is."""
    reach = _reach(min_words)
    need = min_words - GRAM - reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, starts = [], [], []
            for key, further, other, doc_id, pos, back, own in zip(
                    *(batch.column(c).to_pylist() for c in ("key", "further", "other", "doc_id", "pos", "back", "own")),
                    strict=True):
                head = key.to_bytes(8, "little", signed=True)
                low, count = divmod(own, 64)
                for t in range(max(low, need - len(other) // 4), min(low + count - 1, need, len(further) // 4) + 1):
                    digests.append(xxhash.xxh3_64_intdigest(head + further[:4 * t] + b"|" + other[:4 * (need - t)], seed=t)
                                   - (1 << 63))
                    docs.append(doc_id)
                    starts.append(pos - (reach + t if back else need - t))
            yield pa.RecordBatch.from_pydict({"passage": pa.array(digests, pa.int64()), "doc_id": pa.array(docs, pa.int64()),
                                              "start": pa.array(starts, pa.int32())})
    return run


def _merge(rows: pa.Table) -> pa.Table:
    """Overlapping matches of one document as one span, with the source of its first match."""
    rows = rows.sort_by([("start", "ascending"), ("stop", "descending"), ("of_doc_id", "ascending"),
                         ("of_start", "ascending")])
    start, stop = rows["start"].to_numpy(), np.maximum.accumulate(rows["stop"].to_numpy())
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    at = np.flatnonzero(new)
    return pa.table({"doc_id": rows["doc_id"].take(at), "start": rows["start"].take(at),
                     "stop": pa.array(stop[np.concatenate([at[1:], [len(stop)]]) - 1], pa.int32()),
                     "of_doc_id": rows["of_doc_id"].take(at), "of_start": rows["of_start"].take(at)})


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, stop, of_doc_id, of_start: word spans that occur already at an earlier place.

    A place is a doc_id and a word position; the first occurrence of a passage
    is not in the result.  Null and empty texts and texts of fewer than
    ``min_words`` words have no spans; rows with a null doc_id take no part;
    rows that repeat both doc_id and text count once.  Other columns are not read.
    """
    if min_words < GRAM + 2:
        raise ValueError(f"min_words must be at least {GRAM + 2}")
    common.bounded_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = common.cut(docs.withColumns(_text_keys()).mapInArrow(_anchor_rows(min_words), ANCHORS)
                      .where(F.col("n_words") >= min_words))
    classes = (rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "entry")).alias("first"))
               .select("h1", "h2", F.col("first.doc_id").alias("rep"), F.col("first.entry").alias("entry")))
    copies = (rows.select("doc_id", "h1", "h2", "n_words").join(classes.drop("entry"), ["h1", "h2"])
              .where("doc_id != rep").select("doc_id", F.lit(0).alias("start"), F.col("n_words").alias("stop"),
                                             F.col("rep").alias("of_doc_id"), F.lit(0).alias("of_start")).distinct())
    entries = rows.join(classes.select("entry"), "entry")
    # A key is one row an entry, however often the text repeats it.
    at = F.col("at")
    keyed = entries.select("entry", F.explode(F.transform("keys", lambda key, i: F.struct(
        key.alias("key"), F.slice("places", at[i] + 1, at[i + 1] - at[i]).alias("places")))).alias("k")
    ).select("entry", "k.key", "k.places")
    by_key = Window.partitionBy("key").orderBy("entry")
    alike = (keyed.withColumn("above", F.lag("entry").over(by_key)).withColumn("below", F.lead("entry").over(by_key))
             .where("above is not null or below is not null or size(places) > 1").groupBy("entry")
             .agg(F.flatten(F.collect_list("places")).alias("places")))  # two a minimiser of one text at most
    wanted = common.cut(alike.join(entries.select("entry", "doc_id", "h1", "h2"), "entry").drop("entry"))
    text = ["doc_id", "h1", "h2"]
    suffixes = common.cut(common.sketched(docs.withColumns(_text_keys()), wanted, text).join(wanted, text).mapInArrow(
        _suffix_rows(min_words), SUFFIXES))
    order = ["key", "further", "other", "doc_id", "pos"]
    parts = max(1, -(-suffixes.count() // RANGE_SUFFIXES))
    found = common.cut(suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                       .mapInArrow(_neighbours(min_words, True), MATCHES))
    ends = (found.where("edge").select("key", "further", "other", "doc_id", "pos", "back", "own").repartition("key")
            .sortWithinPartitions(*order).mapInArrow(_neighbours(min_words, False), MATCHES))
    earlier = Window.partitionBy("passage").orderBy("doc_id", "start")
    windows = (found.where("first").select("key", "further", "other", "doc_id", "pos", "back", "own")
               .mapInArrow(_passages(min_words), WINDOWS)
               .withColumn("of", F.lag(F.struct("doc_id", "start")).over(earlier)).where("of is not null")
               .where("(of.doc_id, of.start) != (doc_id, start)")
               .select("doc_id", "start", (F.col("start") + min_words).alias("stop"), F.col("of.doc_id").alias("of_doc_id"),
                       F.col("of.start").alias("of_start")))
    spans = ["doc_id", "start", "stop", "of_doc_id", "of_start"]
    matches = found.where("not edge and not first").unionByName(ends).select(*spans).unionByName(windows)
    return matches.select(*[F.col(c).cast("int") if c in ("start", "stop", "of_start") else F.col(c) for c in spans]
                          ).unionByName(copies).groupBy("doc_id").applyInArrow(_merge, SPANS)


def _cut_text(column: str):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist(), strict=True):
                if text and spans:
                    at = [m.span() for m in word.finditer(text)]
                    kept, last = [], 0
                    for span in sorted(spans, key=lambda s: s["start"]):
                        kept.append(text[last:at[span["start"]][0]])
                        last = at[span["stop"] - 1][1]
                    text = "".join([*kept, text[last:]])
                texts.append(text)
            names = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names],
                                             names=names)
    return run


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every repeated span cut out of its text but at its first place; all columns kept.

    A document that consists of repeated spans keeps its row, with what little
    is left as text.  A place is a doc_id and a position: rows of one doc_id but
    different texts keep these whole, as do rows without a doc_id.
    """
    column, id_ = common.fresh(docs.columns, "spans"), common.fresh(docs.columns, "span_doc")
    texts = (docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"),
                                                                    F.max(F.xxhash64("text")).alias("b")))
    several = texts.where("a != b").select(F.col("doc_id").cast("long").alias("doc_id"))
    spans = (repeated_spans(docs, min_words).join(several, "doc_id", "left_anti").groupBy(F.col("doc_id").alias(id_))
             .agg(F.collect_list(F.struct("start", "stop")).alias(column)))  # spans of one text
    joined = docs.join(spans, docs["doc_id"] == spans[id_], "left").drop(id_)
    return joined.mapInArrow(_cut_text(column), docs.schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(common.read_table(spark, sf_dir, "documents"))
