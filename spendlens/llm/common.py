"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4 << 20
#: The share of it for operators that hold several numbers for each word.
WORDS_SHARE = 4
#: Bits of a sketch of the rows that travel: broadcast, 8 MB whatever the input.
SKETCH_BITS = 1 << 26
#: Bytes that a worker handles between two calls of ``release``.
RELEASE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read by Spark so that any path Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local-mode session (tests) gets a folder of its own;
    a cluster session must name one.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{CHECKPOINT_CONF} is not set; point it at a folder every executor can reach")
        current = f"/tmp/checkpoints/spendlens-{uuid.uuid4().hex}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder; later reads survive lost executors.

    Spark removes the files when nothing refers to the result any more.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def told(rows: DataFrame, wanted: DataFrame, columns: list[str], name: str, bits: int = SKETCH_BITS) -> DataFrame:
    """``rows`` with a boolean ``name``: false only if their ``columns`` are not among those of ``wanted``.

    A bit for each wanted row's hash, ``bits`` of them in all, so that texts
    that nothing is wanted of aren't shuffled only to find that.
    """
    same = [F.col(c).cast(wanted.schema[c].dataType) for c in columns]  # a hash goes by the type
    bit = F.pmod(F.xxhash64(*same), F.lit(bits)) + 1  # Spark counts them from 1
    bucket, at, map_ = (fresh([*rows.columns, name], c) for c in ("bucket", "bit", "map"))
    sketch = (wanted.select(F.bitmap_bucket_number(bit).alias(bucket), F.bitmap_bit_position(bit).alias(at))
              .repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg(at).alias(map_)))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substr(map_, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return (rows.withColumn(bucket, F.bitmap_bucket_number(bit)).join(F.broadcast(sketch), bucket, "left")
            .select(*rows.columns, found.alias(name)))


def sketched(rows: DataFrame, wanted: DataFrame, columns: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """Rows whose ``columns`` may be among those of ``wanted``; the join that follows drops the few others."""
    name = fresh(rows.columns, "wanted")
    return told(rows, wanted, columns, name, bits).where(name).select(rows.columns)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the Arrow batches sent to Python by bytes, unless the session already does."""
    if int(spark.conf.get(BATCH_BYTES_CONF).rstrip("bBkKmMgG") or -1) in (-1, 2**31 - 1, 2**63 - 1, 2**31 - 16):
        spark.conf.set(BATCH_BYTES_CONF, size)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(columns, name: str) -> str:
    """``name``, with underscores in front until no column has it (Spark doesn't tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@cache
def _libc():
    return ctypes.CDLL(None) if sys.platform.startswith("linux") else None


def release() -> None:
    """Hand memory that is free again back to the system.

    Python workers live on from task to task; what one stage has freed would
    else count against the executor while another one runs.
    """
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


_handled = 0


def handled(size: int) -> None:
    """Count bytes that a worker has dealt with; free memory goes back once in ``RELEASE_BYTES``.

    The count lives as long as the worker, so many small groups or batches cost
    no more calls than a few large ones.
    """
    global _handled
    _handled += size
    if _handled >= RELEASE_BYTES:
        _handled = 0
        release()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", share: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``SLICE_BYTES / share`` of ``column`` (one row at least).

    Each is a copy that begins at offset 0: some string kernels of pyarrow go by
    the wrong offsets in a view of a longer array.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // max(SLICE_BYTES // share, 1)
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.take(pa.array(np.arange(lo, hi)))
        handled(batch.nbytes)
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix constants): spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased words (runs of anything but ASCII white space) as 64-bit hashes.

    Returns the hashes of all texts on end, and len(texts) + 1 offsets into them.
    A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten().dictionary_encode()
    distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
    table = np.fromiter((xxhash.xxh64_intdigest(w.lower()) for w in distinct), np.uint64, len(distinct))
    index = words.indices.to_numpy()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    if b"" in distinct:  # white space at either end of a text
        keep = index != distinct.index(b"")
        offsets = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]
        index = index[keep]
    return table[index] if len(distinct) else np.empty(0, np.uint64), offsets


def gram_hashes(words: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; ``len(words) - n + 1`` of them, or only of those that begin ``at``."""
    count = max(len(words) - n + 1, 0)
    acc = np.zeros(count if at is None else len(at), np.uint64)
    if not len(acc):
        return acc
    for i in range(n):
        acc += words[i:i + count] if at is None else words[at + i]
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return mix(acc)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(words.tobytes(), seed=len(words))], np.uint64)
    return np.unique(gram_hashes(words, n))


def as_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
