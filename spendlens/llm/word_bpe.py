"""BPE encoding and decoding through a distinct-word table.

The tokenizer drops white space and never forms a token across it, so a text's
ids are the ids of its words (runs of anything but ASCII white space) on end:

1. split: texts become chunks of about ``CHUNK_BYTES``, each with its own list
   of distinct words and, per document, the words' places in that list;
2. encode: the lists meet by word bucket (as many buckets as the input has
   ``BUCKET_BYTES``), where each distinct word of the corpus is encoded once;
3. join back: each chunk receives the ids of its words, in the list's order,
   and its documents are put together by position;
4. decode: ids join the id-to-piece table, which has one row per entry of the
   vocabulary file.

Only distinct words of chunks are shuffled, packed and compressed, never word
occurrences: a word that fills a third of the corpus is one entry per chunk.
Places and words come from two runs of the same split, cheaper than a stored
copy; a chunk's key is a digest of its contents, and a chunk whose words are
missing fails the task rather than losing rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import common

CHUNK_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20

WORDS = "chunk long, bucket long, words binary"
IDS = "chunk long, bucket long, ids binary"
PLACES = "chunk long, doc_id array<long>, n_words array<long>, places binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _pack(values: np.ndarray) -> bytes:
    """Length and compressed byte planes of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, np.uint32)
    planes = values.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = pa.decompress(blob[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view(np.uint32).reshape(n)


def _pack_text(words: list[bytes]) -> bytes:
    text = b"\n".join(words)  # no word holds a line end
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def _unpack_text(blob: bytes) -> list[bytes]:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")


class _Chunk:
    """Documents, their words' places, and the distinct words sorted by bucket."""

    def __init__(self, batches: list[pa.RecordBatch], number: int, buckets: int):
        docs = pa.Table.from_batches(batches)
        texts = pc.fill_null(docs["text"].combine_chunks().cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        index = coded.indices.to_numpy()
        offsets = np.asarray(lists.offsets, np.int64)
        offsets = offsets - offsets[0]
        if b"" in words:  # white space at either end of a text
            empty = words.index(b"")
            keep = index != empty
            offsets = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]
            index = index[keep]
            index = index - (index > empty)
            del words[empty]
        bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.lexsort((np.arange(len(words)), bucket))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words, self.buckets = [words[i] for i in order.tolist()], bucket[order]
        self.places = place[index]
        self.doc_id, self.n_words = docs["doc_id"].to_pylist(), np.diff(offsets)
        digest = xxhash.xxh64(f"{TaskContext.get().partitionId()}/{number}/{self.doc_id}")
        digest.update(b"\n".join(self.words))
        self.key = digest.intdigest() - (1 << 63)


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[_Chunk]:
    held, size, number = [], 0, 0
    for batch in common.slices(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield _Chunk(held, number, buckets)
            held, size, number = [], 0, number + 1
    if held:
        yield _Chunk(held, number, buckets)


def _word_lists(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, buckets):
            cuts = [0, *(np.flatnonzero(np.diff(chunk.buckets)) + 1).tolist(), len(chunk.words)]
            out = [(int(chunk.buckets[a]), _pack_text(chunk.words[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk.key] * len(out), pa.int64()),
                "bucket": pa.array([b for b, _ in out], pa.int64()),
                "words": pa.array([w for _, w in out], pa.binary())})
    return run


def _place_lists(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, buckets):
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk.key], pa.int64()),
                "doc_id": pa.array([chunk.doc_id], pa.list_(pa.int64())),
                "n_words": pa.array([chunk.n_words.tolist()], pa.list_(pa.int64())),
                "places": pa.array([_pack(chunk.places)], pa.binary())})
    return run


def load_model(tokenizer: str):
    """A tokenizer from its file's contents, for use in one thread of a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(tokenizer)
    model.no_truncation()
    model.no_padding()
    return model


def _encode_bucket(tokenizer):
    def run(lists: pa.Table) -> pa.Table:
        """All chunks' words of one bucket: each distinct one is encoded once."""
        common.release()
        model = load_model(tokenizer.value)
        per_chunk = [_unpack_text(b) for b in lists["words"].to_pylist()]
        distinct = list({w for words in per_chunk for w in words})
        at = {w: i for i, w in enumerate(distinct)}
        found = model.encode_batch_fast([w.decode() for w in distinct], add_special_tokens=False)
        ids = [np.asarray(e.ids, np.uint32) for e in found]
        blobs = []
        for words in per_chunk:
            mine = [ids[at[w]] for w in words]
            n = _pack(np.fromiter(map(len, mine), np.uint32, len(mine)))
            blobs.append(len(n).to_bytes(8, "little") + n + _pack(np.concatenate(mine)))
        return pa.table({"chunk": lists["chunk"], "bucket": lists["bucket"], "ids": pa.array(blobs, pa.binary())})
    return run


def piece_table(tokenizer: str) -> tuple[pa.Array, pa.Array]:
    """By id: the piece, and the id in decimal (null where the vocabulary has no such id)."""
    spec = json.loads(tokenizer)
    pieces = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    size = max(pieces) + 1
    return pa.array([pieces.get(i) for i in range(size)], pa.string()), pa.array(map(str, range(size)), pa.string())


def _assemble(tokenizer):
    def run(chunk: pa.Table, lists: pa.Table) -> pa.Table:
        """The documents of one chunk from the ids of its words."""
        common.release()
        pieces, decimals = piece_table(tokenizer.value)
        ns, flat = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
        for blob in lists.sort_by("bucket")["ids"].to_pylist():
            cut = 8 + int.from_bytes(blob[:8], "little")
            ns.append(_unpack(blob[8:cut]))
            flat.append(_unpack(blob[cut:]))
        n = np.concatenate(ns).astype(np.int64)
        offsets, ids = np.concatenate([[0], np.cumsum(n)]), pa.array(np.concatenate(flat))

        def joined(table: pa.Array) -> np.ndarray:
            words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table.take(ids))
            return np.array(pc.binary_join(words, " ").cast(pa.binary()).to_pylist() + [b""], object)[:-1]

        id_text, piece_text = joined(decimals), joined(pieces)
        out = []
        for row in chunk.to_pylist():
            places = _unpack(row["places"])
            if len(places) and int(places.max()) >= len(n):
                raise RuntimeError("the split of the documents changed between two reads of them")
            known = n[places] > 0  # a word of exotic white space alone has no ids
            at = 0
            for doc_id, count in zip(row["doc_id"], row["n_words"], strict=True):
                mine = places[at:at + count][known[at:at + count]]
                at += count
                out.append((doc_id, int(n[mine].sum()), hashlib.sha256(b" ".join(id_text[mine].tolist())).hexdigest(),
                            hashlib.sha256(b" ".join(piece_text[mine].tolist())).hexdigest()))
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
    return run


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, one row per row of ``docs``.

    ``tokenizer`` is the contents of a tokenizer file.  A null text is an empty
    one: no ids, empty decoded text.  Repeated and null doc_ids keep their rows;
    an empty table gives none.  Other columns are not read.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    held = spark.sparkContext.broadcast(tokenizer)  # a vocabulary file: 2 MB
    ids = (docs.mapInArrow(_word_lists(buckets), WORDS).groupBy("bucket").applyInArrow(_encode_bucket(held), IDS)
           .withColumnRenamed("chunk", "of_chunk"))
    places = docs.mapInArrow(_place_lists(buckets), PLACES)
    return places.groupBy("chunk").cogroup(ids.groupBy("of_chunk")).applyInArrow(_assemble(held), RESULT)


def load_tokenizer(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op4_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.read_table(spark, sf_dir, "documents"), load_tokenizer("word_bpe_49k.json"))
