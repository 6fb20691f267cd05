"""Token ids as Arrow files of fixed-size-list batches.

Documents in ascending doc_id order are dealt by range into shards; each shard
is one Arrow IPC file whose record batches hold ``ids`` (fixed-size list of
``seq_len`` unsigned ids, 16 bits wide where the vocabulary allows, else 32) and
``mask`` (fixed-size list of bits, 1 for an id, 0 for the padding at the shard's
end).  Sequence ``i`` of a shard is row
``i``: equal lengths make its place a multiplication, and a memory map of the
file hands out ids and mask without a copy.  Beside it lies an index file with
(doc_id, start, n) of each document in the shard.

Files are written under a name of the attempt and then renamed, so a task that
is run again after a lost executor leaves one whole file.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm import common
from spendlens.llm.word_bpe import load_model, load_tokenizer

SEQ_LEN = 2048
BATCH_SEQS = 128
SHARD_BYTES = 32 << 20
#: Pieces of words a task remembers; then it starts anew.
CACHE_WORDS = 800_000
#: Distinct pieces that go through the tokenizer as one text.
JOINED = 1024
END_ID = 0

MANIFEST = "shard long, path string, n_docs long, n_ids long"
#: A space next to other white space: there the words can't be cut one by one.
_TANGLED = r" [\p{Z}\x{85}\t-\r]|[\p{Z}\x{85}\t-\r] "
#: How a byte-level vocabulary writes a space.
_SPACE = "\u0120"
#: A piece that begins with its only white space.
_PLAIN = r"\A [^\p{Z}\x{85}\t-\r]+\z"
#: Stands where a word is cut; among words that hold it, none is cut.
_CUT = "\ufdd0"
#: White space behind a word's first space, but a line end alone.
_LONG_WHITE = r"(?s:.)[\p{Z}\x{85}\t\v\f\r]|\n\n"
#: Letters to every version of Unicode, Latin, Cyrillic and CJK; words of other scripts are cut less.
_LETTER = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{481}\x{4e00}-\x{9fa5}"
#: Behind letters; behind marks but an apostrophe, which may begin the run behind it; behind a single line end.
_EDGES = [(rf"([{_LETTER}])([!-@\[-`{{-~\n])", rf"\1{_CUT}\2"),
          (rf"([!-&(-/:-@\[-`{{-~])([{_LETTER}0-9\n])", rf"\1{_CUT}\2"),
          (rf"\n([{_LETTER}!-@\[-`{{-~])", f"\n{_CUT}\\1")]


def _on_end(flat: np.ndarray, start: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the numbered entries of ``flat`` on end, and the end of each behind a 0."""
    each = np.diff(start)[index]
    ends = np.concatenate([[0], np.cumsum(each)])
    return flat[np.repeat(start[index] - ends[:-1], each) + np.arange(ends[-1])], ends


class Encoder:
    """Encodes texts with a tokenizer file's contents, each distinct piece of a word once.

    This kind of tokenizer joins a single space to the word behind it, so a text
    may be cut before each space that stands between two other characters.
    Texts with tangled white space go through the tokenizer whole.  Where it
    takes runs of letters, of digits, of marks and of white space apart, words
    are cut between such runs too: far fewer pieces than words are distinct.
    """

    def __init__(self, tokenizer: str):
        self.model = load_model(tokenizer)
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.width = np.uint16 if size <= 1 << 16 else np.uint32
        pieces = (self.model.id_to_token(i) or "" for i in range(size))
        self.spaced = np.fromiter((p.startswith(_SPACE) for p in pieces), bool, size)
        self.whole = self._kept_whole()
        self._forget()

    def _kept_whole(self) -> str | None:
        """Pattern of the words that mustn't be cut; None if none may."""
        config = json.loads(self.model.to_str())
        before = config["pre_tokenizer"] or {}
        if config["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            return None
        added = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values() if t.content]
        return "|".join([_LONG_WHITE, *added])

    def _forget(self) -> None:
        """Start with no pieces."""
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, self.width)
        self.start = np.zeros(1, np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words on end, and how many each has."""
        found = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), self.width, int(size.sum())), size

    def _encoded_joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``, of words that begin with their only white space: ``JOINED`` of them go as one text.

        No id spans two such words and the first id of each is one that begins with a space.
        """
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        made = []
        for group, e in zip(groups, self.model.encode_batch_fast(["".join(g) for g in groups],
                                                                 add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.width)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) == len(group) and first[0] == 0:
                made.append((ids, np.diff(first, append=len(ids))))
            else:  # an added token that takes a space, for one
                made.append(self._encoded(group))
        return np.concatenate([x for x, _ in made]), np.concatenate([n for _, n in made])

    def _learn(self, words: list[str], joined: bool = False) -> np.ndarray:
        """Numbers of newly encoded pieces."""
        ids, size = (self._encoded_joined if joined and words else self._encoded)(words)
        first = len(self.start) - 1
        self.flat = np.concatenate([self.flat, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        return np.arange(first, first + len(words))

    def _numbers(self, words: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Numbers of distinct pieces, known or new; ``odd`` ones don't begin with their only white space."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        numbers = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        new = np.concatenate([new[~odd[new]], new[odd[new]]])
        fresh = words[new].tolist()
        plain = len(new) - np.count_nonzero(odd[new])
        numbers[new] = np.concatenate([self._learn(fresh[:plain], joined=True), self._learn(fresh[plain:])])
        self.known.update(zip(fresh, numbers[new].tolist(), strict=True))
        return numbers

    def _pieces(self, words: pa.Array) -> pa.Array:
        """The pieces of each word, which begins with a space."""
        if self.whole is None or pc.any(pc.match_substring(words, _CUT)).as_py():
            return pa.LargeListArray.from_arrays(pa.array(range(len(words) + 1), pa.int64()), words)
        cut = words
        for pattern, apart in _EDGES:
            cut = pc.replace_substring_regex(cut, pattern, apart)
        return pc.split_pattern(pc.if_else(pc.match_substring_regex(words, self.whole), words, cut), _CUT)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, the end id behind each, and the number of ids of each."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        tangled = pc.match_substring_regex(texts, _TANGLED)
        lists = pc.split_pattern(pc.if_else(tangled, "", texts), " ")
        offsets = np.asarray(lists.offsets, np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        lists = self._pieces(pc.binary_join_element_wise(empty, coded.dictionary, space))  # a space before each word
        pieces = lists.flatten().dictionary_encode()
        odd = pc.invert(pc.match_substring_regex(pieces.dictionary, _PLAIN))
        numbers = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False), odd.to_numpy(zero_copy_only=False))
        flat, ends = _on_end(self.flat, self.start, numbers[pieces.indices.to_numpy()])
        start = ends[np.asarray(lists.offsets, np.int64)]
        # The first word of a text has no space before it; a tangled text is one such word.
        firsts, size = self._encoded([t if k else t.partition(" ")[0]
                                      for t, k in zip(texts.to_pylist(), tangled.to_pylist(), strict=True)])
        flat = np.concatenate([flat, firsts, np.array([END_ID], self.width)])
        start = np.concatenate([start, start[-1] + np.cumsum(size), [len(flat)]])
        index = coded.indices.to_numpy().astype(np.int64)
        index[offsets[:-1]] = len(coded.dictionary) + np.arange(len(texts))
        ids, before = _on_end(flat, start, np.insert(index, offsets[1:], len(start) - 2))
        return ids, np.diff(before[offsets + np.arange(len(offsets))])


class SequenceWriter:
    """Packs a stream of ids into fixed-size-list batches of an Arrow file."""

    def __init__(self, file, seq_len: int, width: type = np.uint32):
        if seq_len % 8:
            raise ValueError("seq_len must be a multiple of 8, so that each mask begins at a byte")
        self.seq_len, self.rows, self.width = seq_len, BATCH_SEQS, width
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(width), seq_len)),
                                 ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = ipc.new_file(file, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.width)
        now, rest = ids[:count], ids[count:]
        rows = -(-len(now) // self.seq_len)
        padded = np.zeros(rows * self.seq_len, self.width)
        padded[:len(now)] = now
        mask = np.arange(len(padded)) < len(now)
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (padded, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.held, self.size = [rest], len(rest)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.width))
        self.size += len(ids)
        self.total += len(ids)
        whole = self.rows * self.seq_len
        while self.size >= whole:
            self._flush(whole)

    def close(self) -> None:
        if self.size:
            self._flush(self.size)
        self.out.close()


def open_file(path: str) -> ipc.RecordBatchFileReader:
    """Random-access reader; a local file is memory-mapped, so batches are views of it."""
    fs, inner = pafs.FileSystem.from_uri(path)
    return ipc.open_file(pa.memory_map(inner) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner))


def sequence(reader: ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask bits (eight to a byte, lowest first) of sequence ``i`` of a shard, as views of the file."""
    batch = reader.get_batch(i // BATCH_SEQS)
    row = i % BATCH_SEQS
    size = batch.schema.field("ids").type.list_size
    ids = batch.column("ids").values.to_numpy(zero_copy_only=True)[row * size:(row + 1) * size]
    bits = np.frombuffer(batch.column("mask").values.buffers()[1], np.uint8)
    return ids, bits[row * size // 8:(row + 1) * size // 8]


def _writer(tokenizer: str, root: str, seq_len: int):
    index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder = Encoder(tokenizer)
        fs, folder = pafs.FileSystem.from_uri(root)
        name = f"{folder}/shard-{task.partitionId():08d}"
        attempt = f"{folder}/attempt-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        n_docs = 0
        with fs.open_output_stream(f"{attempt}.arrow") as a, fs.open_output_stream(f"{attempt}.docs.arrow") as b:
            out, index = SequenceWriter(a, seq_len, encoder.width), ipc.new_file(b, index_schema)
            for batch in common.slices(batches):
                ids, n = encoder.encode(batch.column("text"))
                start = out.total + np.cumsum(n) - n
                index.write_batch(pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(start), pa.array(n)], schema=index_schema))
                out.add(ids)
                n_docs += len(n)
            out.close()
            index.close()
        for end in (".arrow", ".docs.arrow"):
            fs.move(attempt + end, name + end)
        path = f"{root}/shard-{task.partitionId():08d}"
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [path], "n_docs": [n_docs],
                                          "n_ids": [out.total]})
    return write


def write_sequences(docs: DataFrame, tokenizer: str, root: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write ``docs`` (doc_id, text) under ``root`` and return the manifest, one row per shard.

    Null texts count as empty (the end id alone); null doc_ids come first;
    rows of one doc_id are ordered by a hash of the text, which also spreads the
    texts of a hot doc_id, or of none, over shards.  An empty table gives an
    empty shard.
    """
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fs, folder = pafs.FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)
    ordered = (docs.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "doc_id", "mark")
               .sortWithinPartitions("doc_id", "mark", "text"))
    return common.cut(ordered.mapInArrow(_writer(tokenizer, root, seq_len), MANIFEST))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            reader, index = open_file(f"{path}.arrow"), open_file(f"{path}.docs.arrow")
            number, view = -1, ()
            at = 0  # ids of the shard before ``view``
            for k in range(index.num_record_batches):
                part = index.get_batch(k)
                sums = []
                for start, n in zip(part.column("start").to_pylist(), part.column("n").to_pylist(), strict=True):
                    crc, done = 0, 0
                    while done < n:
                        if start + done >= at + len(view):
                            at, number = at + len(view), number + 1
                            now = reader.get_batch(number)
                            real = now.column("mask").values.true_count
                            view = now.column("ids").values.to_numpy(zero_copy_only=True)[:real]
                            continue
                        piece = view[start + done - at:start + n - at]
                        crc = zlib.crc32(piece.astype("<u4"), crc)
                        done += len(piece)
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.add(part.column("start"), before), part.column("n"),
                     pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_sequences(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))  # one short row per 32 MB of text
    shards = manifest.select("shard", "path", before.cast("long").alias("before"))
    return (shards.repartition(max(1, manifest.rdd.getNumPartitions()), "shard")
            .mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op9_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_sequences(common.read_table(spark, sf_dir, "documents"), load_tokenizer("byte_bpe_50k.json"), root)
    return read_sequences(manifest)
