"""Word BPE and Arrow token files against the tokenizers library itself."""

import hashlib
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from spendlens.llm import arrow_tokens, common, word_bpe

TRICKY = ["", None, " ", "  a  b ", "a\tb\n\nc \n d", "x <|endoftext|> y<|startoftext|>z", "É́tat näive",
          "a b c", "ΣΑΣ ΣΣ", "don't 's 'll we'LL 12345 ½ ①", "日本語 テキスト 😀 👩‍👩‍👧",
          "a\x1cb\x85c\x0bd\x0ce", "é ́x", "word " * 5000, "#include <a>\r\n\r\n\tint  x;", "\n",
          "trailing   ", "a  b   c    d", "​ ​ x　y", " ", "x  y", "same text", "same text"]
DOCS = "doc_id long, text string, chunk string, ids string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "c", None, "en") for i, t in enumerate(TRICKY)]
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return rows + [(10_000 + r.doc_id, r.text, "c", None, "en") for r in given.select("doc_id", "text").collect()]


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 50_000)


def _library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_word_bpe_equals_library(spark, docs):
    library = _library("word_bpe_49k.json")
    want = []
    for i, text, *_ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    got = word_bpe.encode_decode(df, word_bpe.load_tokenizer("word_bpe_49k.json"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_word_bpe_repeats_nulls_and_empty_table(spark):
    tokenizer = word_bpe.load_tokenizer("word_bpe_49k.json")
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None)]
    got = word_bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 0), (-1, 2), (1, 1), (1, 2), (1, 2)]
    assert word_bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), tokenizer).count() == 0


@pytest.mark.parametrize("seq_len, shard", [(64, 40_000), (2048, 32 << 20)])
def test_arrow_tokens_equal_library(spark, docs, seq_len, shard, monkeypatch):
    monkeypatch.setattr(arrow_tokens, "SHARD_BYTES", shard)
    library = _library("byte_bpe_50k.json")
    root = f"{common.shared_dir(spark)}/{uuid.uuid4().hex}"
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    manifest = arrow_tokens.write_sequences(df, word_bpe.load_tokenizer("byte_bpe_50k.json"), root, seq_len)
    got = {r.doc_id: tuple(r)[1:] for r in arrow_tokens.read_sequences(manifest).collect()}
    start, stream = 0, []
    for i, text, *_ in sorted(docs, key=lambda r: r[0]):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        stream.append(ids)
    # Random access: every sequence of every shard holds the ids in order, the mask ends with the shard.
    stream, at = np.concatenate(stream), 0
    for row in sorted(manifest.collect(), key=lambda r: r.shard):
        reader = arrow_tokens.open_file(f"{row.path}.arrow")
        for k in range(-(-row.n_ids // seq_len)):
            ids, mask = arrow_tokens.sequence(reader, k)
            real = int(np.unpackbits(mask, bitorder="little").sum())
            assert len(ids) == seq_len and real == min(seq_len, row.n_ids - k * seq_len)
            assert (ids[:real] == stream[at:at + real]).all() and not ids[real:].any()
            at += real
    assert at == len(stream)


def test_arrow_tokens_empty_repeated_and_null(spark):
    tokenizer = word_bpe.load_tokenizer("byte_bpe_50k.json")

    def run(rows):
        root = f"{common.shared_dir(spark)}/{uuid.uuid4().hex}"
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return arrow_tokens.read_sequences(arrow_tokens.write_sequences(df, tokenizer, root)).orderBy("start").collect()

    assert run([]) == []
    got = run([(2, "b"), (1, None), (2, "a"), (None, "x"), (2, "a")])
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2), (2, 7, 2)]
    with pytest.raises(ValueError):
        arrow_tokens.SequenceWriter(None, 100)


def test_a_hot_doc_id_spans_shards(spark, monkeypatch):
    monkeypatch.setattr(arrow_tokens, "SHARD_BYTES", 4_000)
    rows = [(i, "left " * i) for i in range(20)] + [(None, f"none {k}") for k in range(900)] + [(30, f"w {k}") for k in range(900)]
    root = f"{common.shared_dir(spark)}/{uuid.uuid4().hex}"
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, mark int, before int").repartition(4)
    manifest = arrow_tokens.write_sequences(df, word_bpe.load_tokenizer("byte_bpe_50k.json"), root)
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) > 3 and max(sizes) < 900
    result = arrow_tokens.read_sequences(manifest)
    assert "Join" not in result._jdf.queryExecution().executedPlan().toString()
    got = sorted(result.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    library = _library("byte_bpe_50k.json")
    texts = Counter((i, zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()))
                    for i, t in rows)
    assert texts == Counter((r.doc_id, r.ids_crc32) for r in got)


def test_slices_are_compact_and_whole(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["é" * 30_000, None, "", "x" * 70_000, "y"], "n": [1, 2, 3, 4, 5]})
    parts = list(common.slices(iter([batch])))
    assert len(parts) > 1 and all(p.column("text").offset == 0 for p in parts)
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_word_hashes_lower_ascii_only():
    import pyarrow as pa

    words, at = common.word_hashes(pa.array(["Ab  É\n", None, "", "ab é", "ab É"]))
    assert at.tolist() == [0, 2, 2, 2, 4, 6]
    assert words[0] == words[2] == words[4] and words[1] == words[5] != words[3]


def test_queries_return_the_contract_columns(spark):
    from spendlens.llm import registry

    got = registry.queries()["op4_word_bpe"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = registry.queries()["op9_arrow_tokens"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert got.where(F.col("n_tokens") < 1).count() == 0


@pytest.mark.parametrize("fallback", [False, True])
def test_joined_words_equal_single_ones(fallback, monkeypatch):
    monkeypatch.setattr(arrow_tokens, "JOINED", 3)
    library = _library("byte_bpe_50k.json")
    texts = ["", " ", "a", " a b", "one\ttwo three\n", "x y z", "end <|endoftext|> of </s> it", "Ġ Ġw 12ab c!d",
             "two  spaces", "a b c d e f g a b", None]
    encoder = arrow_tokens.Encoder(word_bpe.load_tokenizer("byte_bpe_50k.json"))
    if fallback:  # no id seems to begin with a space, so every group goes word by word
        encoder.spaced[:] = False
    ids, n = encoder.encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_pieces_of_words_are_encoded_once_and_equal_the_library():
    encoder = arrow_tokens.Encoder(word_bpe.load_tokenizer("byte_bpe_50k.json"))
    encoder.encode(pa.array(["x alpha, alpha. alpha; alpha) alpha!\nalpha"]))
    assert [p for p in encoder.known if "alpha" in p and p[0] == " "] == [" alpha"]
    rng = np.random.default_rng(3)
    parts = ["a", "Z", "é", "Ж", "中", "ª", "𝒜", "́", "1", "²", ".", ",", "'", "'s", "'re", "…", "<|endoftext|>", "|", "<", "\n",
             "\t", "\v", "\x85", " ", " ", "\x1c", "\x00", " ", " ", " ", "the", "don't", "_", "\\", "~"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(2000)] + ["a, ﷐b,c"]
    library = _library("byte_bpe_50k.json")
    for some in (texts[:1000], texts[1000:]):
        ids, n = encoder.encode(pa.array(some))
        want = [library.encode(t, add_special_tokens=False).ids + [0] for t in some]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
