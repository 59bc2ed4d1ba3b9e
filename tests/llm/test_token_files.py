import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maillake.llm import token_files as tf
from maillake.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  b ", "x <|endoftext|> y", "don't  stop\n\n now ", " a   b", "a\tb c\x1c d", "é ñ  ß", "1 2  33 4.5 - !? '", "　x y"]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def reference_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_give_the_ids_of_whole_texts():
    encoder = tf.Encoder(tokenizer_path())
    assert encoder.by_piece and encoder.dtype == np.dtype("<u2")
    random.seed(3)
    alphabet = "ab e'sé1.,\n\t  -!ÑT<|>"
    texts = ODD + ["".join(random.choice(alphabet) for _ in range(random.randrange(60))) for _ in range(500)]
    got = encoder.texts(pa.array(texts))
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, encoder.dtype).tolist() == reference_ids(text)[:-1], repr(text)


def test_pieces_of_slices_and_forgotten_ones(monkeypatch):
    monkeypatch.setattr(tf, "ENCODE_BYTES", 40)
    monkeypatch.setattr(tf, "KNOWN_PIECES", 50)
    encoder = tf.Encoder(tokenizer_path())
    texts = ["word" + str(i % 90) + ", of a long text. " + "x" * (i % 60) for i in range(300)] + ODD + [None]
    column = pa.concat_arrays([pa.array(["left out"]), pa.array(texts)]).slice(1)
    for text, ids in zip(texts, encoder.texts(column)):
        assert np.frombuffer(ids, encoder.dtype).tolist() == reference_ids(text)[:-1], repr(text)


def test_folders_as_arrow_names_them():
    assert [tf.arrow_uri(f) for f in ("/a/b", "s3a://b/x", "s3n://b/x", "s3://b/x", "file:/a", "file:///a", "hdfs://h/a", "abfss://c@a/x")] == [
        None, "s3://b/x", "s3://b/x", "s3://b/x", "file:/a", "file:///a", "hdfs://h/a", "abfss://c@a/x",
    ]
    with pytest.raises(ValueError):
        tf.arrow_uri("wasb://c/x")


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20000])
def test_the_hash_is_minimal_and_perfect(n):
    hashes = tf.key_hash([str(i).encode() for i in range(n)])
    perfect = tf.PerfectHash.build(hashes)
    assert sorted(perfect.numbers(hashes)) == list(range(n)) and perfect.size == n


def test_files_hold_every_document(spark, tmp_path):
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(ODD * 3)] + [(99, None), (99, "word " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("clash"))
    manifest = tf.write_shards(docs, str(tmp_path / "t"), tokenizer_path(), shard_bytes=100)
    got = [tuple(r) for r in tf.read_digests(manifest, str(tmp_path / "t")).orderBy("start", "place").collect()]
    ids = sorted((k is not None, k or 0, len(reference_ids(t)), zlib.crc32(np.array(reference_ids(t), "<u4").tobytes())) for k, t in rows)
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == ids
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])])[:-1].tolist()
    keys = [(r[0] is not None, r[0] or 0) for r in got]
    assert keys == sorted(keys)
    wanted = spark.createDataFrame([(1,), (99,), (12345,), (None,)], "doc_id long")
    fetched = sorted((r["key"] is not None, r["key"] or 0, r["ids"]) for r in tf.fetch(manifest, str(tmp_path / "t"), wanted).collect())
    expected = sorted((k is not None, k or 0, reference_ids(t)) for k, t in rows if k in (1, 99, None))
    assert fetched == expected


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = tf.write_shards(docs, str(tmp_path / "t"), tokenizer_path())
    assert tf.read_digests(manifest, str(tmp_path / "t")).count() == 0


def test_the_query_against_plain_encoding(spark):
    got = {r["doc_id"]: r for r in QUERIES["op10_token_files"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    start = 0
    assert len(got) == len(docs)
    for d in docs:
        ids = reference_ids(d["text"])
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
