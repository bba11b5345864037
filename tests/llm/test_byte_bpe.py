import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerloom.llm import byte_bpe


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.ranks_file()


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(ranks), special_tokens={})


TEXTS = [
    None, "", " ", "a", "Hello, world!  It's 12 o'clock.\n\n\tÉté 東京 🙂 'rest they're", "<|endoftext|> is plain",
    " \n\n  \n word  \t\n", "x" * 700, ("we're all 'realists', aren't we?   \n\n  " * 60), "ab " * 400 + "é" * 300 + "  　 end" * 30,
    " " * 900 + "z", "''''''ll 're's" * 80, "漢字かな" * 200,
]


@pytest.mark.parametrize(("chunk", "overlap"), [(65_536, 1_024), (128, 32), (97, 48)])
def test_as_the_library(spark, ranks, encoding, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "again"), (None, TEXTS[8], "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, chunk_chars=chunk, overlap=overlap, decode=True).collect()
    want = sorted((str(i), np.asarray(encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_round_trip_and_digests(spark, encoding):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in byte_bpe.query_digests(docs).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_very_long_white_space_and_empty_table(spark, ranks):
    docs = spark.createDataFrame([(1, " " * 400_000 + "a")], "doc_id bigint, text string")
    (r,) = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, decode=True).collect()
    assert bytes(r.decoded) == b" " * 400_000 + b"a"
    assert byte_bpe.encode_documents(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []


def test_decode_keeps_nulls(spark, ranks):
    rows = spark.createDataFrame([(1, None), (2, bytearray(b""))], "doc_id bigint, ids binary")
    assert [(r.doc_id, r.decoded and bytes(r.decoded)) for r in byte_bpe.decode_ids(rows, ranks).orderBy("doc_id").collect()] == [(1, None), (2, bytearray(b""))]
