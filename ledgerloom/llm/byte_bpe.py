"""Byte-level BPE encoding and decoding with overlapping chunks.

Short texts are encoded where they are read.  A long text is cut into overlapping chunks that are pre-tokenised in
parallel; neighbours are stitched at a pre-token boundary that both found in their overlap (from there on both split
alike), and the pieces between stitches are encoded in parallel.  Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, sha_of, table

_kept: dict = {}
_LONG_SPACE = re.compile(r"\s{5000}")


def ranks_of(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}


def _encoding(rank_file: bytes, pattern: str):
    """One encoder for each worker process."""
    key = (hash(rank_file), pattern)
    if key not in _kept:
        import regex
        import tiktoken

        _kept[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(rank_file), special_tokens={}), regex.compile(pattern)
    return _kept[key]


def encode_text(text: str, encoding, pre) -> list[int]:
    """Ids of one text.  Very long white space, too deep for the encoder's own splitting, is split here."""
    if len(text) < 5000 or not _LONG_SPACE.search(text):
        return encoding.encode_ordinary(text)
    return [i for m in pre.finditer(text) for i in encoding._encode_single_piece(m[0])]


def boundaries(text: str, start: int, lo: int, hi: int, pre, last: bool) -> list[int]:
    """Absolute positions in [lo, hi) at which a pre-token of text[...] ends after a character that is no white space.

    text begins at ``start``.  Ends near the end of a chunk that isn't the last are left out: what follows could
    lengthen or split that pre-token.
    """
    stop = start + len(text) - (0 if last else 8)
    out = []
    for m in pre.finditer(text):
        p = start + m.end()
        if p >= hi or p > stop:
            break
        if p >= lo and not text[m.end() - 1].isspace():
            out.append(p)
    return out


def _tokens(rank_file: bytes) -> list[bytes]:
    """The bytes of each id."""
    key = ("decode", hash(rank_file))
    if key not in _kept:
        ranks = ranks_of(rank_file)
        _kept[key] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            _kept[key][i] = token
    return _kept[key]


def decode_bytes(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 65_536, overlap: int = 1_024, decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) of every row; null texts count as empty.

    With decode, also ``decoded``, the bytes that the ids decode to.  Rows are kept as often as they occur.  A text whose chunks do not resynchronise within an overlap (one pre-token
    longer than that) is encoded as a whole.
    """
    if not 16 <= overlap < chunk_chars:
        raise ValueError("overlap must be at least 16 and less than chunk_chars")
    held = docs.sparkSession.sparkContext.broadcast(rank_file)
    rows = id_text(docs, id_col, text_col)
    step = chunk_chars - overlap

    def encoder(also_decode: bool):
        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoding, pre = _encoding(held.value, pattern)
            tokens = _tokens(held.value) if also_decode else []
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    b = whole.slice(at, 500)
                    ids = [np.asarray(encode_text(t, encoding, pre), dtype="<u4").tobytes() for t in b.column(b.num_columns - 1).to_pylist()]
                    out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                    if also_decode:
                        out.append(pa.array([decode_bytes(x, tokens) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*b.schema.names[:-1], "n_tokens", "ids", "decoded"][: b.num_columns - 1 + len(out)])

        return encode

    kind = "doc_id bigint, n_tokens bigint, ids binary" + ", decoded binary" * decode
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(encoder(decode), kind)

    unique = rows.where(F.length("text") > chunk_chars).withColumn("key", F.concat_ws(":", F.md5("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    copies = unique.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    unique = unique.select("key", "text").dropDuplicates(["key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b["key"].to_pylist(), b["text"].to_pylist(), strict=True):
                n = 1 + max(0, -(-(len(text) - chunk_chars) // step))
                for k in range(n):
                    yield pa.RecordBatch.from_pydict({"key": [key], "k": pa.array([k], pa.int32()), "n": pa.array([n], pa.int32()), "chunk": [text[k * step : k * step + chunk_chars]]})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pre = _encoding(held.value, pattern)
        for b in batches:
            left, right = [], []
            for k, n, text in zip(b["k"].to_pylist(), b["n"].to_pylist(), b["chunk"].to_pylist(), strict=True):
                start, found = k * step, boundaries(text, k * step, k * step, k * step + chunk_chars, pre, k == n - 1)
                left.append([p for p in found if k and p < start + overlap])
                right.append([p for p in found if k < n - 1 and p >= start + step])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b["key"], b["k"], b["n"], pa.array(left, kind), pa.array(right, kind)], ["key", "k", "n", "left", "right"])

    chunks = unique.mapInArrow(cut, "key string, k int, n int, chunk string").repartition("key", "k")
    ends = chunks.mapInArrow(split, "key string, k int, n int, left array<bigint>, right array<bigint>")
    after = ends.select("key", (F.col("k") - 1).alias("k"), F.col("left").alias("next_left"))
    stitched = ends.where("k < n - 1").join(after, ["key", "k"]).select("key", "k", F.array_min(F.array_intersect("right", "next_left")).alias("at"))
    cuts = stitched.groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("cuts"), F.count("*").alias("wanted"))
    cuts = cuts.select("key", F.when(F.size("cuts") == F.col("wanted"), F.col("cuts")).otherwise(F.array().cast("array<bigint>")).alias("cuts"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, at in zip(b["key"].to_pylist(), b["text"].to_pylist(), b["cuts"].to_pylist(), strict=True):
                for k, (x, y) in enumerate(zip([0, *at], [*at, len(text)], strict=True)):
                    yield pa.RecordBatch.from_pydict({"key": [key], "k": pa.array([k], pa.int32()), "piece": [text[x:y]]})

    long = (
        unique.join(cuts, "key")
        .mapInArrow(pieces, "key string, k int, piece string")
        .repartition("key", "k")
        .mapInArrow(encoder(False), "key string, k int, n_tokens bigint, ids binary")
        .groupBy("key")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        .join(copies, "key")
        .select("doc_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
        .drop("copy")
    )
    return short.unionByName(decode_ids(long, rank_file) if decode else long)


def decode_ids(encoded: DataFrame, rank_file: bytes, ids_col: str = "ids") -> DataFrame:
    """encoded with ``decoded`` (binary), the concatenated bytes of its tokens; null ids give null."""
    held = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out = [None if x is None else decode_bytes(x, tokens) for x in b[ids_col].to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(decode, encoded.withColumn("decoded", F.lit(None).cast("binary")).schema)


def ranks_file(path: str | None = None) -> bytes:
    """The bytes of a rank file; by default the public byte-level vocabulary of 50,256 tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def query_digests(docs: DataFrame, rank_path: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = ranks_file(rank_path)
    both = encode_documents(docs, ranks, public_tokenizers.PATTERN, decode=True)
    return both.select("doc_id", "n_tokens", sha_of(F.col("ids")).alias("ids_sha256"), sha_of(F.col("decoded")).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_digests(table(spark, sf_dir, "documents"))
