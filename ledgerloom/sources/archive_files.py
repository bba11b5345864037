"""Reads packed block archives: index files of fixed 20-byte records, and data files of zstd frames.

Index records are big-endian: block number (8 bytes), offset (8), length (4).  Files come through Spark's binary reader,
so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the layout of an index record.
RECORD = np.dtype([("block_number", ">u8"), ("offset", ">u8"), ("length", ">u4")])
_STEM = r"([^/]*)\.[^./]*$"


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select(F.regexp_extract("path", _STEM, 1).alias("file"), "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """file, block_number, offset, length of every record; a file whose size is no multiple of a record's is skipped."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b["file"].to_pylist(), b["content"].to_pylist(), strict=True):
                if len(raw) % RECORD.itemsize == 0:
                    r = np.frombuffer(raw, RECORD)
                    yield pa.RecordBatch.from_pydict({"file": [file] * len(r), **{n: pa.array(r[n].astype(np.int64)) for n in RECORD.names}})

    return _files(spark, path, ".rbi").mapInArrow(parse, "file string, block_number bigint, offset bigint, length bigint")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """block_number and payload (null if the record points outside its data file or the frame is broken)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for raw, records in zip(b["content"].to_pylist(), b["records"].to_pylist(), strict=True):
                out = []
                for r in records:
                    frame = raw[r["offset"] : r["offset"] + r["length"]]
                    try:
                        out.append(zstandard.ZstdDecompressor().decompress(frame, max_output_size=1 << 30) if len(frame) == r["length"] else None)
                    except zstandard.ZstdError:
                        out.append(None)
                yield pa.RecordBatch.from_pydict({"block_number": pa.array([r["block_number"] for r in records], pa.int64()), "payload": pa.array(out, pa.binary())})

    index = read_index(spark, path).groupBy("file").agg(F.collect_list(F.struct("block_number", "offset", "length")).alias("records"))
    return _files(spark, path, ".rba").join(index, "file").select("content", "records").mapInArrow(cut, "block_number bigint, payload binary")
