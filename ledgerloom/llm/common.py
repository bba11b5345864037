"""Helpers shared by the corpus operators.

Text is split into words on the six ASCII separators 0x20 and 0x09-0x0D, which is what ``bytes.split()`` does on
UTF-8 bytes.  ``None`` texts count as empty everywhere.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_own_dir: str | None = None
#: Bytes of an Arrow batch, where the session sets none: Spark's own bound counts rows, whatever the length of their texts.
BATCH_BYTES = "6m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, unless it has a bound: JVM and worker each hold a batch whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on; other columns, whatever their names, stay out of its way."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def lower_ascii(c: Column) -> Column:
    """A-Z become a-z, all other characters stay."""
    return F.translate(c, UPPER, LOWER)


def sha_of(c: Column) -> Column:
    return F.sha2(c, 256)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (``spark.checkpoint.dir``); where that is unset, a temporary one if the executors are
    threads of this machine, else an error."""
    global _own_dir
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="ledgerloom-")
        import shutil

        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def task_count(df: DataFrame) -> int:
    """Partitions for a shuffle of about the whole of df: as many as its input has, or the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def summed_counters(rows: DataFrame, count, size: int, slices: int = 32) -> np.ndarray:
    """The sum, as int64, of the counter array that ``count(batches)`` makes of each partition of rows.

    size is fixed by the caller, so what reaches the driver does not grow with the data.
    """
    import pyarrow as pa

    def partial(batches):
        found = count(batches)
        if found is not None and found.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(slices), pa.int32()), "counts": [x.astype(np.int64).tobytes() for x in np.split(found, slices)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["slice"].to_pylist(), b["counts"].to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.int64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "counts": [x.tobytes()]})

    kind = "slice int, counts binary"
    out, width = np.zeros(size, np.int64), size // slices
    for k, x in rows.mapInArrow(partial, kind).repartition(slices, "slice").mapInArrow(add, kind).collect():
        out[k * width : (k + 1) * width] = np.frombuffer(x, np.int64)
    return out


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its tasks, and others need the room."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sliced(batches, column: str = "text", max_bytes: int = 3_000_000):
    """The batches in slices of about max_bytes of column, so that what a task unpacks at once stays small."""
    import pyarrow.compute as pc

    give_back()
    for b in batches:
        if b.num_rows:
            filled = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b[column]), 0))) // max_bytes
            edges = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), b.num_rows]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                yield b.slice(start, stop - start)
    give_back()
