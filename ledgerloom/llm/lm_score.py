"""Language-model scores by a probabilistic suffix tree, beside a smoothed unigram base.

The tree reads a text as bytes: its words (A-Z lower-cased) joined by one space, then an end mark.  A node is a context
of up to ``depth`` preceding bytes.  It is retained if its next-byte counts diverge enough from the prediction of its
longest retained suffix; its distribution is that prediction smoothed into its own counts (Witten-Bell).  A byte is
scored by the longest retained suffix of what precedes it.

1. Texts are packed, in pieces of about half a million bytes at most, into chunks of bounded size, written once.
2. Each chunk asks for its distinct words and byte n-grams, with their training counts, in one message a bucket.  There
   are at most 4,096 buckets for each of the two, so messages grow with the chunks and not with their square.  N-grams
   go by their nearest four context bytes, so that the deep contexts of a bucket are whole subtrees and no bucket holds
   more than those of some four-byte contexts.
3. Messages are added up by (bucket, salt), then by bucket; a salt has at most 4,096 chunks.
4. The contexts of up to three bytes are a small table of their own, joined to the buckets, where the deeper ones follow.
5. The buckets answer each message with the counts or probabilities of its keys, and a chunk's texts are scored by them.
   The keys of n-grams come back too, so that a chunk sorts its n-grams once only.

Neither words nor tree pass through the driver; it sees 256 x 256 counts and two sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, id_text, mix64, sliced, stored, table

#: The end of a text, and what precedes its start; no word has this byte.
END = b"\n"
_END_WORD = xxhash.xxh3_64_intdigest(END)
#: Bytes handled at once (and about the largest piece of a text), n-grams sorted at once, and bytes of text in a chunk.
_SLICE, _RUN, CHUNK_CHARS = 500_000, 1_000_000, 32_000_000
#: Most buckets of a kind, and most chunks of a salt.
_BUCKETS, _SALT_CHUNKS = 4_096, 4_096
#: Kinds of keys.
_WORDS, _GRAMS = 0, 1
#: Context bytes of the table of short contexts.
_SHORT = 3


def _pieces(raw: bytes, depth: int, size: int) -> Iterator[tuple[bytes, bytes]]:
    """What precedes each piece of the text (depth bytes), and the piece; cuts follow a space."""
    text, at, lead = b" ".join(raw.lower().split()) + END, 0, END * depth
    while at < len(text):
        cut = len(text) if len(text) - at <= size else text.find(b" ", at + size) + 1 or len(text)
        yield lead, text[at:cut]
        lead, at = (lead + text[at:cut])[-depth:], cut


def _chunks(rows: DataFrame, depth: int, chunk_chars: int) -> DataFrame:
    """chunk; row, doc, held and size of each of its pieces; blob: the pieces with what precedes them, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, filled, found = TaskContext.get().partitionId(), 0, 0, []
        shut = zstandard.ZstdCompressor(level=3).compress

        def flush() -> pa.RecordBatch:
            row, doc, held, lead, body = zip(*found, strict=True)
            blob = shut(b"".join(x for pair in zip(lead, body, strict=True) for x in pair))
            columns = {"row": (row, pa.int64()), "doc": (doc, pa.int64()), "held": (held, pa.bool_()), "size": (list(map(len, body)), pa.int32())}
            listed = [pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(x, kind)) for x, kind in columns.values()]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), *listed, pa.array([blob], pa.binary())], ["chunk", *columns, "blob"])

        for b in sliced(batches):
            for doc, raw, held in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["held_out"].to_pylist(), strict=True):
                n += 1
                for lead, body in _pieces(raw, depth, min(_SLICE, chunk_chars)):
                    found.append(((part << 32) + n, doc, held, lead, body))
                    filled += len(body)
                    if filled >= chunk_chars:
                        yield flush()
                        n, filled, found = n + 1, 0, []
        if found:
            yield flush()

    return rows.mapInArrow(pack, "chunk bigint, row array<bigint>, doc array<bigint>, held array<boolean>, size array<int>, blob binary")


class Chunk:
    """A chunk unpacked."""

    def __init__(self, chunks: pa.Table | pa.RecordBatch, i: int, depth: int):
        self.blob, self.depth = zstandard.ZstdDecompressor().decompress(chunks["blob"][i].as_py()), depth
        self.row, self.doc, self.held, self.size = (chunks[c][i].values for c in ("row", "doc", "held", "size"))
        self.sizes = self.size.to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.sizes + depth)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The piece and the entry of each token, the end of each text included; the hash of each entry, a few may be equal.

        A chunk's words are told apart before they are hashed, so that each is hashed once or twice, however many there are.
        """
        found, counts, hashes = [], [], []
        for at, stop in self.slices():
            starts = self.ends[at:stop] - self.sizes[at:stop]
            first = int(starts[0])
            part = np.frombuffer(self.blob, np.uint8, int(self.ends[stop - 1]) - first, first)
            body = np.ones(len(part), bool)
            for back in range(1, self.depth + 1):  # what precedes the pieces
                body[starts[1:] - first - back] = False
            part = part[body]
            edges = np.append(0, np.flatnonzero((part == ord(" ")) | (part == END[0])) + 1).astype(np.int32)  # a piece ends in one of them
            found.append(pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(part)]))
            counts.append(np.diff(np.searchsorted(edges[1:], np.cumsum(self.sizes[at:stop]), "right"), prepend=0))
        told = pa.chunked_array(found).dictionary_encode()
        del found
        listed, shut = told.chunk(told.num_chunks - 1).dictionary, np.frombuffer(self.blob, np.uint8)[self.ends - 1] == END[0]
        for at in range(0, len(listed), _SLICE // 5):
            some = listed.slice(at, _SLICE // 5).to_pylist()
            hashes.append(np.fromiter((xxhash.xxh3_64_intdigest(w[:-1] or END) for w in some), np.uint64, len(some)))
        more = np.flatnonzero(shut & (self.sizes > 1)).astype(np.int32)  # a lone end is an entry already
        of = np.concatenate([np.repeat(np.arange(len(self.sizes), dtype=np.int32), np.concatenate(counts)), more])
        entry = np.concatenate([*(x.indices.to_numpy() for x in told.chunks), np.full(len(more), len(listed), np.int32)])
        return of, entry, np.append(np.concatenate(hashes), np.uint64(_END_WORD))

    def slices(self) -> Iterator[tuple[int, int]]:
        """Ranges of pieces of about _SLICE bytes."""
        at = 0
        while at < len(self.sizes):
            start = int(self.ends[at] - self.sizes[at] - self.depth)
            stop = max(at + 1, int(np.searchsorted(self.ends, start + _SLICE, "right")))
            yield at, stop
            at = stop

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In slices: the piece of each byte, and its key: nearest context byte first, the byte itself last."""
        depth, eight = self.depth, np.uint64(8)
        for at, stop in self.slices():
            start = int(self.ends[at] - self.sizes[at] - depth)
            part = np.frombuffer(self.blob, np.uint8, int(self.ends[stop - 1]) - start, start)
            n = len(part) - depth
            key = part[depth - 1 : depth - 1 + n].astype(np.uint64)
            for back in range(2, depth + 2):  # the last is the byte itself
                key <<= eight
                key |= part[depth - back : depth - back + n] if back <= depth else part[depth:]
            of = np.repeat(np.arange(at, stop), self.sizes[at:stop])
            yield of, key[np.arange(len(of)) + depth * (of - at)]

    def train(self) -> np.ndarray:
        """Of each piece, whether it is learned from."""
        return ~np.asarray(self.held.to_numpy(zero_copy_only=False), bool)

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct hashes of tokens, and how often each occurs in training texts."""
        of, entry, hashes = self.words()
        return _merged([hashes], [np.bincount(entry[self.train()[of]], minlength=len(hashes))])

    def distinct_grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct keys of bytes, and how often each occurs in training texts; sorted in runs of about _RUN."""
        train, keys, counts, waiting, n = self.train().astype(np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for of, key in self.grams():
            waiting.append(key << np.uint64(1) | train[of])
            n += len(key)
            if n >= _RUN:
                keys, counts, waiting, n = *_added(keys, counts, waiting), [], 0
        return _added(keys, counts, waiting) if waiting else (keys, counts)


def _added(keys: np.ndarray, counts: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and their counts after those that wait, whose last bit says whether they count."""
    run = np.concatenate(waiting)
    run.sort()
    more, first = _starts(run)
    n = np.where(more & np.uint64(1), np.diff(first, append=len(run)), 0)
    more, first = _starts(more >> np.uint64(1))
    n = np.add.reduceat(n, first)
    at = np.searchsorted(keys, more)
    new = np.ones(len(more), bool)
    within = np.flatnonzero(at < len(keys))
    new[within] = keys[at[within]] != more[within]
    counts[at[~new]] += n[~new]
    return np.insert(keys, at[new], more[new]), np.insert(counts, at[new], n[new])


def _starts(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ordered array, and where each starts."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    return ordered[first], first


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts, exactly."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    found, first = _starts(key[order])
    return found, np.add.reduceat(count[order], first) if len(found) else np.empty(0, np.int64)


class Table:
    """Values by key below 2^63, all of them looked up at once: open addressing over arrays."""

    _free = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (len(keys) * 3 // 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self._free), np.zeros(1 << bits, values.dtype)
        for first in range(0, len(keys), _SLICE):
            left = np.arange(first, min(first + _SLICE, len(keys)))
            at = self._place(keys[left])
            while len(left):
                free = self.keys[at] == self._free
                self.keys[at[free]] = keys[left[free]]  # of those that meet in a slot one stays
                stays = self.keys[at] == keys[left]
                self.values[at[stays]] = values[left[stays]]
                left, at = left[~stays], (at[~stays] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, all of which must be there."""
        at = self._place(keys)
        found, left = self.values[at], np.flatnonzero(self.keys[at] != keys)
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found[left] = self.values[at]
            missed = self.keys[at] != keys[left]
            left, at = left[missed], at[missed]
        return found


def _shut(x: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _open(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _shut_keys(ordered: np.ndarray) -> bytes:
    return _shut(np.diff(ordered, prepend=np.uint64(0)))


def _open_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_open(b, np.uint64), dtype=np.uint64)


def _bucket_of(keys: np.ndarray, kind: int, buckets: int, depth: int) -> np.ndarray:
    by = keys >> np.uint64(8 * (depth + 1 - min(depth, _SHORT + 1))) if kind == _GRAMS else keys
    return (mix64(by) % np.uint64(buckets)).astype(np.int64)


def _shorter(keys: np.ndarray, depth: int, d: int) -> np.ndarray:
    """Keys of depth context bytes as keys of the nearest d."""
    return ((keys >> np.uint64(8 * (depth + 1 - d))) << np.uint64(8)) | (keys & np.uint64(255))


def first_order(counts: np.ndarray) -> np.ndarray:
    """Probability of each byte after each nearest byte, from their 256 x 256 counts."""
    root = (counts.sum(0) + 1.0) / (counts.sum() + 256.0)
    kinds, seen = (counts > 0).sum(1, keepdims=True), counts.sum(1, keepdims=True)
    return np.where(seen > 0, (counts + kinds * root) / np.maximum(seen + kinds, 1), root)


def deepened(keys: np.ndarray, counts: np.ndarray, p: np.ndarray, depth: int, depths: range, min_count: int, min_gain: float) -> np.ndarray:
    """Probability of each key's last byte after its longest retained context of up to the last of depths.

    keys: distinct, and all there are of each context of the first of depths; counts: in training texts; p: the
    probability by the contexts before that.  A context is retained if it occurs min_count times and the log-likelihood
    that its own distribution gains over its longest retained suffix is min_gain nats or more.
    """
    for d in depths if len(keys) else ():
        pairs, of = np.unique(_shorter(keys, depth, d), return_inverse=True)
        n = np.bincount(of, counts, len(pairs))
        before = np.empty(len(pairs))
        before[of] = p
        context = np.cumsum(np.concatenate([[True], (pairs[1:] >> np.uint64(8)) != (pairs[:-1] >> np.uint64(8))])) - 1
        n_context, kinds = np.bincount(context, n), np.bincount(context, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.bincount(context, np.where(n > 0, n * np.log(n / n_context[context] / before), 0.0))
            after = (n + kinds[context] * before) / (n_context + kinds)[context]
        retained = (n_context >= min_count) & (gain >= min_gain)
        p = np.where(retained[context], after, before)[of]
    return p


def _messages(chunks: DataFrame, buckets: int, depth: int) -> DataFrame:
    """chunk, kind, bucket, keys, counts: what each chunk asks for."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk = Chunk(b, i, depth)
                for kind, distinct in ((_WORDS, chunk.distinct_words), (_GRAMS, chunk.distinct_grams)):
                    keys, counts = distinct()
                    bucket = _bucket_of(keys, kind, buckets, depth)
                    order = np.argsort(bucket, kind="stable")
                    some, first = _starts(bucket[order])
                    parts = np.split(order, first[1:])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b["chunk"][i].as_py()] * len(some), pa.int64()),
                            pa.array([kind] * len(some), pa.int32()),
                            pa.array(some.astype(np.int32)),
                            pa.array([_shut_keys(keys[x]) for x in parts], pa.binary()),
                            pa.array([_shut(counts[x]) for x in parts], pa.binary()),
                        ],
                        ["chunk", "kind", "bucket", "keys", "counts"],
                    )
                    give_back()

    return chunks.mapInArrow(ask, "chunk bigint, kind int, bucket int, keys binary, counts binary")


def _totals(messages: DataFrame) -> DataFrame:
    """kind, bucket, keys, counts: the messages added up."""

    def add(key, t):
        keys, counts = _merged([_open_keys(x) for x in t["keys"].to_pylist()], [_open(x, np.int64) for x in t["counts"].to_pylist()])
        return pa.table({"kind": t["kind"][:1], "bucket": t["bucket"][:1], "keys": pa.array([_shut_keys(keys)], pa.binary()), "counts": pa.array([_shut(counts)], pa.binary())})

    out = "kind int, bucket int, keys binary, counts binary"
    return messages.groupBy("kind", "bucket", "salt").applyInArrow(add, out).groupBy("kind", "bucket").applyInArrow(add, out)


def _tree(totals: DataFrame, depth: int, min_count: int, min_gain: float) -> DataFrame:
    """kind, bucket, keys, answers (natural log probabilities) of all n-grams."""
    short, spark = min(depth, _SHORT), totals.sparkSession

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, keys, counts in zip(b["bucket"].to_pylist(), b["keys"].to_pylist(), b["counts"].to_pylist(), strict=True):
                gram, n = _merged([_shorter(_open_keys(keys), depth, short)], [_open(counts, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), bucket, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n)], ["bucket", "gram", "n"])

    grams = totals.where(F.col("kind") == _GRAMS)
    shorts = stored(grams.mapInArrow(shorten, "bucket int, gram bigint, n bigint"), "short-contexts")
    pair = F.shiftright("gram", 8 * short) * 256 + F.pmod("gram", F.lit(256))  # at most 65,536
    counts = np.zeros(65_536, np.int64)
    for place, n in shorts.groupBy(pair.alias("pair")).agg(F.sum("n")).collect():
        counts[place] = n
    held = spark.sparkContext.broadcast(first_order(counts.reshape(256, 256)))

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b["gram"].to_numpy().astype(np.uint64), b["n"].to_numpy()) for b in batches]
        if got:
            gram, n = _merged(*map(list, zip(*got, strict=True)))
            p = held.value[(gram >> np.uint64(8 * short)).astype(np.int64), (gram & np.uint64(255)).astype(np.int64)]
            p = deepened(gram, n, p, short, range(2, short + 1), min_count, min_gain)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(p)], ["gram", "p"])

    summed = shorts.groupBy("gram").agg(F.sum("n").alias("n")).repartition(F.shiftright("gram", 8 * (short - 1)))  # by the nearest two
    needed = shorts.select("bucket", "gram").join(summed.mapInArrow(upper, "gram bigint, p double"), "gram")

    def lower(key, t, known):
        if not t.num_rows:
            return pa.table({"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "answers": pa.array([], pa.binary())})
        keys, counts = _open_keys(t["keys"][0].as_py()), _open(t["counts"][0].as_py(), np.int64)
        gram = known["gram"].to_numpy().astype(np.uint64)
        order = np.argsort(gram)
        p = known["p"].to_numpy()[order][np.searchsorted(gram[order], _shorter(keys, depth, short))]
        p = deepened(keys, counts, p, depth, range(short + 1, depth + 1), min_count, min_gain)
        return pa.table({"kind": t["kind"], "bucket": t["bucket"], "keys": t["keys"], "answers": pa.array([_shut(np.log(p).astype(np.float32))], pa.binary())})

    return grams.groupBy("bucket").cogroup(needed.groupBy("bucket")).applyInArrow(lower, "kind int, bucket int, keys binary, answers binary")


def _tokens_and_words(totals: DataFrame) -> tuple[int, int]:
    """Tokens in training texts, and the distinct ones."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [_open(x, np.int64) for x in b["counts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in counts], pa.int64()), pa.array([int((x > 0).sum()) for x in counts], pa.int64())], ["n", "v"])

    n, v = totals.where(F.col("kind") == _WORDS).select("counts").mapInArrow(tally, "n bigint, v bigint").agg(F.sum("n"), F.sum("v")).first()
    return n or 0, v or 0


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 6, min_count: int = 4, min_gain: float = 6.0, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row.

    A row is held out, and not learned from, if crc32(doc_id as text; null: empty) mod 10 is 0.  Null texts count as
    empty: only their end is scored.  Rows are kept as often as they occur, and counted as often.  Long texts are scored
    in pieces, whose sums are added.  An empty table gives an empty result.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    rows = id_text(docs, id_col, text_col).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)
    chunks = stored(_chunks(rows, depth, chunk_chars), "chunks")
    n_chunks = chunks.count()
    buckets, salts = min(_BUCKETS, max(64, 1 << n_chunks.bit_length())), n_chunks // _SALT_CHUNKS + 1
    messages = stored(_messages(chunks, buckets, depth), "messages").withColumn("salt", F.pmod(F.hash("chunk"), F.lit(salts)))
    totals = stored(_totals(messages), "totals")
    train_tokens, vocabulary = _tokens_and_words(totals)
    model = totals.where(F.col("kind") == _WORDS).select("kind", "bucket", "keys", F.col("counts").alias("answers"))
    model = model.unionByName(_tree(totals, depth, min_count, min_gain)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def answer(key, asked, told):
        keys, values = _open_keys(told["keys"][0].as_py()), _open(told["answers"][0].as_py(), np.float32 if key[0].as_py() else np.int64)
        found = [_shut(values[np.searchsorted(keys, _open_keys(x))]) for x in asked["keys"].to_pylist()]
        back = asked["keys"] if key[0].as_py() == _GRAMS else pa.nulls(len(found), pa.binary())  # a chunk tells its words anew
        return pa.table({"chunk": asked["chunk"], "kind": asked["kind"], "bucket": asked["bucket"], "keys": back, "answers": pa.array(found, pa.binary())})

    by = ("kind", "bucket", "salt")
    answers = messages.drop("counts").groupBy(*by).cogroup(model.groupBy(*by)).applyInArrow(answer, "chunk bigint, kind int, bucket int, keys binary, answers binary")

    def score(key, chunks, answers):
        chunk = Chunk(chunks, 0, depth)

        def told(kind: int, column: str) -> dict[int, bytes]:
            these = answers.filter(pa.array([k == kind for k in answers["kind"].to_pylist()], pa.bool_()))
            return dict(zip(these["bucket"].to_pylist(), these[column].to_pylist(), strict=True))

        n = len(chunk.sizes)
        of, entry, hashes = chunk.words()
        bucket, by_bucket, c = _bucket_of(hashes, _WORDS, buckets, depth), told(_WORDS, "answers"), np.empty(len(hashes))
        order = np.lexsort((hashes, bucket))
        found, first = _starts(hashes[order])  # equal hashes are of one bucket, and so side by side
        values = np.concatenate([_open(by_bucket[k], np.int64) for k in _starts(bucket[order])[0].tolist()])
        c[order] = np.repeat(values, np.diff(first, append=len(hashes)))
        logs = np.log10(c + 0.1)
        sizes, known, base = np.bincount(of, minlength=n), np.bincount(of[(c > 0)[entry]], minlength=n), np.bincount(of, logs[entry], n)
        del of, entry, hashes, bucket, by_bucket, c, order, found, first, values
        give_back()
        keys, logs = told(_GRAMS, "keys"), told(_GRAMS, "answers")
        p, total = Table(np.concatenate([_open_keys(x) for x in keys.values()]), np.concatenate([_open(x, np.float32) for x in logs.values()])), np.zeros(n)
        del keys, logs
        for of, k in chunk.grams():
            total += np.bincount(of, p.get(k), n)
        del p
        give_back()
        return pa.table({"row": chunk.row, "doc_id": chunk.doc, "held_out": chunk.held, "n_tokens": pa.array(sizes), "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(total / np.log(10))})

    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double")
    one = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(train_tokens)) + 0.1 * (F.lit(float(vocabulary)) + 1))
    return one.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see ``score_documents``."""
    return score_documents(table(spark, sf_dir, "documents"))
