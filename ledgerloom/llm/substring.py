"""Removal of repeated passages by prefix-partitioned suffix trees.

Winnowing marks one short word sequence in each window: the one of least path, the first of equals.  Windows of equal
words have equal marks at equal places, so the suffixes that start at marks stand for all windows around them; a run of
windows with one mark travels as one row.

0. A text that a smaller id has too, to the letter, is settled by its digest; the rest works on the first of each.
1. A window can be repeated only if its mark is; marks that occur in one text alone are leaves next to the root and are
   left out (no false dismissals).
2. The other suffixes are split by a prefix of variable length: the mark where its occurrences fit in memory, else the
   whole window.  Each carries the words of its windows as edges, to both sides of its prefix.
3. In each group the edges are sorted, to the right and to the left, and the common prefixes of neighbours give the
   internal nodes of every depth.  Suffixes that meet in nodes whose depths to both sides make up the window hold a
   repeat; all of them but those of its smallest document are reported.  Joined, such windows are the maximal repeats.

Tasks build the same trees over what they hold before anything is shuffled, so that of a passage which a third of all
documents share one document a task is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, id_text, mix64, sha_of, sliced, stored, table, task_count

#: Suffixes that share a prefix, at most, if it is no whole window; suffixes whose trees are built at once, about.
GROUP_SUFFIXES, BLOCK_SUFFIXES = 100_000, 150_000
_LAST = 2**63 - 1
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Bit of a row's windows that says that its prefix is a whole window; bytes of a word in an edge.
_WHOLE, _WIDE = 62, 6
_ROW = ["prefix", "uid", "oid", "place", "windows", "edges"]


def _words(batch: pa.RecordBatch, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the batch's texts, and how many each text has."""
    return _hashed(batch["text"].cast(pa.binary()).to_pylist(), hashes)


def _hashed(raws: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    split = [t.split() for t in raws]
    counts = np.array([len(x) for x in split], np.int64)
    return np.fromiter((hashes[w] for x in split for w in x), np.uint64, counts.sum()), counts


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, doc_id and the text compressed: what is shuffled is stored twice."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in sliced(batches):
        yield pa.RecordBatch.from_arrays([b["uid"], b["doc_id"], pa.array(map(pack, b["text"].cast(pa.binary()).to_pylist()), pa.binary())], ["uid", "doc_id", "packed"])


def _unpacked(b: pa.RecordBatch) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, b["packed"].to_pylist()))


def _paths(words: np.ndarray, at: np.ndarray, depths: list[int]) -> list[np.ndarray]:
    """For each start in at, the 64-bit path of its first d words, for each d of depths (ascending)."""
    x, out, done = np.full(len(at), _SEED), [], 0
    for d in depths:
        for j in range(done, d):
            x = mix64(x ^ words[at + j]) + np.uint64(j + 1)
        done = d
        out.append(x)
    return out


def _marks(words: np.ndarray, counts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, and the place and the path of the marked k words of each window."""
    starts = np.cumsum(counts) - counts
    ends = np.repeat(starts + counts, counts)
    at = np.flatnonzero(np.arange(len(words)) + window <= ends)
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    grams = _paths(words, np.arange(len(words) - k + 1), [k])[0]
    least, place = grams[at], at.copy()
    for j in range(1, window - k + 1):
        other = grams[at + j]
        less = other < least
        place[less] = at[less] + j
        np.minimum(least, other, out=least)
    return at, place, least


def _short(mark: np.ndarray) -> np.ndarray:
    """48 bits tell marks apart well enough where a mix-up only lets suffixes pass."""
    return (mark >> np.uint64(16)).astype(np.int64)


def _new(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys starts."""
    if not len(sorted_keys[0]):
        return np.empty(0, np.int64)
    changed = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return np.flatnonzero(np.concatenate([[True], changed]))


def _arrow(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _repeated_marks(rows: DataFrame, window: int, k: int, parts: int) -> DataFrame:
    """text_id, mark, n: of every text each mark that another text has too (n 0), and marks that occur n times, over
    GROUP_SUFFIXES (text_id 0)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # n over 0: occurrences in the only text of the task that has it; under 0: in several texts; 0: known to be repeated
        hashes, marks, ids, names = WordHashes(), [], [], ["mark", "text_id", "n"]

        def flush() -> pa.RecordBatch:
            mark, text = np.concatenate(marks), np.concatenate(ids)
            order = np.lexsort((text, mark))
            one = _new(mark[order], text[order])
            n, mark, text = np.diff(one, append=len(order)), mark[order][one], text[order][one]
            new = _new(mark)
            size = np.diff(new, append=len(mark))
            known = np.repeat(size > 1, size)
            total = np.add.reduceat(n, new) if len(new) else n
            return _arrow(names, np.concatenate([mark[new], mark[known]]), np.concatenate([text[new], text[known]]), np.concatenate([np.where(size > 1, -total, total), np.zeros(known.sum(), np.int64)]))

        for b in sliced(batches):
            words, counts = _words(b, hashes)
            at, place, mark = _marks(words, counts, window, k)
            one = _new(place)
            marks.append(_short(mark[one]))
            ids.append(np.repeat(b["text_id"].to_numpy(), counts)[at[one]])
            if sum(map(len, marks)) > 1_000_000:
                yield flush()
                marks, ids = [], []
        if marks:
            yield flush()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, got = ["text_id", "mark", "n"], []
        for b in batches:
            mark, text, n = (b[c].to_numpy() for c in ("mark", "text_id", "n"))
            told = n == 0
            yield _arrow(names, text[told], mark[told], n[told])
            got.append((mark[~told], text[~told], n[~told]))
        if got:
            mark, text, n = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((text, mark))
            mark, text, n = mark[order], text[order], n[order]
            new = _new(mark)
            size = np.diff(new, append=len(mark))
            total = np.add.reduceat(abs(n), new) if len(new) else n
            several = np.logical_or.reduceat((n < 0) | (text != np.repeat(text[new], size)), new) if len(new) else np.empty(0, bool)
            found = np.repeat(several, size) & (n > 0)
            yield _arrow(names, text[found], mark[found], np.zeros(found.sum(), np.int64))
            many = total > GROUP_SUFFIXES
            yield _arrow(names, np.zeros(many.sum(), np.int64), mark[new][many], total[many])

    sent = rows.select("text_id", "text").mapInArrow(emit, "mark bigint, text_id bigint, n bigint")
    return sent.repartition(parts, F.when(F.col("n") == 0, F.col("text_id")).otherwise(F.col("mark"))).mapInArrow(find, "text_id bigint, mark bigint, n bigint")


def _nodes(prefix: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each depth below the prefix, the number of each suffix's node: sorted suffixes, cut where neighbours differ."""
    order = np.lexsort((*edges.T[::-1], prefix))
    sorted_prefix, sorted_edges = prefix[order], edges[order]
    same = np.column_stack([sorted_prefix[1:] == sorted_prefix[:-1], sorted_edges[1:] == sorted_edges[:-1]])
    common = np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1)  # with the suffix before: the prefix, then words
    nodes = np.empty((edges.shape[1] + 1, len(prefix)), np.int64)
    for depth in range(len(nodes)):
        nodes[depth, order] = np.cumsum(np.concatenate([[0], common <= depth]))
    return nodes


def _later(prefix: np.ndarray, oid: np.ndarray, windows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each suffix's windows (bit o: the one that starts o words before it), those that a smaller document has too."""
    out = np.zeros(len(prefix), np.int64)
    order = np.argsort(prefix, kind="stable")
    size = np.diff(_new(prefix[order]), append=len(order))
    rows = order[np.repeat(size > 1, size)]
    if not len(rows):
        return out
    to_right, to_left = _nodes(prefix[rows], right[rows]), _nodes(prefix[rows], left[rows])
    own, bits = oid[rows], windows[rows]
    for o in range(left.shape[1] + 1):
        some = np.flatnonzero((bits >> o) & 1)
        node = to_right[-1 - o][some] * len(rows) + to_left[o][some]
        order = np.lexsort((own[some], node))
        new = _new(node[order])
        least = np.repeat(own[some][order][new], np.diff(new, append=len(order)))
        later = some[order[own[some][order] > least]]
        out[rows[later]] |= 1 << o
    return out


def _reach(windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that a suffix's windows cover before it, and after its mark."""
    bits = (windows[:, None] >> np.arange(span + 1)) & 1
    return span - np.argmax(bits[:, ::-1], axis=1), span - np.argmax(bits, axis=1)


def _shut_edges(windows: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Array:
    """The words in reach, nearest first, to the left and then to the right, in one binary a row."""
    span = left.shape[1]
    before, after = _reach(windows, span)
    there = np.column_stack([np.arange(span) < before[:, None], np.arange(span) < after[:, None]])
    data = np.column_stack([left, right])[there].view(np.uint8).reshape(-1, 8)[:, :_WIDE].tobytes()
    offsets = np.concatenate([[0], np.cumsum((before + after) * _WIDE)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(windows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _open_edges(windows: np.ndarray, edges: pa.Array, span: int) -> tuple[np.ndarray, np.ndarray]:
    before, after = _reach(windows, span)
    there = np.column_stack([np.arange(span) < before[:, None], np.arange(span) < after[:, None]])
    joined = np.frombuffer(b"".join(edges.to_pylist()), np.uint8).reshape(-1, _WIDE)
    wide = np.zeros((len(joined), 8), np.uint8)
    wide[:, :_WIDE] = joined
    both = np.zeros(there.shape, np.uint64)
    both[there] = wide.view(np.uint64).ravel()
    return both[:, :span], both[:, span:]


def _repeats(texts: DataFrame, marks: DataFrame, firsts: DataFrame, copies: DataFrame, window: int, k: int, parts: int) -> DataFrame:
    """uid, found: array of (oid, place, windows): windows that a document with a smaller id has too, by their mark."""
    span = window - k

    def rows_of(b: pa.RecordBatch, hashes: WordHashes) -> list[np.ndarray]:
        """prefix, text, uid, oid, place, windows, left and right of the suffixes at repeated marks."""
        words, n = _hashed(_unpacked(b), hashes)
        at, place, mark = _marks(words, n, window, k)
        new = _new(place)
        windows = np.bitwise_or.reduceat(1 << (place - at), new) if len(new) else at
        doc, place, mark = np.repeat(np.arange(len(n)), n)[at[new]], place[new], mark[new]
        # texts and marks as one key; equal keys of different pairs only let a suffix pass that drops out later
        listed = np.asarray(b["marks"].flatten(), np.int64)
        owner = np.repeat(np.arange(len(n)), np.asarray(b["marks"].value_lengths()))
        keys = mix64((listed >> 1).astype(np.uint64)) ^ owner.astype(np.uint64)
        order = np.argsort(keys)
        key = mix64(_short(mark).astype(np.uint64)) ^ doc.astype(np.uint64)
        near = order[np.minimum(np.searchsorted(keys[order], key), len(keys) - 1)]
        kept = keys[near] == key
        many, doc, place, windows = (listed[near] & 1).astype(bool)[kept], doc[kept], place[kept], windows[kept]
        prefix = _paths(words, place, [k])[0]
        # of marks that occur too often, one row a window, with all its words as the prefix
        row, o = np.nonzero((windows[many][:, None] >> np.arange(span + 1)) & 1)
        row = np.flatnonzero(many)[row]
        whole = _paths(words, place[row] - o, [window])[0]
        rest = np.flatnonzero(~many)
        prefix, windows = np.concatenate([prefix[rest], whole]), np.concatenate([windows[rest], (1 << o) | (1 << _WHOLE)])
        doc, place = np.concatenate([doc[rest], doc[row]]), np.concatenate([place[rest], place[row]])
        before, after = _reach(windows, span)
        step, last = np.arange(span), max(0, len(words) - 1)
        left = np.where(step < before[:, None], words[np.maximum(place[:, None] - 1 - step, 0)] >> np.uint64(16), np.uint64(0))
        right = np.where(step < after[:, None], words[np.minimum(place[:, None] + k + step, last)] >> np.uint64(16), np.uint64(0))
        return [prefix, b["uid"].to_numpy()[doc], b["oid"].to_numpy()[doc], place - (np.cumsum(n) - n)[doc], windows, left, right]

    def batch(prefix: np.ndarray, uid: np.ndarray, oid: np.ndarray, place: np.ndarray, windows: np.ndarray, edges: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64, copy=False)) for x in (prefix.view(np.int64), uid, oid, place, windows)), edges], _ROW)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found = WordHashes(), []

        def flush() -> Iterator[pa.RecordBatch]:
            prefix, uid, oid, place, windows, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            told = _later(prefix, oid, windows, left, right)
            left_over = windows & ~told
            some = np.flatnonzero(left_over & ~(1 << _WHOLE))
            yield batch(prefix[some], uid[some], oid[some], place[some], left_over[some], _shut_edges(left_over[some], left[some], right[some]))
            some = np.flatnonzero(told)  # known already: they only go to their text
            yield batch(uid[some], uid[some], oid[some], place[some], told[some], pa.nulls(len(some), pa.binary()))

        for b in sliced(batches, "packed", 1_000_000):
            found.append(rows_of(b, hashes))
            if sum(len(x[0]) for x in found) > BLOCK_SUFFIXES:
                yield from flush()
                found = []
        if found:
            yield from flush()

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by prefix and document, in blocks of whole groups; a group of one window may go on in the next."""
        names, held = ["uid", "oid", "place", "windows"], []

        def told(t: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([t[c].combine_chunks() for c in names], names)

        def block(t: pa.Table) -> pa.RecordBatch:
            prefix, uid, oid, place, windows = (t[c].to_numpy() for c in _ROW[:-1])
            later = _later(prefix.view(np.uint64), oid, windows, *_open_edges(windows, t["edges"], span))
            some = np.flatnonzero(later)
            return _arrow(names, uid[some], oid[some], place[some], later[some])

        for b in batches:
            t = pa.Table.from_batches([b])
            known = pc.is_null(t["edges"])
            yield told(t.filter(known))
            held.append(t.filter(pc.invert(known)))
            if sum(x.num_rows for x in held) > BLOCK_SUFFIXES:
                t = pa.concat_tables(held)
                prefix = t["prefix"].to_numpy()
                cut = int(_new(prefix)[-1])
                if t["windows"][cut].as_py() >> _WHOLE:  # all rows of that prefix are one window, the smallest document's first
                    yield block(t)
                    held = [t.slice(cut, 1)]
                else:
                    if cut:
                        yield block(t.slice(0, cut))
                    held = [t.slice(cut)]
        if held:
            yield block(pa.concat_tables(held))

    repeated = marks.where(F.col("n") == 0)
    many = marks.where(F.col("n") > 0).select("mark", F.lit(1).alias("many"))
    flagged = repeated.join(many, "mark", "left").select("text_id", (F.col("mark") * 2 + F.coalesce("many", F.lit(0))).alias("mark"))
    lists = flagged.groupBy("text_id").agg(F.collect_list("mark").alias("marks")).join(firsts, "text_id").select("uid", "marks")
    sent = texts.join(lists, "uid").select("uid", _oid().alias("oid"), "packed", "marks").mapInArrow(suffixes, ", ".join(f"{x} bigint" for x in _ROW[:-1]) + ", edges binary")
    found = sent.repartition(parts, "prefix").sortWithinPartitions("prefix", "oid").mapInArrow(trees, "uid bigint, oid bigint, place bigint, windows bigint")
    return found.unionByName(copies).groupBy("uid").agg(F.collect_list(F.struct("oid", "place", "windows")).alias("found"))


def _oid():
    return F.coalesce("doc_id", F.lit(_LAST))


def drop_repeats(docs: DataFrame, window: int = 13, mark: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words joined by one space) of every row.

    A word goes if it is covered by window consecutive words which, in the same sequence, start in a document with a
    smaller id too; windows are judged on the input.  Prefixes are compared by 64 bits, the other words of a window one
    by one, by 48 bits each.  A null id counts as larger than all others; rows with one id count as one document; null
    texts have no words; an empty table gives an empty result.  Other columns of docs, whatever their names, stay out.
    """
    if not 3 < mark <= window <= mark + 60:
        raise ValueError("mark must be over 3 and at most window, and window at most mark + 60")
    parts = task_count(docs)
    rows = id_text(docs, id_col, text_col).withColumns({"uid": F.xxhash64("doc_id", "text"), "text_id": F.xxhash64("text")})
    each = rows.select("uid", "text_id", _oid().alias("oid"), F.unhex(F.md5("text")).alias("digest"))
    first = each.groupBy("digest").agg(F.min(F.struct("oid", "uid")).alias("first"), F.min("text_id").alias("text_id"))
    copies = each.drop("text_id").join(first, "digest").where(F.col("oid") > F.col("first.oid"))
    copies = copies.select("uid", "oid", F.lit(-1).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("windows")).distinct()
    texts = rows.select("uid", "doc_id", "text").mapInArrow(_packed, "uid bigint, doc_id bigint, packed binary").repartition(parts, "uid")
    marks = stored(_repeated_marks(rows, window, mark, parts), "marks")
    found = _repeats(texts, marks, first.select("text_id", "first.uid"), copies, window, mark, parts).withColumnRenamed("uid", "r_uid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "packed", 2_000_000):
            ids = b["doc_id"].fill_null(_LAST).to_numpy()
            split = [raw.split() for raw in _unpacked(b)]
            n = np.array([len(x) for x in split], np.int64)
            base = np.cumsum(n) - n
            of = np.repeat(np.arange(len(n)), np.asarray(pc.fill_null(pc.list_value_length(b["found"]), 0)))
            oid, place, windows = (np.asarray(b["found"].flatten().field(i), np.int64) for i in range(3))
            own = oid == ids[of]
            edge = np.zeros(n.sum() + 1, np.int64)
            copy = np.unique(of[own & (place < 0)])  # the whole text is a copy
            copy = copy[n[copy] >= window]
            np.add.at(edge, base[copy], 1)
            np.add.at(edge, base[copy] + n[copy], -1)
            for o in range(window - mark + 1):
                some = own & (place >= 0) & ((windows >> o) & 1 > 0)
                start = base[of[some]] + place[some] - o
                np.add.at(edge, start, 1)
                np.add.at(edge, start + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.append(base, n.sum())])
            kept = [b" ".join(x if not g else [w for w, c in zip(x, gone[at : at + len(x)].tolist(), strict=True) if not c]) for x, g, at in zip(split, n_gone.tolist(), base.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(n_gone), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    both = texts.join(found, texts["uid"] == found["r_uid"], "left")
    return both.select("doc_id", "packed", "found").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 13-word windows removed from all documents; see ``drop_repeats``."""
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", sha_of(F.col("kept_text")).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS oid,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT r, oid, g AS i, ws[g] AS word, CASE WHEN g + 12 <= len(ws) THEN array_to_string(ws[g:g+12], ' ') END AS win
  FROM w, unnest(range(1, len(ws) + 1)) AS u(g)),
f AS (SELECT r, i, word, CASE WHEN win IS NOT NULL AND min(oid) OVER (PARTITION BY win) < oid THEN 1 ELSE 0 END AS hit FROM p),
c AS (SELECT r, i, word, max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT r, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
"""
