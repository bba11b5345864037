"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are TF-IDF vectors over a hashed vocabulary (document frequencies from all documents); a distributed
randomised SVD gives their latent space.  Every window of every document whose weight lies enough in the benchmark's
vocabulary is projected into it and compared with the passages by cosine.  Candidates are checked on the words: the
longest common subsequence of passage and text around the window, weighted and unweighted, and the passage's answer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, sliced, small_batches, summed_counters, table

#: Size of the hashed vocabulary: bounds what is broadcast and what reaches the driver.
VOCABULARY = 1 << 18
#: Benchmark passages that are held in memory at once; more are searched in blocks.
BLOCK_PASSAGES = 20_000
PASSAGE = 64
#: Words of a window; a passage is sought with the largest that is at most twice as long.  Windows start every third of that.
WINDOWS = (3, 6, 12, 24)
_STRIP = b".,;:!?\"'()[]{}<>|*#&%$`~_-"


def core(word: bytes) -> bytes:
    """A word in lower case and without punctuation around."""
    return word.decode("utf-8", "replace").lower().encode().strip(_STRIP)


def cores(raw: bytes) -> list[bytes]:
    """The words that candidates are checked on, one for each of term_ids."""
    return [x for x in map(core, raw.split()) if x]


class Terms(dict):
    """Hashed vocabulary numbers of the cores of words; 0: nothing left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        left = core(word)
        n = self[word] = 1 + zlib.crc32(left) % (VOCABULARY - 1) if left else 0
        return n


def term_ids(raw: bytes, terms: Terms) -> np.ndarray:
    words = raw.split()
    found = np.fromiter(map(terms.__getitem__, words), np.int32, len(words))
    return found[found > 0]


def passages_of(ids, size: int = PASSAGE) -> list:
    """ids (or words) whole, or in overlapping passages of size words."""
    if len(ids) <= size:
        return [ids] if len(ids) else []
    return [ids[a : a + size] for a in range(0, len(ids) - size // 2, size // 2)]


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Smoothed log inverse document frequency of each vocabulary number, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        terms, total = Terms(), np.zeros(VOCABULARY + 32, np.int64)
        for b in sliced(batches):
            for raw in b["text"].cast(pa.binary()).to_pylist():
                total[np.unique(term_ids(raw, terms))] += 1
            total[VOCABULARY] += b.num_rows
        return total

    small_batches(docs.sparkSession)
    total = summed_counters(docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")), count, VOCABULARY + 32)
    return np.log((total[VOCABULARY] + 1.0) / (total[:VOCABULARY] + 0.5)).clip(0.05).astype(np.float32)


def _rows(found: list[np.ndarray], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, unit weights) of each passage."""
    for ids in found:
        t, tf = np.unique(ids, return_counts=True)
        w = tf * idf[t]
        yield t, w / np.linalg.norm(w)


def latent_space(benchmark: DataFrame, idf: np.ndarray, rank: int, text_col: str = "text", rounds: int = 2, extra: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the benchmark, and their coordinates (terms x at most rank): the leading right singular vectors.

    Randomised SVD of the passage x term matrix A: from a random sign matrix, rounds of Q <- orth(A'(A Q)) in which Spark
    sums the rows of A'(A Q) over the passages; the driver only sees arrays bounded by the vocabulary.
    """
    sc, width = benchmark.sparkSession.sparkContext, rank + extra
    weights = sc.broadcast(idf)
    rows = benchmark.select(F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text"))

    def signs(t: np.ndarray) -> np.ndarray:
        return np.stack([np.random.default_rng(int(x)).integers(0, 2, width) * 2.0 - 1.0 for x in t])

    def multiply(place: np.ndarray | None, q: np.ndarray | None) -> dict[int, np.ndarray]:
        held = sc.broadcast((place, q))

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, sums, (at, matrix) = Terms(), {}, held.value
            for b in batches:
                for raw in b["text"].cast(pa.binary()).to_pylist():
                    for t, w in _rows(passages_of(term_ids(raw, terms)), weights.value):
                        y = w @ (signs(t) if matrix is None else matrix[at[t]])
                        for i, x in zip(t.tolist(), w, strict=True):
                            sums[i] = sums.get(i, 0.0) + x * y
            if sums:
                yield pa.RecordBatch.from_pydict({"term": pa.array(sums.keys(), pa.int32()), "row": [x.tobytes() for x in sums.values()]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for i, x in zip(b["term"].to_pylist(), b["row"].to_pylist(), strict=True):
                    sums[i] = sums.get(i, 0.0) + np.frombuffer(x)
            if sums:
                yield pa.RecordBatch.from_pydict({"term": pa.array(sums.keys(), pa.int32()), "row": [x.tobytes() for x in sums.values()]})

        kind = "term int, row binary"
        return {i: np.frombuffer(x) for i, x in rows.mapInArrow(products, kind).repartition("term").mapInArrow(add, kind).collect()}

    place, q, names = None, None, np.empty(0, np.int64)
    for _ in range(rounds + 1):
        found = multiply(place, q)
        if not found:
            return names, np.empty((0, 0), np.float32)
        names = np.array(sorted(found), np.int64)
        z = np.stack([found[i] for i in names.tolist()])
        left, values, _ = np.linalg.svd(z, full_matrices=False)
        q = left[:, values > 1e-9 * values[0]]
        place = np.zeros(VOCABULARY, np.int32)
        place[names] = np.arange(len(names))
    return names, q[:, :rank].astype(np.float32)


def common_subsequence(passage: list, region: list) -> np.ndarray:
    """Which words of passage a longest common subsequence with region uses (bit-parallel, then traced)."""
    m = len(passage)
    where: dict = {}
    for i, t in enumerate(passage):
        where[t] = where.get(t, 0) | 1 << i
    full, v, steps = (1 << m) - 1, (1 << m) - 1, []
    used = [where.get(t, 0) for t in region]
    for mask in used:
        u = v & mask
        v = ((v + u) | (v - u)) & full
        steps.append(v)
    out, i, j = np.zeros(m, bool), m, len(steps)
    # zeros of steps[j] up to i count the subsequence of the first i words of passage and j of region
    count = lambda j, i: i - (steps[j - 1] & ((1 << i) - 1)).bit_count() if j else 0
    while i and j:
        if count(j, i) == count(j, i - 1):
            i -= 1
        elif count(j - 1, i) == count(j, i):
            j -= 1
        else:
            out[i - 1] = True
            i, j = i - 1, j - 1
    return out


def _judge(passage: list[bytes], w: np.ndarray, answer: list[bytes], region: list[bytes]) -> tuple[float, float, float]:
    """Shares of passage words, of their weight w, and of answer words that region has in order."""
    hit = common_subsequence(passage, region)
    told = common_subsequence(answer, region) if len(answer) else np.ones(1, bool)
    return float(hit.mean()), float(w[hit].sum() / w.sum()), float(told.mean())


_OUT = "doc_id bigint, item_id bigint, cosine double, lcs double, weighted_lcs double, answer double"


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
    rank: int = 64, min_share: float = 0.35, min_cosine: float = 0.6, min_lcs: float = 0.5, min_weighted: float = 0.5, min_answer: float = 0.5,
) -> DataFrame:
    """doc_id, item_id, cosine, lcs, weighted_lcs, answer of every document and benchmark item it contains, or paraphrases.

    A window of 24 words (less for passages under 12 words) is compared if min_share of its squared weight lies in the benchmark's vocabulary; a passage is
    a candidate from a latent cosine of min_cosine.  It leaks if the text around the window holds, in order, min_lcs of
    its words, min_weighted of their weight, and min_answer of the words of its answer: answer_col, or, where a benchmark
    names none, the last third of the passage.  Items of over 64 words are compared in overlapping passages, any of which
    counts.  Repeated rows of a document give one row an item, with the best of each measure in the order above from lcs on;
    rows of a null id are one document of that id; null texts, texts without words and an empty benchmark leak nothing.
    The cosine search is by hashed words; what it finds is checked on the words themselves.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(benchmark[item_col].cast("bigint").alias("item_id"), F.coalesce(benchmark[item_text_col].cast("string"), F.lit("")).alias("text"), (benchmark[answer_col].cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"))
    words = items.agg(F.sum(F.size(F.split("text", " ")) / (PASSAGE // 2) + 1)).first()[0] or 0
    blocks = max(1, -(-int(words) // BLOCK_PASSAGES))
    idf = inverse_frequencies(docs, text_col)
    names, axes = latent_space(items, idf, rank)
    place = np.full(VOCABULARY, -1, np.int32)
    place[names] = np.arange(len(names))
    space = sc.broadcast((idf, place, axes))
    rows = id_text(docs, id_col, text_col)
    found = None
    for k in range(blocks):
        block, terms = [], Terms()
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect():
            answer, raw = cores(r.answer.encode()) if r.answer else None, r.text.encode()
            for p, spelled in zip(passages_of(term_ids(raw, terms)), passages_of(cores(raw)), strict=True):
                block.append((r.item_id, p, spelled, spelled[-max(1, len(p) // 3) :] if answer is None else answer))
        if block and axes.size:
            one = rows.mapInArrow(_searcher(sc.broadcast(block), space, min_share, min_cosine, min_lcs, min_weighted, min_answer), _OUT)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], _OUT)
    best = F.struct("lcs", "weighted_lcs", "answer", "cosine")
    return found.groupBy("doc_id", "item_id").agg(F.max(best).alias("m")).select("doc_id", "item_id", "m.cosine", "m.lcs", "m.weighted_lcs", "m.answer")


def _searcher(block, space, min_share: float, min_cosine: float, min_lcs: float, min_weighted: float, min_answer: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, place, axes = space.value
        passages = block.value
        latent = np.stack([(idf[p][:, None] * axes[place[p]]).sum(0) for _, p, _, _ in passages])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        by_window = {}
        for j, (_, p, _, _) in enumerate(passages):
            by_window.setdefault(window_for(len(p)), []).append(j)
        terms = Terms()
        for b in sliced(batches):
            raws, spelled = b["text"].cast(pa.binary()).to_pylist(), {}
            ids = [term_ids(raw, terms) for raw in raws]
            sizes = np.array([len(x) for x in ids], np.int64)
            word = np.concatenate(ids) if len(ids) else np.empty(0, np.int32)
            ends = np.cumsum(sizes)
            row, weight = place[word], idf[word]
            both, inside = (np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)]) for x in (weight**2, np.where(row >= 0, weight**2, 0.0)))
            best: dict[tuple[int, int], tuple] = {}
            tried: set[tuple[int, int, int]] = set()
            for width, sought in by_window.items():
                start, doc = _windows(sizes, width)
                stop = np.minimum(start + width, ends[doc])
                open_ = np.flatnonzero(inside[stop] - inside[start] >= min_share * (both[stop] - both[start]))
                for a in range(0, len(open_), 4096):
                    part = open_[a : a + 4096]
                    at = np.minimum(start[part, None] + np.arange(width), len(word) - 1)
                    use = (np.arange(width) < (stop - start)[part, None]) & (row[at] >= 0)
                    x = np.einsum("ij,ijk->ik", np.where(use, weight[at], 0.0).astype(np.float32), axes[np.where(use, row[at], 0)])
                    cosine = (x @ latent[sought].T) / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                    for i, j in zip(*np.nonzero(cosine >= min_cosine), strict=True):
                        w, (item, passage, words, answer) = part[i], passages[sought[j]]
                        d = int(doc[w])
                        first, last = int(ends[d] - sizes[d]), int(ends[d])
                        around = len(passage) + len(passage) // 2
                        spot = (d, sought[j], int(start[w] - first) // around)
                        if spot in tried:
                            continue
                        tried.add(spot)
                        near = first + spot[2] * around
                        a0, a1 = max(first, near - around), min(last, near + 2 * around + width)
                        held = np.isin(passage, word[a0:a1])  # bounds the subsequence from above
                        if held.mean() < min_lcs or idf[passage][held].sum() < min_weighted * idf[passage].sum():
                            continue
                        if d not in spelled:
                            spelled[d] = cores(raws[d])
                        lcs, weighted, told = _judge(words, idf[passage], answer, spelled[d][a0 - first : a1 - first])
                        if lcs >= min_lcs and weighted >= min_weighted and told >= min_answer:
                            new = (lcs, weighted, told, float(cosine[i, j]))
                            best[d, item] = max(best.get((d, item), new), new)
            doc_ids = b["doc_id"].to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([doc_ids[d] for d, _ in best], pa.int64()), "item_id": pa.array([i for _, i in best], pa.int64()),
                **{n: pa.array([v[k] for v in best.values()], pa.float64()) for k, n in ((3, "cosine"), (0, "lcs"), (1, "weighted_lcs"), (2, "answer"))},
            })

    return search


def window_for(passage_words: int) -> int:
    return max((w for w in WINDOWS if w <= 2 * passage_words), default=WINDOWS[0])


def _windows(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of texts laid end to end, the last of each reaching its end, and their texts."""
    stride = width // 3
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - width) // stride)), 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return (np.cumsum(sizes) - sizes)[doc] + number * stride, doc


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, without documents in which find_leaks finds an item.

    Rows without an id stay; repeated rows go or stay together; an empty benchmark lets all stay.  Columns of any name,
    ``_gone`` too, are kept as they are.
    """
    gone = find_leaks(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold or paraphrase; see ``find_leaks``."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
