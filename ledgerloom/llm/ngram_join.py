"""Self-join of documents on the Jaccard similarity of their word n-gram sets, and the groups that the links form.

Documents with the same set are one class; classes are compared.  A class is indexed under the n-grams of its prefix in
rare-first order; candidates share a prefix n-gram and pass the length and positional filters in the join and a suffix
filter after it, and each pair is verified once on the whole sets.

Only components are asked for, so a pair whose ends are known to be connected needs no check.  The first round links the
members of each n-gram's list to the member whose prefix reaches that n-gram earliest (a list gives as many pairs as it
has members; a long list is dealt in parts, whose earliest members are linked likewise); the second takes the remaining pairs
between different components, block by block of the parts: of a list's largest component each member meets only the
members of other components, so that a list with one stray has as many pairs as members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, id_text, mix64, sliced, stored, summed_counters, table, task_count

#: Counters of the document-frequency sketch: a fixed size, whatever the corpus.
SKETCH = 1 << 19
#: Entries that one part of an n-gram's list has, about; bits of the map of ids.
LIST, BITMAP = 20_000, 1 << 25
_SIGNATURE = 16


def shingle_set(raw: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; the whole sequence if it has fewer words."""
    words = raw.lower().split()
    m = len(words)
    if not m:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, m)
    k = min(n, m)
    x = np.full(m - k + 1, 0x9E3779B97F4A7C15 * k % (1 << 64), np.uint64)
    for j in range(k):
        x = mix64(x ^ w[j : m - k + 1 + j]) + np.uint64(j + 1)
    return np.unique(x)


def _frequencies(rows: DataFrame, n: int) -> np.ndarray:
    """How many documents have each counter's shingles; all documents count."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        hashes, counts = WordHashes(), np.zeros(SKETCH, np.int64)
        for b in sliced(batches):
            sets = [shingle_set(t, n, hashes) for t in b["text"].cast(pa.binary()).to_pylist()]
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        return counts

    return summed_counters(rows.select("text"), count, SKETCH)


def _prefixes(rows: DataFrame, n: int, pct: int) -> DataFrame:
    """doc_id, n_shingles, key (of the set), tokens (the prefix, rarest first), splits and signature of every row.

    splits: into how many parts a prefix n-gram's list is dealt, by the frequency of its counter.
    """
    held = rows.sparkSession.sparkContext.broadcast(_frequencies(rows, n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often = WordHashes(), held.value
        for b in sliced(batches):
            sizes, keys, tokens, splits, signatures = [], [], [], [], []
            for t in b["text"].cast(pa.binary()).to_pylist():
                s = shingle_set(t, n, hashes)
                size, counts = len(s), often[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                order = np.argsort(counts, kind="stable")[: size - -(-pct * size // 100) + 1 if size else 0]
                order = order[counts[order] > 1]  # a counter of one document's n-gram: no list
                sizes.append(size)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if size else None)
                tokens.append(s[order].view(np.int64))
                splits.append((1 + counts[order] // LIST).astype(np.int32))
                signatures.append(np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=_SIGNATURE).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(splits, pa.list_(pa.int32())), pa.array(signatures, pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "key", "tokens", "splits", "signature"],
            )

    return rows.mapInArrow(cut, "doc_id bigint, n_shingles bigint, key binary, tokens array<bigint>, splits array<int>, signature array<int>")


def _similar_enough(n_a: Column, n_b: Column, overlap: Column, pct: int) -> Column:
    """overlap / union >= pct / 100, in whole numbers."""
    return (100 + pct) * overlap >= pct * (n_a + n_b)


def _verified(pairs: DataFrame, rows: DataFrame, n: int, pct: int) -> DataFrame:
    """Those pairs (a, b) of ids of which two texts have sets that are similar enough.

    A bitmap of fixed size, of the ids in pairs, keeps most other texts from being shuffled; the joins are exact.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(BITMAP // 8, np.uint8)
        for b in batches:
            at = np.unique(_bit(b["id"].to_numpy()))
            np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        return bits

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    held = rows.sparkSession.sparkContext.broadcast(_any_bits(ids, mark))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _bit(b["id"].to_numpy())
            yield b.filter(pa.array((held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1, pa.bool_()))

    texts = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").mapInArrow(wanted, "id bigint, text string")
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return _compared(pairs.join(a, "a").join(b, "b"), n, pct, "bigint").distinct()


def _compared(pairs: DataFrame, n: int, pct: int, kind: str) -> DataFrame:
    """Those of pairs (a, b, text_a, text_b) whose texts have sets that are similar enough; kind: the type of a and b."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches, "text_a"):
            ok = []
            for x, y in zip(b["text_a"].cast(pa.binary()).to_pylist(), b["text_b"].cast(pa.binary()).to_pylist(), strict=True):
                x, y = shingle_set(x, n, hashes), shingle_set(y, n, hashes)
                ok.append((100 + pct) * len(np.intersect1d(x, y, assume_unique=True)) >= pct * (len(x) + len(y)) > 0)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, f"a {kind}, b {kind}")


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(BITMAP)).astype(np.int64)


def _any_bits(ids: DataFrame, mark) -> np.ndarray:
    """The union of the bitmaps of all partitions, put together in slices."""
    slices = 32

    def partial(batches):
        for k, x in enumerate(np.split(mark(batches), slices)):
            if x.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": [x.tobytes()]})

    def either(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["slice"].to_pylist(), b["bits"].to_pylist(), strict=True):
                found[k] = found.get(k, 0) | np.frombuffer(x, np.uint8)
        for k, x in found.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": [x.tobytes()]})

    out, width = np.zeros(BITMAP // 8, np.uint8), BITMAP // 8 // slices
    for k, x in ids.mapInArrow(partial, "slice int, bits binary").repartition(slices, "slice").mapInArrow(either, "slice int, bits binary").collect():
        out[k * width : (k + 1) * width] = np.frombuffer(x, np.uint8)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node connected to it.

    Alternating large and small stars; every round is stored, so a lost executor costs one round at most.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        split = edges.groupBy("a").count().where("count > 1")  # a node with two roots: its component is not one star yet
        if split.isEmpty() and edges.join(edges.select(F.col("b").alias("x")).distinct(), F.col("a") == F.col("x"), "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def ngram_groups(docs: DataFrame, n: int = 5, min_similarity_pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, n_verified and component_id of every row.

    Two documents link if 100 * |intersection| >= min_similarity_pct * |union| of their sets of n-word shingles (A-Z
    lower-cased).  component_id is the smallest doc_id reachable, the document's own included.  n_verified counts
    the links of the document's class that were verified for that: links between documents already connected need not be
    among them, but no component lacks one; ngram_links and link_counts have them all.  Documents without words, and rows without an id, link with nothing (component_id: their id).
    Rows are kept as often as they occur; a repeated id stands for all its texts.
    """
    if not 1 <= min_similarity_pct <= 100 or n < 1:
        raise ValueError("n must be positive and the similarity between 1 and 100 percent")
    pct, rows = min_similarity_pct, id_text(docs, id_col, text_col)
    parts = task_count(docs)
    sets = stored(_prefixes(rows, n, pct), "prefixes")
    linked = sets.where("key IS NOT NULL AND doc_id IS NOT NULL")
    # rep, the smallest id of the class, stands for it from here
    classes = stored(linked.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "classes")
    first = linked.select("doc_id", "key", "tokens", "splits").join(classes.select("key", "rep", "n"), "key").where("doc_id = rep").dropDuplicates(["rep", "key"])
    entries = first.select("rep", "n", F.posexplode(F.arrays_zip("tokens", "splits")).alias("pos", "x")).select("rep", "n", "pos", F.col("x.tokens").alias("token"), F.col("x.splits").alias("splits"))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("rep"), "splits").cast("int")).repartition(parts, "token", "part")

    alpha = F.ceil(pct * (F.col("n_a") + F.col("n_b")) / (100 + pct))
    fits = (pct * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")) & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= alpha)

    # first round: the members of each part of a list against its earliest, and these against the list's earliest
    part = Window.partitionBy("token", "part")
    listed = entries.select("*", F.min(F.struct("pos", "n", "rep")).over(part).alias("p"), F.count("*").over(part).alias("c")).where("c > 1 OR splits > 1")
    listed = stored(listed.select("token", "splits", "part", "rep", "n", "pos", "p"), "lists")
    heads = listed.where("splits > 1").select("token", "p").distinct()
    heads = heads.select("token", "p", F.min("p").over(Window.partitionBy("token")).alias("q"))
    stars = listed.select("rep", "n", "pos", "p").unionByName(heads.select("p.rep", "p.n", "p.pos", F.col("q").alias("p")))
    stars = stars.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("p.rep").alias("b"), F.col("p.n").alias("n_b"), F.col("p.pos").alias("pos_b")).where((F.col("a") != F.col("b")) & fits)
    stars = stored(_suffix_filtered(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, pct), "stars")
    links = stored(_verified(stars, rows, n, pct), "links")
    roots = components(links)

    # second round: what is left between components; members of a list's largest component only meet the others
    placed = listed.join(roots, listed["rep"] == roots["node"], "left").select("token", "splits", "part", "pos", "n", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("token")
    open_ = stored(placed.join(mixed, "token"), "open")
    tops = open_.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("top"))
    open_ = open_.join(tops, "token")
    a, b = (
        side.select("token", F.col("part").alias(at), F.explode(F.expr("sequence(0, splits - 1)")).alias(other), "top", F.col("pos").alias(f"pos_{x}"), F.col("n").alias(f"n_{x}"), F.col("rep").alias(x), F.col("root").alias(f"root_{x}"))
        for x, at, other, side in (("a", "p", "q", open_.where("root != top")), ("b", "q", "p", open_))
    )
    once = (F.col("root_b") == F.col("top")) | (F.col("a") < F.col("b"))
    pairs = a.join(b.drop("top"), ["token", "p", "q"]).where(once & (F.col("root_a") != F.col("root_b")) & fits)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(_suffix_filtered(pairs.join(stars, ["a", "b"], "left_anti"), classes, pct), "pairs")
    if not pairs.isEmpty():
        links = stored(links.unionByName(_verified(pairs, rows, n, pct)), "links")
        roots = components(links)

    of_class = classes.select("key", "rep").join(roots, classes["rep"] == roots["node"], "left").select("key", "rep", F.coalesce("root", "rep").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_verified"))
    of_class = of_class.join(degree, "rep", "left").select("key", "component_id", "n_verified")
    return (
        sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
        .join(of_class, "key", "left")
        .select("doc_id", "n_shingles", F.coalesce("n_verified", F.lit(0)).alias("n_verified"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _class_links(rows: DataFrame, n: int, pct: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row with an id and words, and the links (a, b; a < b) between all classes, by their keys.

    Every candidate pair is verified, once.  A list's parts are joined two by two, so no task has a long list whole.
    """
    linked = stored(_prefixes(rows, n, pct), "prefixes").where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(linked.groupBy("key").agg(F.first(F.struct(F.col("n_shingles").alias("n"), "signature", "tokens", "splits")).alias("c")).select("key", "c.*"), "classes")
    entries = classes.select("key", "n", F.posexplode(F.arrays_zip("tokens", "splits")).alias("pos", "x")).select("key", "n", "pos", F.col("x.tokens").alias("token"), F.col("x.splits").alias("splits"))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("key"), "splits").cast("int"))
    a, b = (entries.select("token", F.col("part").alias(at), F.explode(others).alias(other), F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("pos").alias(f"pos_{x}")) for x, at, other, others in (("a", "p", "q", F.expr("sequence(part, splits - 1)")), ("b", "q", "p", F.expr("sequence(0, part)"))))
    alpha = F.ceil(pct * (F.col("n_a") + F.col("n_b")) / (100 + pct))
    fits = (pct * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")) & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= alpha)
    pairs = a.join(b, ["token", "p", "q"]).where(((F.col("p") < F.col("q")) | (F.col("a") < F.col("b"))) & fits)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(_suffix_filtered(pairs, classes.withColumnRenamed("key", "rep"), pct), "pairs")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches):
            keys = [xxhash.xxh3_128_digest(shingle_set(t, n, hashes).tobytes()) for t in b["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b["text"]], ["key", "text"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = stored(rows.where("doc_id IS NOT NULL").select("text").mapInArrow(keyed, "key binary, text string").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "texts")
    a, b = (texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return linked.select("doc_id", "key"), stored(_compared(pairs.join(a, "a").join(b, "b"), n, pct, "binary"), "links")


def ngram_links(docs: DataFrame, n: int = 5, min_similarity_pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a and b (a < b) of every two ids that link as in ngram_groups, once, those with equal sets too.

    The result is as long as there are links: m(m - 1)/2 for m similar documents; link_counts only counts.
    """
    members, links = _class_links(id_text(docs, id_col, text_col), n, min_similarity_pct)
    members = members.distinct()
    x, y = (members.select(F.col("doc_id").alias(f"id_{k}"), F.col("key").alias(k)) for k in "ab")
    same = x.join(y, F.col("a") == F.col("b"))
    both = links.join(x, "a").join(y, "b").select("id_a", "id_b").unionByName(same.select("id_a", "id_b"))
    return both.where("id_a != id_b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def link_counts(docs: DataFrame, n: int = 5, min_similarity_pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_links of every row with an id and words: how many other such rows it links with, copies included."""
    members, links = _class_links(id_text(docs, id_col, text_col), n, min_similarity_pct)
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    ends = links.select(F.col("a").alias("of"), F.col("b").alias("key")).unionByName(links.select(F.col("b").alias("of"), F.col("a").alias("key")))
    others = ends.join(sizes, "key").groupBy(F.col("of").alias("key")).agg(F.sum("size").alias("others"))
    counts = sizes.join(others, "key", "left").select("key", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(counts, "key").select("doc_id", "n_links")


def _suffix_filtered(pairs: DataFrame, classes: DataFrame, pct: int) -> DataFrame:
    """Without pairs whose shingles, counted by their leading bits, cannot overlap enough."""
    a, b = (classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in "ab")
    most = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    return pairs.join(a, "a").join(b, "b").where(_similar_enough(F.col("n_a"), F.col("n_b"), most, pct)).select("a", "b").distinct()


def keep_first_of_group(docs: DataFrame, n: int = 5, min_similarity_pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the documents that are not the first (smallest id) of their group.

    Rows without an id stay, as do empty texts; repeated rows of an id stay or go together; an empty table stays empty.
    Columns of any name, ``_gone`` too, are kept as they are.
    """
    groups = ngram_groups(docs, n, min_similarity_pct, id_col, text_col)
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by three-word shingles at 90 %; see ``ngram_groups``."""
    return ngram_groups(table(spark, sf_dir, "documents"), n=3, min_similarity_pct=90).drop("n_verified")


SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT r, doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE ws[g:g+2] END AS sh
  FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS u(g) WHERE len(ws) > 0),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
i AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.r < y.r GROUP BY x.r, y.r),
l AS (SELECT p.doc_id AS a, q.doc_id AS b FROM i JOIN n p ON i.a = p.r JOIN n q ON i.b = q.r WHERE 190 * c >= 90 * (p.n + q.n) AND p.doc_id <> q.doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(x, y) AS (SELECT DISTINCT doc_id, doc_id FROM w WHERE doc_id IS NOT NULL UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
comp AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.m, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (r) LEFT JOIN comp ON comp.x = w.doc_id
"""
