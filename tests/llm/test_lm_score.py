import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import lm_score


def words(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def brute(rows, depth, min_count, min_gain):
    """Unigram base and suffix tree by dictionaries."""
    train = [words(t) for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 10]
    c = Counter(w for x in train for w in [*x, "\n"])
    n, v = sum(c.values()), len(c)
    spell = lambda x: (" ".join(x) + "\n").encode()
    after = {}
    for x in train:
        s = b"\n" * depth + spell(x)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                after.setdefault(s[i - d : i], Counter())[s[i]] += 1
    total = sum(after.get(b"", {}).values())
    memo = {}

    def p(context, a):
        if (context, a) not in memo:
            if not context:
                memo[context, a] = (after.get(b"", {}).get(a, 0) + 1) / (total + 256)
            else:
                seen, shorter = after.get(context, {}), p(context[1:], a)
                size, kinds = sum(seen.values()), len(seen)
                gain = sum(k * math.log(k / size / p(context[1:], b)) for b, k in seen.items())
                keep = size > 0 if len(context) == 1 else size >= min_count and gain >= min_gain
                memo[context, a] = (seen.get(a, 0) + kinds * shorter) / (size + kinds) if keep else shorter
        return memo[context, a]

    out = []
    for i, t in rows:
        x = words(t)
        tokens = [*x, "\n"]
        s = b"\n" * depth + spell(x)
        out.append((i, not zlib.crc32(str(i).encode() if i is not None else b"") % 10, len(tokens), sum(c[w] > 0 for w in tokens), n,
                    sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens),
                    sum(math.log10(p(s[j - depth : j], s[j])) for j in range(depth, len(s)))))
    return out


@pytest.mark.parametrize("depth", [3, 6])
def test_against_brute_force(spark, depth):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text[:1500]) for r in docs.collect()] + [(None, "The null one"), (999, None), (1000, ""), (3, "again"), (3, "again"), (1001, "\tA\x0bB  é\x1cé \n")]
    got = lm_score.score_documents(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, score double"), depth=depth, chunk_chars=20_000).collect()
    want = brute(rows, depth, 4, 6.0)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=str), sorted(want, key=str), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-5)


def test_better_than_base_on_held_out(spark):
    got = lm_score.op6_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b


def test_empty_table(spark):
    assert lm_score.score_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def chunks_of(spark, rows, depth, size):
    """The chunks of (doc_id, text, held_out), and the rows' spelling with what precedes it."""
    packed = lm_score._chunks(spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean").coalesce(1), depth, size).toArrow()
    return [lm_score.Chunk(packed, i, depth) for i in range(packed.num_rows)]


def test_a_word_is_hashed_once_for_each_of_its_two_separators(spark, monkeypatch):
    """More words than a bounded memory holds, again and again: each used to be hashed as often as it occurs."""
    words = [f"word{i}" for i in range(150_000)]
    (chunk,) = chunks_of(spark, [(i, " ".join(words), False) for i in range(3)], 6, lm_score.CHUNK_CHARS)
    calls, real = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: calls.append(w) or real(w))
    for _ in chunk.words():
        pass
    assert len(calls) <= 2 * len(words)


@pytest.mark.parametrize("depth", [2, 6])
@pytest.mark.parametrize("size", [40, 10_000])
def test_counts_of_a_chunk(spark, monkeypatch, depth, size):
    """Sorted in many runs, texts in many pieces: all keys are there, also those of held-out texts only, with their counts."""
    monkeypatch.setattr(lm_score, "_RUN", 500)
    monkeypatch.setattr(lm_score, "_SLICE", 300)
    texts = ["", " \t ", "One", "one\x0bone", "x" * 700, *(" ".join(f"{(i * j) % 17}é{j % 5}" for j in range(60)) for i in range(40))]
    rows = [(i, t, i % 3 == 1) for i, t in enumerate(texts)]
    want = {"words": Counter(), "grams": Counter()}
    for _, t, held in rows:
        s = b"\n" * depth + (" ".join(words(t)) + "\n").encode()
        for w in [*(x.encode() for x in words(t)), b"\n"]:
            want["words"][xxhash.xxh3_64_intdigest(w)] += not held
        for i in range(depth, len(s)):
            want["grams"][int.from_bytes(s[i - depth : i][::-1] + s[i : i + 1], "big")] += not held
    got = {"words": Counter(), "grams": Counter()}
    for chunk in chunks_of(spark, rows, depth, size):
        for kind, (keys, counts) in (("words", chunk.distinct_words()), ("grams", chunk.distinct_grams())):
            assert (keys[1:] > keys[:-1]).all()
            for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
                got[kind][k] += c
    end = xxhash.xxh3_64_intdigest(b"\n")
    assert got["words"].keys() | {end} == want["words"].keys() and got["grams"].keys() == want["grams"].keys()
    assert got == want


def test_table_of_like_keys(monkeypatch):
    """Keys that differ in few bits, as those of numbers do: every one is found, most at once; filled in slices."""
    monkeypatch.setattr(lm_score, "_SLICE", 30_000)
    digits = np.arange(10, dtype=np.uint64) + np.uint64(48)
    keys = np.zeros(1, np.uint64)
    for _ in range(5):
        keys = (keys[:, None] << np.uint64(8) | digits).ravel()
    keys = np.concatenate([keys << np.uint64(s) for s in (0, 16)])
    keys = np.unique(keys)
    table = lm_score.Table(keys, np.arange(len(keys)))
    again = np.random.default_rng(1).integers(0, len(keys), 300_000)
    assert (table.get(keys[again]) == again).all()
    at = table._place(keys)
    assert (table.keys[at] == keys).mean() > 0.5
