import random

import pytest

from ledgerloom.llm import substring


def brute(rows, window):
    texts = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, i), i)
    out = []
    for (raw, _), (i, w) in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((str(raw), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize(("window", "mark", "group", "block"), [(13, 6, 250_000, 150_000), (13, 6, 3, 150_000), (13, 6, 3, 10), (13, 6, 250_000, 10), (7, 4, 40, 25), (5, 5, 250_000, 150_000)])
def test_against_brute_force(spark, monkeypatch, window, mark, group, block):
    monkeypatch.setattr(substring, "GROUP_SUFFIXES", group)
    monkeypatch.setattr(substring, "BLOCK_SUFFIXES", block)
    rng = random.Random(window)
    pool = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    rows = []
    for i in rng.sample(range(1000), 80):
        parts = [rng.choice(pool) if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(9)] for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p)))
    rows += [(2000, None), (2001, ""), (None, rows[0][1]), (None, rows[1][1]), rows[2], (rows[3][0], rows[4][1]), (3000, rows[5][1]), (-4, rows[6][1]), (2002, "x " * 40), (2003, "x " * 30), (2004, "é\x1cü " * 20), (2005, "é\x1cü " * 20)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, uid bigint")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring.drop_repeats(docs, window, mark).collect())
    assert got == brute(rows, window)


def test_passage_that_all_share(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(300)]
    got = {r.doc_id: r for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()}
    assert got[0].n_removed == 0
    assert all(got[i].n_removed == 55 and got[i].kept_text == f"own{i} end{i}" for i in range(1, 300))


def test_empty_table(spark):
    assert substring.drop_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_nodes_are_those_of_a_tree():
    import numpy as np

    edges = np.array([[1, 2], [1, 3], [1, 2], [2, 2], [1, 2]], np.uint64)
    nodes = substring._nodes(np.array([7, 7, 7, 7, 8], np.uint64), edges)
    same = [{tuple(np.flatnonzero(row == x)) for x in row} for row in nodes]
    assert same == [{(0, 1, 2, 3), (4,)}, {(0, 1, 2), (3,), (4,)}, {(0, 2), (1,), (3,), (4,)}]


def test_very_long_repetitive_text(spark):
    rows = [(1, "a b " * 60_000), (2, "c " + "a b " * 60_000), (3, "x " * 200_000), (4, "y " + "x " * 20)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[2] == (120_001, 120_000, "c")
    assert got[3][1] == 0
    assert got[4] == (21, 20, "y")
