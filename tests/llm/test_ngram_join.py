import random

import pytest

from ledgerloom.llm import ngram_join


def words(text):
    return (text or "").encode().lower().split()


def brute(rows, n, pct):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= pct * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((str(i), len(s), str(i if i is None else find(i))) for i, s in sets))


def near_copies(rng, n_groups, size, edits, vocabulary):
    out = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "pct", "part"), [(3, 90, 20_000), (5, 80, 20_000), (2, 50, 5), (3, 100, 3)])
def test_against_brute_force(spark, monkeypatch, n, pct, part):
    monkeypatch.setattr(ngram_join, "LIST", part)
    rng = random.Random(n * 100 + pct)
    texts = near_copies(rng, 12, 14, 6, [f"w{i}" for i in range(400)]) + near_copies(rng, 4, 8, 2, ["a", "b", "c"])
    rows = list(enumerate(texts)) + [(5000, None), (5001, ""), (5002, " \t"), (5003, "One"), (5004, "one"), (5005, "one two"), (None, texts[0]), (3, texts[3]), (3, texts[40]), (-7, texts[20])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, key string, n bigint")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_groups(docs, n, pct).collect())
    assert got == brute(rows, n, pct)


def test_hot_group_of_copies_and_chain(spark):
    base = [f"w{i}" for i in range(60)]
    chain = []
    for k in range(12):  # each is close to the next only
        chain.append(" ".join(base))
        base[5 * k] = f"x{k}"
    rows = [(i, t) for i, t in enumerate(chain)] + [(100 + i, "the very same text many times over") for i in range(200)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert {got[i] for i in range(12)} == {0}
    assert {got[100 + i] for i in range(200)} == {100}


def test_keep_first(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g", "s"), (1, "A b c d e f g", "t"), (3, "other words here are these ones", "u"), (None, "a b c d e f g", "v")], "doc_id bigint, text string, rep string")
    assert sorted((str(r.doc_id), r.rep) for r in ngram_join.keep_first_of_group(docs).collect()) == [("1", "t"), ("3", "u"), ("None", "v")]


def test_empty_table(spark):
    assert ngram_join.ngram_groups(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_one_long_list_over_many_components(spark, monkeypatch):
    """A passage that all texts share, dealt in parts, over many pairs of near copies and single texts."""
    monkeypatch.setattr(ngram_join, "LIST", 25)
    passage = " ".join(f"p{i}" for i in range(40))
    rows, want = [], {}
    for g in range(60):
        own = " ".join(f"g{g}w{i}" for i in range(60 if g % 3 else 2))
        for k in range(1 + g % 2):
            rows.append((g * 10 + k, f"{own} {passage}" + (f" end{g}" if k else "")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_groups(docs, n=3, min_similarity_pct=80).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in sets}
    assert got == want and len(set(want.values())) > 20
