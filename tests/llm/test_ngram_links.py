import random

import pytest

from ledgerloom.llm import ngram_join

WORDS = [f"w{i}" for i in range(60)]


def sets(texts, n):
    for t in texts:
        w = (t or "").lower().split()
        yield {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def group(seed, size):
    """One text with one word replaced in each, and copies: all are similar to all."""
    rng, out = random.Random(seed), []
    for _ in range(size):
        w = list(WORDS)
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return [*out, *out[:3], *[" ".join(WORDS[5:])] * 4]


@pytest.mark.parametrize(("n", "pct", "part"), [(3, 80, 20_000), (3, 80, 3), (2, 90, 5), (5, 80, 2)])
def test_all_links_and_their_counts(spark, monkeypatch, n, pct, part):
    monkeypatch.setattr(ngram_join, "LIST", part)
    texts = group(n * pct, 14) + ["other words here are these ones", "one", "One", "", None, " ".join(WORDS[:30])]
    ids = [*range(len(texts) - 1), 2]  # an id with two texts
    rows = [*zip(ids, texts, strict=True), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    s = [(i, x) for (i, _), x in zip(rows, sets([t for _, t in rows], n), strict=True) if i is not None and x]
    near = [[j for j, (_, y) in enumerate(s) if j != k and 100 * len(x & y) >= pct * len(x | y)] for k, (_, x) in enumerate(s)]
    want = {tuple(sorted((s[k][0], s[j][0]))) for k, js in enumerate(near) for j in js if s[k][0] != s[j][0]}
    got = list(map(tuple, ngram_join.ngram_links(docs, n, pct).collect()))
    assert sorted(got) == sorted(want)
    assert sorted(map(tuple, ngram_join.link_counts(docs, n, pct).collect())) == sorted((s[k][0], len(js)) for k, js in enumerate(near))
