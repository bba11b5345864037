import random

import numpy as np

from ledgerloom.llm import decontaminate as d

SF = "/root/testdata/sf0.01"


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        hit = d.common_subsequence(a, b)
        assert hit.sum() == longest(a, b)
        chosen, at = [x for x, h in zip(a, hit, strict=True) if h], 0
        for y in b:
            at += at < len(chosen) and chosen[at] == y
        assert at == len(chosen)


def test_planted_passages_and_paraphrases(spark):
    """120 passages of 40 items, with up to a fifth of the words replaced: recall 0.95 or more; exact ones are all found."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rng, texts, items = random.Random(1), {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()}
    vocabulary = [w for t in list(texts.values())[:200] for w in t.split()]
    rows, truth, mild = [], set(), set()
    for k in range(120):
        item = rng.choice(sorted(items))
        rate = rng.choice([0, 0.1, 0.2])
        words = [rng.choice(vocabulary) if rng.random() < rate else w for w in items[item].split()]
        host = texts[rng.choice(sorted(texts))].split()
        at = rng.randint(0, len(host))
        rows.append((10_000 + k, " ".join(host[:at] + words + host[at:]), "s"))
        truth.add((10_000 + k, item))
    planted = spark.createDataFrame([*rows, (20_000, None, ""), (20_001, "", ""), (20_002, "... ---", ""), rows[0]], "doc_id bigint, text string, item_id string")
    both = docs.select("doc_id", "text").unionByName(planted.select("doc_id", "text"))
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(both, bench).collect()}
    assert len(got & truth) >= 0.95 * len(truth)
    # brute force: items whose words occur in a row somewhere in a document
    spaced = {i: " ".join(t.split()) for i, t in items.items()}
    exact = {(i, j) for i, t in texts.items() for j, x in spaced.items() if x in " ".join(t.split())}
    assert exact <= got
    clean = {i for i, _ in got if i < 10_000} - {i for i, _ in exact}
    for i in clean:  # anything else must share most of an item's words in order
        j = next(y for x, y in got if x == i)
        assert longest(items[j].lower().split(), texts[i].lower().split()) >= 0.5 * len(items[j].split())
    assert len(clean) <= 0.01 * len(texts)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.find_leaks(docs, none).collect() == []
    bench = spark.createDataFrame([(7, "alpha beta gamma delta epsilon", "zeta eta"), (8, None, None)], "item_id bigint, text string, reply string")
    texts = spark.createDataFrame([(1, "so alpha beta gamma delta epsilon it is"), (2, "alpha beta gamma delta epsilon and zeta eta"), (3, "nothing of that")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in d.find_leaks(texts, bench).collect()) == [1, 2]
    assert [r.doc_id for r in d.find_leaks(texts, bench, answer_col="reply").collect()] == [2]
    assert [r.doc_id for r in d.drop_leaks(texts, bench).collect()] == [3]
    assert d.find_leaks(texts.limit(0), bench).collect() == []


def changed(words, how, rate, rng, vocabulary):
    out = list(words)
    for _ in range(round(rate * len(words))):
        at = rng.randrange(len(out))
        if how == "inserted":
            out.insert(at, rng.choice(vocabulary))
        elif how == "reordered":  # a word moves by up to five places
            out.insert(max(0, min(len(out), at + rng.randint(-5, 5))), out.pop(at))
    if how == "replaced":
        for at in rng.sample(range(len(out)), round(rate * len(words))):
            out[at] = rng.choice(vocabulary)
    return out


def test_recall_where_the_space_is_truncated(spark):
    """300 items, far over the rank of 64; the checks on the words, over all planted pairs, say what there is to find."""
    rng = random.Random(6)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.text}
    vocabulary = sorted({w for t in texts.values() for w in t.split()})
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(20, 50))] for i in range(300)}
    rows, truth = [], {}
    for how, rate in [("replaced", 0.0), ("replaced", 0.3), ("replaced", 0.4), ("replaced", 0.5), ("inserted", 0.3), ("reordered", 0.3)]:
        for item in rng.sample(sorted(items), 60):
            host, told = texts[rng.choice(sorted(texts))].split()[:300], changed(items[item], how, rate, rng, vocabulary)
            at, i = rng.randint(0, len(host)), 10_000 + len(rows)
            rows.append((i, " ".join(host[:at] + told + host[at:])))
            words = items[item]
            there = longest(words, told) >= 0.5 * len(words) and longest(words[-(len(words) // 3) :], told) >= 0.5 * (len(words) // 3)
            truth.setdefault((how, rate), []).append((i, item, there))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    docs = spark.createDataFrame([*texts.items(), *rows], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()}
    recall = {k: (np.mean([(i, j) in got for i, j, _ in v]).round(2), np.mean([(i, j) in got for i, j, there in v if there]).round(2) if any(t for _, _, t in v) else 1.0) for k, v in truth.items()}
    print("planted, and of those the checks would pass:", recall)
    assert recall["replaced", 0.0][0] == 1
    assert recall["replaced", 0.3][0] >= 0.9 and recall["inserted", 0.3][0] >= 0.9 and recall["reordered", 0.3][0] >= 0.9
    assert recall["replaced", 0.4][1] >= 0.8
    assert not {x for x in got if x[0] < 10_000}


def test_checks_are_on_words(spark):
    """Words of one vocabulary number are not taken for each other."""
    by, terms = {}, d.Terms()
    for k in range(50_000):
        by.setdefault(terms[f"w{k}".encode()], []).append(f"w{k}")
    pairs = [x[:2] for x in by.values() if len(x) > 1][:30]
    bench = spark.createDataFrame([(1, " ".join(a for a, _ in pairs))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(b for _, b in pairs)), (2, " ".join(a for a, _ in pairs))], "doc_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()] == [(2, 1)]


def test_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 0.5)], "item_id bigint, text string, cosine double")
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 7), (2, "other words", 8), (None, "one two three four five six seven eight nine ten", 9)], "doc_id bigint, text string, _gone int")
    assert sorted(r._gone for r in d.drop_leaks(docs, bench).collect()) == [8, 9]
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs.withColumnRenamed("_gone", "item_id"), bench).collect()} == {(1, 1), (None, 1)}
