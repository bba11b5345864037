import random

from ledgerloom.llm import license, quality, url_filter


def repeats(text, least):
    w = text.encode().split()
    n, best = len(w), [0] * len(w)
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    best = [b if b >= least else 0 for b in best]
    return len({x for i, b in enumerate(best) for x in range(i, i + b)}), max(best, default=0)


def test_suffix_array_repeats(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 70))) for _ in range(150)] + [None, "", "é é", "a " * 90, "x y z w " * 30]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(0, texts[0], False)], "doc_id bigint, text string, kept boolean")
    got = quality.quality_rules(docs, min_repeat=4).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.n_covered, r.longest_repeat) == repeats(t, 4)
        w = t.encode().split()
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert r.n_repeat_words == len({x for k, g in enumerate(three) if three.count(g) > 1 for x in range(k, k + 3)})
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))


def test_only_the_suffix_array_rejects(spark):
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    long_repeat = words("p", 101) + words("x", 400) + words("p", 101)  # one repeat over the limit of 100 words
    at_the_limit = words("p", 100) + words("x", 400) + words("p", 100)
    pieces = [words(f"b{k}_", 20) for k in range(10)]
    apart = lambda k, side: pieces[k] + words(f"{side}{k}_", 22)
    covered = sum((apart(k, "y") for k in range(10)), []) + sum((apart(k, "z") for k in reversed(range(10))), [])  # 400 of 840 words
    clean = words("c", 500)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((long_repeat, at_the_limit, covered, clean))], "doc_id bigint, text string")
    rows = sorted(quality.quality_rules(docs).collect())
    assert not any(r.base_failed for r in rows)
    assert [r.kept for r in rows] == [False, True, False, True]
    assert (rows[0].longest_repeat, rows[1].longest_repeat, rows[2].n_covered, rows[3].n_covered) == (101, 100, 400, 0)
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [1, 3]


def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    wrong = [r.doc_id for r in quality.quality_rules(docs).where("NOT base_failed").join(labels.where("quality = 1"), "doc_id").collect() if r.doc_id not in kept]
    assert not wrong
    assert quality.keep_good(docs.limit(0)).collect() == []


def test_url_rules(spark):
    rules = [*url_filter.QUERY_RULES, ("allow", "com", "/"), ("block", "a.b.example.com", "/x/y")]
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/7?x=/en/8", "http://x.example.com/en/70/z", "http://example.com/en/8#t", "http://notexample.com/en/", "ftp://a.b.example.com/x/yz", "http://a.b.example.com/x", "http://net", "http://m.example.net/de/8", "http://x.net/de/8", "http://é.ORG/es/", "x://com/en/y://z"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")

    def brute(u):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = next((rest[:k] for k, c in enumerate(rest) if c in "/?#"), rest)
        tail = rest[len(host) :]
        path = next((tail[:k] for k, c in enumerate(tail) if c in "?#"), tail)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), len(h), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    for limit in (100, 2):  # a broadcast trie, and joins
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, max_broadcast_rules=limit).collect()}
        assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


def test_license_units(spark):
    mit = next(t for n, t in license.TEMPLATES if len(t) > 200 and n == "MIT")
    texts = ["words before\nReleased under the MIT License.\nwords after", mit.upper().replace(" ", "\n"), "some text\n\n" + mit[:150] + "\n" + mit[150:] + "\n\nmore text", "nothing to see", None, "", "License", "x\nAll rights reserved.\nAll rights reserved."]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(3, texts[3], 0.5)], "doc_id bigint, text string, dice double")
    got = sorted((r.doc_id, r.unit, r.unit_no, r.license) for r in license.scan_licenses(docs).collect())
    assert got == [(0, "line", 1, "MIT"), (1, "text", 0, "MIT"), (2, "paragraph", 1, "MIT"), (2, "text", 0, "MIT"), (7, "line", 1, "Proprietary"), (7, "line", 2, "Proprietary")]
    assert license.scan_licenses(docs.limit(0)).collect() == []
