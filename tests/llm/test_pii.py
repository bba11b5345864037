import hashlib
import random
import re

from ledgerloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    text, out = text or "", []
    for place, (form, good) in enumerate([
        (EMAIL, lambda h: True),
        (IP, lambda h: all(int(x) <= 255 for x in h.split("."))),
        (CARD, lambda h: 14 <= len(re.sub("[^0-9]", "", h)) <= 19 and luhn(re.sub("[^0-9]", "", h))),
        (PHONE, lambda h: 10 <= len(re.sub("[^0-9]", "", h)) <= 15),
    ]):
        out += [(m.start(), place, m.end()) for m in form.finditer(text) if good(m[0])]
    return ",".join(f"{pii.KINDS[p]}:{s}:{e}" for s, p, e in sorted(out))


CASES = [
    None, "", "a@b.c_d@e.f", "x.y+z@sub.example.com.", "a@b a@.b a@b..c é@é.com 🙂me@x.io.", "@b.c a@b.c@d.e@f.g", "1.2.3.4.5 256.1.1.1 001.02.3.255 1.2..3.4.5.6",
    "4539 1488 0343 6467 and 4539-1488-0343-6467 4539148803436467", "4539148803436467 4539148803436467", "4539  1488 0343 6467", "+1 (017) 555-7713 2390409500648960", "+1 (017) 555-7713.",
    "+12 +1234567890 ++44 20 7946 0958-", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "1-2" * 9000, "a." * 9000 + "b@c" + ".d" * 9000, "4" * 30, "a@b.c 45391488", "0" * 40 + ".1.1.1",
]


def test_rules_against_brute_force(spark):
    rng = random.Random(5)
    texts = CASES + ["".join(rng.choice("0123456789" * 2 + " -.+@ab()_é") for _ in range(rng.randint(0, 300))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r for r in pii.span_digest(pii.find_personal_data(docs, min_support=10**6), ["email", "ip", "card", "phone"]).collect()}
    for i, t in enumerate(texts):
        assert got[i].spans == brute(t), t
        assert got[i].base_sha256 == hashlib.sha256(brute(t).encode()).hexdigest()
        assert got[i].n_phone == brute(t).count("phone")


def test_patterns_find_what_no_rule_knows(spark):
    seeds = [(i, f"please write to customer number 10.0.0.{i} about it") for i in range(40)]
    more = [(50, "please write to customer number CUST-99812 about it"), (51, "the flight AB-99812x left early"), (None, None), (50, "please write to customer number CUST-99812 about it")]
    docs = spark.createDataFrame(seeds + more, "doc_id bigint, text string")
    got = [(r.doc_id, [(x.kind, x.start, x.end) for x in r.spans]) for r in pii.find_personal_data(docs).collect()]
    assert sorted(x for x in got if x[0] in (50, 51)) == [(50, [("found", 32, 42)])] * 2 + [(51, [])]
    assert len(got) == 44
    assert all(s == [("ip", 32, 40 + (i > 9))] for i, s in got if i is not None and i < 40)


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.spans for r in pii.op9_pii(spark, "/root/testdata/sf0.01").collect()}
    for r in docs.collect():
        assert [x for x in got[r.doc_id].split(",") if not x.startswith("found")] == brute(r.text).split(",")


def test_text_of_many_hits(spark):
    text = " ".join(f"10.0.{i % 250}.{i // 250 % 250} a{i}@b.c {i}xx" for i in range(50_000))
    got = pii.op9_pii_of(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (got.n_ip, got.n_email, got.base_sha256) == (50_000, 50_000, hashlib.sha256(brute(text).encode()).hexdigest())


def graph_by_loops(texts, rounds, support, least):
    """The strings that patterns tell of, by dictionaries."""
    token = re.compile(r"(?<![A-Za-z0-9@._+-])[A-Za-z@._+-]*[0-9][A-Za-z0-9@._+-]*")
    seen = []
    for i, text in enumerate(texts):
        spans = [tuple(map(int, x.split(":")[1:])) for x in brute(text).split(",") if x]
        hits = [m for m in token.finditer(text)]
        for j, m in enumerate(hits):
            if len(m[0]) < 6:
                continue
            clean = lambda x: re.sub(r"[^\w=:]+|_", " ", x.lower()).strip().split(" ")
            before = clean(text[hits[j - 1].end() if j else 0 : m.start()][-80:])
            after = clean(text[m.end() : hits[j + 1].start() if j + 1 < len(hits) else len(text)][:80])
            pats = {"L " + " ".join(before[-2:]), "R " + " ".join(after[:2]), f"B {before[-1]} _ {after[0]}"}
            seen.append((i, m.start(), m.end(), m[0].lower(), any(s < m.end() and e > m.start() for s, e in spans), pats))
    known = {(p, v): max(k2 for _, _, _, v2, k2, ps in seen if v2 == v and p in ps) for _, _, _, v, _, pats in seen for p in pats}
    score = {}
    for _, _, _, v, k, _ in seen:
        score[v] = max(score.get(v, 0.0), float(k))
    for _ in range(rounds):
        weight = {}
        for p in {p for p, _ in known}:
            of = [score[v] for q, v in known if q == p]
            if sum(x >= least for x in of) >= support and sum(of) / (len(of) + 1) >= least:
                weight[p] = sum(of) / (len(of) + 1)
        told = {}
        for (p, v), k in known.items():
            if not k and p in weight:
                told[v] = max(told.get(v, 0.0), weight[p])
        score = {v: max(x, told.get(v, 0.0)) for v, x in score.items()}
    return {(i, s, e) for i, s, e, v, k, _ in seen if not k and score[v] >= least}


def test_graph_against_loops(spark):
    rng = random.Random(3)
    frames = ["write to {} today", "account {} is open", "call {} or wait", "the part {} was sold", "room {} is free"]
    texts = []
    for i in range(220):
        new = [f"10.{rng.randrange(200)}.0.{rng.randrange(200)}", f"u{i}@mail.org", f"CU-{rng.randrange(10**6):06d}", f"K{rng.randrange(40):05d}x"]
        texts.append(" and ".join(rng.choice(frames[:3] if (x := rng.choices(new, [6, 6, 1, 1])[0]) and rng.random() < 0.8 else frames[3:]).format(x) for _ in range(rng.randint(1, 3))))
    for support, least in ((3, 0.8), (2, 0.6)):
        want = graph_by_loops(texts, 2, support, least)
        got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), min_support=support, min_score=least).collect()
        assert {(r.doc_id, x.start, x.end) for r in got for x in r.spans if x.kind == "found"} == want
    assert want


def test_recall_and_precision_of_found_identifiers(spark):
    """Customer numbers, which no rule knows, in the places where e-mail addresses stand; part numbers elsewhere."""
    rng = random.Random(9)
    places = ["you can reach me at {} any time", "my contact is {} as before", "send it to {} please"]
    docs, planted = [], set()
    for i in range(600):
        frame = rng.choice(places)
        if i % 4 == 0:
            planted.add(i)
            docs.append((i, frame.format(f"CUST-{rng.randrange(10**7):07d}")))
        elif i % 4 == 1:
            docs.append((i, f"the bolt of type {rng.choice('ABC')}{rng.randrange(10**6):06d} fits this frame"))
        else:
            docs.append((i, frame.format(f"user{rng.randrange(10**6)}@example.org")))
    found = {r.doc_id for r in pii.find_personal_data(spark.createDataFrame(docs, "doc_id bigint, text string"), min_score=0.6).collect() if any(x.kind == "found" for x in r.spans)}
    assert len(found & planted) >= 0.9 * len(planted)
    assert len(found & planted) >= 0.95 * len(found)
