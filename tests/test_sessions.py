"""A session's course against a loop over the events in time, and the live writer over several micro-batches."""

import random

from ledgerloom.operators import sessions
from ledgerloom.streaming import jobs


def course(headers, persisted, seconds):
    """Goes through the headers in time, with one tenure a block."""
    out, terms = [], {}
    for at, session, block, proof_at in sorted(headers, key=lambda x: x[:3]):
        latest = max((b for b, t in persisted if t < at), default=-1)
        if block <= latest:
            out.append((session, block, at, "DUPLICATE", "DUPLICATE_BLOCK"))
            continue
        held = terms.get(block)
        if held is None or held[2] is not None and at >= held[2]:
            proofs = [p for a, s, b, p in headers if (s, b) == (session, block) and a >= at and p is not None and max((x for x, t in persisted if t < a), default=-1) < block]
            proof = min(proofs, default=None)
            ack = None if proof is None else min((t for b, t in persisted if b == block and proof < t <= proof + seconds), default=None)
            held = terms[block] = (session, proof, None if proof is None or ack is not None else proof + seconds, ack)
        winner, proof, _, ack = held
        if session != winner:
            out.append((session, block, at, "BEHIND", "SKIP_BLOCK"))
        else:
            out.append((session, block, at, "PRIMARY", None if proof_at is None or proof_at != proof else "ACK" if ack is not None else "END_STREAM"))
    return out


def test_course_against_a_loop(spark):
    rng = random.Random(8)
    headers = []
    for _ in range(150):
        at = rng.randrange(200)
        headers.append((at, rng.randrange(6), at // 12 + rng.randrange(3), at + rng.randrange(1, 4) if rng.random() < 0.8 else None))
    persisted = [(b, p + rng.randrange(1, 9)) for _, _, b, p in headers if p is not None and rng.random() < 0.15]
    headers += headers[:3]
    h = spark.createDataFrame([*headers, (None, 1, 2, 3), (5, None, 2, 3)], "tick bigint, session bigint, block_number bigint, proof_at bigint")
    p = spark.createDataFrame(persisted, "block_number bigint, tick bigint")
    got, terms = sessions.session_course(h, p, 3)
    key = lambda r: tuple(str(x) for x in r)
    want = course(headers, persisted, 3)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert {r[3] for r in want} == {"DUPLICATE", "PRIMARY", "BEHIND"} and {"ACK", "END_STREAM"} <= {r[4] for r in want}
    assert terms.groupBy("block_number").count().agg({"count": "max"}).first()[0] > 1
    none = sessions.session_course(h.limit(0), p, 3)
    assert none[0].collect() == [] and none[1].collect() == []


def test_resend_goes_to_the_others(spark):
    terms = spark.createDataFrame([(1, 10, 8, 0), (2, 11, None, 0)], "block_number bigint, winner bigint, release bigint, group bigint")
    members = spark.createDataFrame([(10, 0), (11, 0), (12, 0), (13, 1)], "session bigint, group bigint")
    assert sorted(tuple(r) for r in sessions.resend_to_others(terms, members).collect()) == [(1, 11), (1, 12)]


def test_live_writer_over_micro_batches(spark, tmp_path):
    parts = [[(3,), (4,), (9,)], [(0,), (1,), (4,)], [(2,), (12,), (6,)], [(5,), (7,), (8,), (20,)]]
    for part in parts:
        spark.createDataFrame(part, "block_number bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("block_number bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert jobs.written_state(spark, f"{tmp_path}/out").collect() == []
    jobs.live_writer(live, f"{tmp_path}/out")
    states = [(tuple(spark.read.parquet(f"{tmp_path}/out/marks/{n}").first()), sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/gaps/{n}").collect()))) for n in range(4)]
    seen = set()
    for part, ((earliest, latest, contiguous), gaps) in zip(parts, states, strict=True):
        seen |= {n for (n,) in part}
        holes = [n for n in range(max(seen)) if n not in seen]
        assert (earliest, latest, contiguous) == (min(seen), max(seen), holes[0] - 1 if holes else max(seen))
        assert [n for s, e in gaps for n in range(s, e + 1)] == holes
    assert tuple(jobs.written_state(spark, f"{tmp_path}/out").first()) == (0, 20, 9, 2, 9)
