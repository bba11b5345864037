import base64
import json
import random

import pytest

from ledgerloom.llm import secrets


def pem(seed, size=1190):
    body = base64.b64encode(random.Random(seed).randbytes(size)).decode()
    return [body[k : k + 64] for k in range(0, len(body), 64)]


def armoured(lines):
    return "\n".join(["-----BEGIN RSA PRIVATE KEY-----", *lines, "-----END RSA PRIVATE KEY-----"])


def redacted(spark, text):
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id bigint, text string, n_chars bigint")
    (r,) = secrets.redact_secrets(docs).collect()
    assert r.n_chars == len(r.text)
    return r.text


def test_every_line_of_a_private_key(spark):
    for seed in range(4):
        for size in (1190, 1158):  # a last line of 52 and of 8 characters
            lines = pem(seed, size)
            got = redacted(spark, f"the key of the server is\n{armoured(lines)}\nand this is the text after it, of the harbour and the ships")
            assert [x for x in lines if x in got] == []
            assert "the text after it, of the harbour and the ships" in got


def test_private_key_in_json(spark):
    lines = pem(9)
    got = redacted(spark, json.dumps({"type": "service", "private_key": armoured(lines) + "\n", "client": "the harbour"}))
    assert [x for x in lines if x in got] == []


@pytest.mark.parametrize("before", ["Authorization: Bearer ", "the token is '"])
def test_every_part_of_a_jwt(spark, before):
    rng = random.Random(5)
    parts = [base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"%d","name":"Ada","iat":%d,"jti":"%s"}' % (rng.getrandbits(60), rng.getrandbits(40), rng.randbytes(16).hex().encode()), rng.randbytes(32))]
    got = redacted(spark, before + ".".join(parts) + "' and so on")
    assert [x for x in parts[1:] if x in got] == []


def test_context_does_not_reach_over_words():
    key = "wJalrXUtnFEMI7K7MDENGbPxRfiCYzQ9kLm2"
    other = "Zk3vB8qLw0TnYx5RdHs7PaUeJc1MgFo9iVQ6"
    text = f"the client secret {key} is kept apart from what is written in the harbour log {other} and so on"
    compressor = secrets._compressor(secrets.IDENTIFIERS)
    assert secrets.spans_of(text, compressor, 0.75, 256, 48) == [(18, 3, 18 + len(key))]
