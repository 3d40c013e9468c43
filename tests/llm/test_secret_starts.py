"""Secrets that start after a failed one."""

import time

from phasegrid.llm import secrets


def found(raw, kind):
    return [raw[a:b] for a, k, b in secrets.scan(raw, secrets.automaton()) if k == secrets.KINDS.index(kind)]


def test_secrets_after_a_failed_start():
    jwt = b"eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    for before in (b"keyjwt_", b"EYJ-", b"eyJunk_", b"eyJunk.", b"eyJ", b"eyJhIjox_", b"x eyJ.", b"eyJeyjeyJ0"):
        assert found(before + jwt, "jwt") == [jwt]
    assert found(jwt + b" " + jwt, "jwt") == [jwt, jwt]
    assert found(b"eyJunk_eyJunk.eyJunk.eyJ", "jwt") == []
    good, other, bad = b"4111111111111111", b"5500 0000 0000 0004", b"1234567890123"
    assert found(b"card ref " + bad + b", " + good, "card") == [good]
    assert found(b"card " + good + b"; " + other, "card") == [good, other]
    assert found(b"card visa " + bad + b" visa: " + good + b"/" + other, "card") == [good, other]
    assert found(b"card " + b"." * 40 + good, "card") == []
    for part, end in ((b"eyJ", b".eyJa.b"), (b"eyJ7", b"fQ.eyJa.b"), (b"eyJhIjp7", b"fQ.eyJa.b"), (b"card 1234567890123,", b"")):
        began = time.time()
        assert not secrets.scan(part * 100_000 + end, secrets.automaton())
        assert time.time() - began < 30


def test_secrets_github_after_a_failed_start():
    import zlib

    body, digits = b"a" * 30, b""
    crc = zlib.crc32(body)
    for _ in range(6):
        crc, r = divmod(crc, 62)
        digits = secrets.BASE62[r : r + 1] + digits
    assert found(b"ghp_" + b"x" * 33 + b"ghp_" + body + digits, "github") == [b"ghp_" + body + digits]
