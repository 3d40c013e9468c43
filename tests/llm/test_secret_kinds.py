"""The kinds beside the base ones, against brute force."""

import base64
import json
import random
import re
import zlib

from phasegrid.llm import secrets

WORDS = secrets.automaton()


def found(raw, kind):
    return [(a, b) for a, k, b in secrets.scan(raw, WORDS) if k == secrets.KINDS.index(kind)]


def token(prefix, body):
    crc, digits = zlib.crc32(body), b""
    for _ in range(6):
        crc, r = divmod(crc, 62)
        digits = secrets.BASE62[r : r + 1] + digits
    return prefix + body + digits


def luhn(digits):
    double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in double) % 10 == 0


def cards(text):
    """Every start and end by definition."""
    hits = [m.start() for m in re.finditer("(?=card|visa|mastercard|amex)", text.lower())]
    out, free = [], 0
    for m in re.finditer(r"(?<![0-9])[0-9]", text):
        start = m.start()
        if start < free or not any(h <= start <= h + secrets.NEAR for h in hits):
            continue
        ends = []
        for e in range(start + 13, min(len(text), start + 45) + 1):
            own = text[start:e]
            digits = re.sub("[ -]", "", own)
            if re.fullmatch("[0-9](?:[ -]?[0-9])*", own) and not text[e : e + 1].isdigit() and 13 <= len(digits) <= 19 and luhn(digits):
                ends.append(e)
        if ends:
            free = max(ends)
            out.append((start, free))
    return out


def test_cards():
    rnd = random.Random(12)
    good = ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"]
    bits = [*good, "card", "visa ", " Amex:", "12 ", "7", " 99", "1234567890123", ", ", "x" * 29, " 4111 1111 1111 1111 12", "0" * 25]
    some = 0
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 9)))
        expected = cards(text)
        assert found(text.encode(), "card") == expected, text
        some += len(expected)
    assert some > 500
    assert found(b"card" + b"q" * 29 + b"visa 4111 1111 1111 1111", "card") == [(38, 57)]
    assert found(b"card 94111111111111111", "card") == []  # the end of a longer number


def test_npm_and_github():
    body = bytes(random.Random(3).choice(secrets.BASE62) for _ in range(30))
    for prefix, kind in ((b"npm_", "npm"), (b"ghp_", "github"), (b"gho_", "github")):
        good = token(prefix, body)
        assert found(b"x=" + good + b".", kind) == [(2, 2 + len(good))]
        assert found(good[:-1] + b"!" + good, kind) == [(len(good), 2 * len(good))]
        assert found(good + b"0", kind) == [] and found(good.upper(), kind) == []


def test_pem():
    body = base64.encodebytes(bytes(range(90))).strip()
    block = lambda x, a=b"RSA PRIVATE KEY", b=b"RSA PRIVATE KEY": b"-----BEGIN " + a + b"-----\n" + x + b"\n-----END " + b + b"-----"
    good = block(body)
    assert found(b"a " + good + b" b " + good, "pem") == [(2, 2 + len(good)), (5 + len(good), 5 + 2 * len(good))]
    for bad in (block(b"AAAA"), block(body[:-1]), block(body, b=b"EC PRIVATE KEY"), block(body, b"PUBLIC KEY", b"PUBLIC KEY")):
        assert found(bad, "pem") == []


def test_jwt():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).rstrip(b"=")
    good = b".".join([part({"alg": "HS256", "typ": "JWT"}), part({"sub": "1"}), b"c2ln"])
    assert found(b"a " + good + b"," + good, "jwt") == [(2, 2 + len(good)), (3 + len(good), 3 + 2 * len(good))]
    assert found(b".".join([part({"typ": "JWT"}), part({"sub": "1"}), b"c2ln"]), "jwt") == []
    assert found(good[:-5], "jwt") == []
