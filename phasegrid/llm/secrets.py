"""Secret scan: keyword prefilter, anchored patterns, embedded checksums.

An Aho-Corasick automaton over the lower-cased bytes of a text finds the
keywords; only there are the patterns tried, anchored. Runs of hex digits have
no keyword: as one of 32 digits covers a position divisible by 32, those
positions are probed and a run is grown from each that holds a digit.

Kinds, in this order: assign, access, hex (the base), then those whose own
checksum or structure is verified: github and npm (CRC-32 in base 62), jwt
(a JSON header in base64url), pem (a private key block of valid base64) and
card (Luhn). Spans are in code points, end exclusive.

A card's number has 13 to 19 digits, in runs parted by one blank or hyphen; it
starts a run of digits within NEAR bytes of its word and ends one. Of the ends
that Luhn's sum allows the last counts.

Defined cases: a null text is empty; very long texts are scanned whole; a
kind's matches are leftmost and don't overlap, those of different kinds may;
each row gives one row, equal rows included; an empty table gives no rows;
other columns pass through, and those with an output's name are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import LOWER_TABLE, aside, strings

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "card")
BASE = 3
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
RUN = re.compile(rb"[A-Za-z0-9_-]+")
#: What follows the first segment of a web token.
REST = re.compile(rb"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
DIGITS = re.compile(rb"[0-9]+")
CARD_NAMES = (b"card", b"visa", b"mastercard", b"amex")
NEAR = 40
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Keyword in lower case -> kind.
KEYWORDS = {k: "assign" for k in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")}
KEYWORDS |= {b"akia": "access", b"npm_": "npm", b"eyj": "jwt", b"-----begin ": "pem"}
KEYWORDS |= {b"gh" + c + b"_": "github" for c in (b"p", b"o", b"u", b"s", b"r")} | {k: "card" for k in CARD_NAMES}


def _base62_ok(token: bytes) -> bool:
    """The last six characters are the CRC-32 of what stands before them,
    after the prefix."""
    import zlib

    body, given = token[4:-6], token[-6:]
    crc, digits = zlib.crc32(body), b""
    for _ in range(6):
        crc, r = divmod(crc, 62)
        digits = BASE62[r : r + 1] + digits
    return digits == given


def _jwt_ok(raw: bytes, at: int, stop: int, seen: dict) -> bool:
    """Whether raw[at:stop] is a JSON header in base64url. seen keeps what the
    run's earlier starts decoded: those four characters apart share it."""
    import base64
    import json

    if (stop - at) % 4 == 1:
        return False
    if at % 4 not in seen:
        seen[at % 4] = at, base64.urlsafe_b64decode(raw[at:stop] + b"=" * (-(stop - at) % 4))
    first, data = seen[at % 4]
    if at % 4 + 4 not in seen:
        seen[at % 4 + 4] = data.decode("latin-1")  # JSON's own characters are ASCII
    start = (at - first) // 4 * 3
    try:
        _, end = json.JSONDecoder().raw_decode(seen[at % 4 + 4], start)
        return not data[end:].strip() and "alg" in json.loads(data[start:])
    except (ValueError, RecursionError):
        return False


def _pem_ok(body: bytes) -> bool:
    import base64

    try:
        return len(base64.b64decode(b"".join(body.split()), validate=True)) >= 32
    except ValueError:
        return False


def _luhn_ok(digits: bytes) -> bool:
    values = [c - 48 for c in digits if 48 <= c <= 57][::-1]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _card_end(raw: bytes, at: int) -> int | None:
    """Where the card number ends that starts with the run of digits at `at`."""
    digits, found, p = b"", None, at
    while m := DIGITS.match(raw, p):
        digits += m[0]
        if len(digits) > 19:
            break
        if len(digits) >= 13 and _luhn_ok(digits):
            found = m.end()
        p = m.end() + (raw[m.end() : m.end() + 1] in (b" ", b"-"))
    return found


def automaton():
    import ahocorasick

    words = ahocorasick.Automaton()
    for k, kind in KEYWORDS.items():
        words.add_word(k.decode(), (len(k), kind))
    words.make_automaton()
    return words


HEX_BYTES = b"0123456789abcdef"


def hex_runs(raw: bytes) -> list[tuple[int, int]]:
    """Maximal runs of 32 or more of 0-9a-f."""
    out, end = [], 0
    for p in [i * 32 for i, c in enumerate(raw[::32]) if c in HEX_BYTES]:
        if p < end:
            continue
        a = p
        while a > end and raw[a - 1] in HEX_BYTES:
            a -= 1
        b = p + 1
        while b < len(raw) and raw[b] in HEX_BYTES:
            b += 1
        if b - a >= 32:
            out.append((a, b))
        end = b
    return out


def scan(raw: bytes, words) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret in UTF-8 bytes, by start and kind."""
    out, ends, run, rest, tried = [(a, 2, b) for a, b in hex_runs(raw)], {}, 0, None, 0
    seen: dict = {}
    hits = [(e - n + 1, kind) for e, (n, kind) in words.iter(raw.translate(LOWER_TABLE).decode("latin-1"))]
    for at, kind in sorted(hits):
        k = KINDS.index(kind)
        if kind == "card":  # each number that starts within NEAR bytes of the word, once
            for m in DIGITS.finditer(raw, max(at, tried), at + NEAR + 1):
                start, tried = m.start(), m.end()
                if start < ends.get(kind, 0) or raw[start - 1 : start].isdigit():
                    continue
                if end := _card_end(raw, start):
                    ends[kind] = end
                    out.append((start, k, end))
            continue
        if at < ends.get(kind, 0):
            continue
        if kind == "jwt":
            if not raw.startswith(b"eyJ", at):
                continue
            if at >= run:  # what follows is the same for every start in the run
                run = RUN.match(raw, at).end()
                rest, seen = REST.match(raw, run), {}
            if not rest:
                ends[kind] = run
            elif at + 3 < run and _jwt_ok(raw, at, run, seen):
                ends[kind] = rest.end()
                out.append((at, k, rest.end()))
            continue
        if kind == "assign":
            m = ASSIGN.match(raw, at)
            ok = m and len(m[2]) >= 8
        elif kind == "access":
            m = ACCESS.match(raw, at)
            ok = m and len(m[0]) >= 16
        elif kind in ("github", "npm"):
            m = (GITHUB if kind == "github" else NPM).match(raw, at)
            ok = m and _base62_ok(m[0])
        else:
            m = PEM.match(raw, at)
            ok = m and _pem_ok(m[2])
        if ok or m and k < BASE:  # a failed check takes nothing from later starts
            ends[kind] = m.end()
        if ok:
            out.append((m.start(), k, m.end()))
    return sorted(out)


def secrets(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with secrets: array of (kind, start, stop), by start and kind."""
    made: list = []

    def find(column):
        import numpy as np
        import pyarrow as pa

        if not made:
            made.append(automaton())
        rows = []
        for raw in strings(column):
            found = scan(raw, made[0])
            if found and not raw.isascii():
                points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
            rows.append([{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in found])
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))

    kind = "array<struct<kind:string,start:long,stop:long>>"
    (column,) = aside(docs.drop("secrets"), "secrets")
    return docs.withColumn(column, F.arrow_udf(find, kind).asNondeterministic()(F.col(f"`{text}`").cast("string")))


def joined(found, kinds: tuple[str, ...] | None = None):
    """kind:start:stop of each span, comma-joined."""
    if kinds:
        found = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
