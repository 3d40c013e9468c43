"""Small tables with awkward rows, and brute-force answers."""

from __future__ import annotations

import hashlib
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, node string, key string, `Key` string"


def corpus(n: int = 120, seed: int = 3) -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): prose with copies, near copies, shared lines,
    nulls, empty, short and very long texts, and repeated rows."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéñ ßfg".replace(" ", "")) for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    out: list = []
    for i in range(n):
        kind, text = i % 12, "\n".join(prose(rnd.randint(5, 40)) for _ in range(rnd.randint(1, 5)))
        if kind == 1 and i > 12:
            text = rnd.choice(out)[1]
        elif kind in (2, 3) and i > 12:
            own = (rnd.choice(out)[1] or "").split(" ")
            for _ in range(max(1, len(own) // 60)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            text = " ".join(own)
        elif kind == 4:
            text = "read more about our cookies here \t\n" + text
        elif kind == 5 and i > 12:
            text += "\n" + (rnd.choice(out)[1] or "")[:300] + prose(10)
        out.append((i, text, f"s{i % 5}" if i % 3 else "hot"))
    out += [(n, None, "s1"), (n + 1, "", None), (n + 2, " \n\t ", "s2"), (n + 3, "To " * 400, "s0"), (n + 4, "To " * 300, None)]
    out += [(n + 5, prose(6000), "s1"), (n + 6, "one", "s3"), (n + 7, "one two", "s3"), (n + 8, "one two", "s4"), (n + 9, "x" * 5000, "s4")]
    out += [(n + 10, "x" * 199, "s4"), (n + 11, "y" * 200, "s4"), (n + 12, "Ünï😀 " * 50, "s4"), out[0], out[7], (None, prose(30), "s1"), (None, None, None)]
    return out


def frame(spark, rows):
    """The rows as documents, with columns whose names operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", "b", "c", "d") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words string, node string, key string, print string").repartition(5)


def sha(text: bytes | str) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def roots(n: int, links) -> list[int]:
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def bag(rows):
    return sorted(map(repr, rows))
