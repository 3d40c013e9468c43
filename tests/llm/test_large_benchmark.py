"""A benchmark of ten megabytes, and both ways of scanning."""

import random
import sys
import time

import numpy as np
from llm_helpers import bag

from phasegrid.llm import decontaminate as d

FIELDS = ("doc_id", "n_words", "n_hit", "items", "spans", "clean_text", "contaminated")


def test_ten_megabytes_fit_a_worker():
    rnd = random.Random(2)
    words = [f"{rnd.randrange(10**6):x}" for _ in range(50_000)]
    items = [(str(i), " ".join(rnd.choice(words) for _ in range(170)).encode()) for i in range(10_000)]
    assert sum(len(t) for _, t in items) > 9 << 20
    began = time.time()
    made = d.Windows(items, 8)
    assert time.time() - began < 60
    words = sum(sys.getsizeof(w) + 32 for w in made.vocabulary) + sys.getsizeof(made.vocabulary)
    size = words + made.codes.nbytes + len(made.text) + made.begin.nbytes + sum(b.bits.nbytes + sum(x.nbytes for x in rest) for b, *rest in made.tables.values())
    assert size < 100 << 20 and sys.getsizeof(made.names) < 1 << 20
    for i in (0, 77, 9_999):
        own = items[i][1].split()
        hit, found = made.scan([b"no", *own[20:40], b"no"])
        assert found == {str(i)} and hit.tolist() == [False] + [True] * 20 + [False]
    bits = made.tables[8][0]
    assert bits.has(np.random.default_rng(1).integers(0, 2**63, 100_000, np.uint64) * np.uint64(2)).mean() < 0.1


def test_both_ways_agree_and_verify(spark, monkeypatch):
    """Also when all prints collide: words decide."""
    rnd = random.Random(4)
    words = list("abcdefg")
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i % 17, prose(rnd.randint(0, 14))) for i in range(40)] + [(None, prose(9)), (3, "A b!"), (4, None)]
    docs = [(i, rnd.choice(["", "z "]) + prose(rnd.randint(0, 400))) for i in range(60)] + [(60, None), (61, "b\na b")]
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    results = [bag(map(tuple, d.decontaminate(table, bench, broadcast_bytes=b).select(*FIELDS).collect())) for b in (1 << 20, 0)]
    assert results[0] == results[1]
    monkeypatch.setattr(d, "prints", lambda x, n: np.zeros(max(0, len(x) - n + 1), np.uint64))
    windows = d.Windows([(str(i), (t or "").encode()) for i, t in items if i is not None], 8)
    for i, text in docs[:20]:
        own = text.encode().split()
        grams = {}
        for item, t in items:
            t = (t or "").lower().replace("!", "").split()
            for j in range(len(t) - min(8, len(t)) + 1 if t and item is not None else 0):
                grams.setdefault(tuple(t[j : j + min(8, len(t))]), set()).add(str(item))
        texts = [w.decode() for w in own]
        expected = set().union(*(v for g, v in grams.items() if any(tuple(texts[j : j + len(g)]) == g for j in range(len(texts)))))
        assert windows.scan(own)[1] == expected
