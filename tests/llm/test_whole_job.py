"""What an operator must not leave out, against brute force on small rows."""

import random

import numpy as np
from llm_helpers import bag, sha

from phasegrid.llm import substrings


def test_substrings_hot_within_a_text(spark, monkeypatch):
    rnd = random.Random(11)
    prose = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, core, period = prose(900), prose(180), prose(37)
    texts = [prose(150) + passage + prose(150) + passage + prose(150) for _ in range(4)]
    texts += [prose(100) + period * 40 + prose(100 + i) for i in range(4)]
    for _ in range(4):  # the anchor is in all four, the windows around it in one
        own = prose(110) + core + prose(110)
        texts.append(prose(120) + own + prose(120) + own + prose(120))
    texts += [prose(600), prose(199)]
    raws, seen, expected = [t.encode() for t in texts], {}, []
    for raw in raws:
        for s in range(len(raw) - 199):
            seen[raw[s : s + 200]] = seen.get(raw[s : s + 200], 0) + 1
    for i, raw in enumerate(raws):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 199):
            if seen[raw[s : s + 200]] > 1:
                gone[s : s + 200] = True
        expected.append((i, int(gone.sum()), sha(bytes(np.frombuffer(raw, np.uint8)[~gone]))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (20_000, 2):
        monkeypatch.setattr(substrings, "HOT", hot)
        got = substrings.drop_repeats(docs).collect()
        assert bag((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == bag(expected)
