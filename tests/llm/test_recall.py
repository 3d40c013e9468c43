"""Links and components against exhaustive comparison on larger rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from llm_helpers import roots

from phasegrid.llm import embeddings, minhash
from phasegrid.llm.blocks import connecting
from phasegrid.llm.components import components
from phasegrid.llm.minhash import _connect


def test_connecting_finds_all_that_hangs_together(spark):
    """Random links inside groups, one of which holds most rows."""
    rnd = random.Random(7)
    rows = [(g, m) for g, size in ((1, 150), (2, 9), (3, 40), (4, 1)) for m in rnd.sample(range(400), size)]
    mark = [rnd.random() for _ in range(400)]

    def linked(x, y):  # most of the first half hang together, the others are mostly apart
        return abs(mark[x] - mark[y]) < (0.02 if max(x, y) < 200 else 0.0005)

    def work(table, starts):
        ids, label, first, bi, bj = (table[c].to_numpy(zero_copy_only=False) for c in ("node", "label", "first", "bi", "bj"))
        out = []
        edges = np.unique(np.append(starts, len(ids))).tolist()
        for s, e in zip(edges[:-1], edges[1:]):
            assert e - s <= 60
            near = lambda i, js, s=s: np.array([linked(ids[s + i], ids[s + j]) for j in js], bool)
            out += [(int(ids[s + i]), int(ids[s + j])) for i, j in _connect(first[s:e], bi[s] == bj[s], label[s:e], near)]
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    sizes = Counter(g for g, _ in rows)
    df = spark.createDataFrame([(g, m, -(-sizes[g] // 10), -(-sizes[g] // 20)) for g, m in rows], "grp long, node long, parts long, wide_parts long").repartition(4)
    links = connecting(df, "grp", work, block=10, wide=20)
    got = {r.node: r.root for r in components(links).collect()}
    every = [(x, y) for g, x in rows for h, y in rows if g == h and x < y and linked(x, y)]
    expected = roots(400, every)
    assert got == {x: expected[x] for x in {x for pair in every for x in pair}}
    assert links.count() < len(every)


def test_near_duplicates_of_two_thousand_documents(spark):
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(3000)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(20, 120))] for _ in range(300)]
    texts = []
    for i in range(2000):
        own = list(base[0] if i % 3 == 0 else rnd.choice(base))
        for _ in range(rnd.randint(0, max(1, len(own) // 25))):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    posted = defaultdict(list)
    for i, own in enumerate(sets):
        for gram in own:
            posted[gram].append(i)
    links = []
    for i, own in enumerate(sets):
        shared = Counter(j for gram in own for j in posted[gram] if j < i)
        links += [(i, j) for j, n in shared.items() if 100 * n >= 80 * (len(own) + len(sets[j]) - n)]
    expected = roots(2000, links)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=4).collect()}
    lost = sum(got[i] != expected[i] for i in range(2000))
    assert len(set(expected)) < 1500 and lost <= 2, lost


def test_links_of_three_thousand_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((200, 32))
    rows = base[np.where(rng.random(3000) < 0.3, 0, rng.integers(0, 200, 3000))] + rng.standard_normal((3000, 32)) * rng.choice([0.05, 0.1, 0.14, 0.2], (3000, 1))
    label = rng.integers(0, 3, 3000)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(3000, dtype=bool)
    expected = roots(3000, [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    df = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(rows, label))], "vec_id long, embedding array<double>, label int")
    got = embeddings.near_vectors(df).collect()
    found = {r.vec_id: r.n_links for r in got}
    total = int(near.sum())
    assert total > 10_000 and all(found[i] <= n for i, n in enumerate(near.sum(1).tolist()))
    assert sum(found.values()) >= 0.9999 * total
    assert sum(r.component_id != expected[r.vec_id] for r in got) <= 2
