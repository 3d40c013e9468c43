"""The whole pipeline, and its first and last stages, against brute force."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash
from llm_helpers import bag, corpus, roots
from pyspark.sql import functions as F

import corpus_pipeline as cp
from phasegrid.llm import common, quality

NAMES = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, node string"
BENCH = [(i, " ".join(f"bench{i}x{j}" for j in range(10 + i))) for i in range(4)]
LABELS = [(i, int(i % 7 != 5)) for i in range(0, 130, 2)] + [(None, 1), (4, 0)]


def documents():
    rnd = random.Random(1)
    out = []
    for i, text, source in corpus(130):
        if i is not None and i % 7 == 5:
            text = " ".join([rnd.choice(["spam", "win", "cash"]) for _ in range(300)])
        elif i is not None and i % 13 == 3:
            text = f"{text}\n{BENCH[i % 4][1]}" + (f" {BENCH[0][1]} {BENCH[3][1]}" if i % 2 else "")
        elif i is not None and i % 11 == 2:
            text = f"menu | home | {source}\n{text}"
        out.append((i, text, "en", source, len(text or ""), "x", "y", "z"))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), NAMES).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def good_ones(spark, rows):
    """What the quality stage keeps."""
    grams = []
    for row in rows:
        own = [xxhash.xxh3_64_intdigest(x.encode()) for x in words(row[1])]
        grams.append([(x * 0x9E3779B97F4A7C15) % 2**64 >> 48 for x in own + [(3 * a + b) % 2**64 for a, b in zip(own, own[1:])]])
    best = {}
    for i, q in LABELS:
        if i is not None:
            best[i] = max(q, best.get(i, 0))
    raw = Counter(g for own in grams for g in own)
    target = Counter(g for own, row in zip(grams, rows) if best.get(row[0]) for g in own)
    ratio = {g: (target[g] + 64) / (target.total() * n / raw.total() + 64) for g, n in raw.items()}
    whole = math.log(sum(n / raw.total() * ratio[g] for g, n in raw.items()))
    noise = {r.doc_id: r.g for r in spark.createDataFrame([(i,) for i in {row[0] for row in rows}], "doc_id long").select("doc_id", quality.gumbel("doc_id").alias("g")).collect()}
    keys = [sum(math.log(ratio[g]) - whole for g in own) + noise[row[0]] for own, row in zip(grams, rows)]
    k = round(len(rows) * sum(best.values()) / len(best))
    least = sorted(keys, reverse=True)[k - 1]
    return [row for row, key in zip(rows, keys) if key >= least - 1e-9]


def without_lines(rows):
    pages = Counter(row[3] for row in rows)
    counts = Counter((row[3], x) for row in rows for x in {y.strip(" \t\r") for y in (row[1] or "").split("\n")} - {""})
    out = []
    for row in rows:
        gone = lambda x, s=row[3]: counts[s, x] >= 2 and counts[s, x] > 0.1 * pages[s]
        text = None if row[1] is None else "\n".join(x for x in row[1].split("\n") if not gone(x.strip(" \t\r")))
        out.append((*row[:1], text, *row[2:4], row[4] if text == row[1] else len(text), *row[5:]))
    return out


def one_of_each(rows):
    sets = []
    for row in rows:
        own = words(lower(row[1] or ""))
        n = min(5, len(own))
        sets.append({tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set())
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    first: dict = {}
    for i, row in enumerate(rows):
        if sets[i]:
            key = (row[0] is None, row[0] or 0)
            if root[i] not in first or key < first[root[i]][0]:
                first[root[i]] = key, row
    return [row for row, own in zip(rows, sets) if not own] + [row for _, row in first.values()]


def clean(rows):
    alnum = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    grams = {tuple(w[i : i + 8]): item for item, t in BENCH for w in [alnum.findall(lower(t))] for i in range(len(w) - 7)}
    out = []
    for row in rows:
        found = list(alnum.finditer(lower(row[1] or "")))
        own, hit, items = [m[0] for m in found], set(), set()
        for i in range(len(own) - 7):
            if (item := grams.get(tuple(own[i : i + 8]))) is not None:
                hit.update(range(i, i + 8))
                items.add(item)
        if len(items) >= 2:
            continue
        text, at = "", 0
        for i, m in enumerate(found):
            if i in hit:
                text += row[1][at : m.start()] if i - 1 not in hit else ""
                at = m.end()
        text = None if row[1] is None else text + row[1][at:]
        out.append((*row[:1], text, *row[2:4], row[4] if text == row[1] else len(text), *row[5:]))
    return out


def test_run(spark, folder):
    left = set(common._LEFT)
    rows = documents()
    stages = [rows]
    for step in (lambda x: good_ones(spark, x), without_lines, one_of_each, clean):
        stages.append(step(stages[-1]))
    assert len(rows) > len(stages[1]) and stages[1] != stages[2] and len(stages[2]) > len(stages[3]) > len(stages[4])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), expected in zip(cp.STAGES[:-1], stages[1:]):
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        assert bag(map(tuple, got.collect())) == bag(expected), name
        docs = spark.createDataFrame(expected, NAMES).repartition(3)
    run = cp.run(spark, folder)
    assert run.columns == [*docs.columns, "copy", "position", "take"]
    got = run.collect()
    # The run is a mix of what the fourth stage left: whole texts, or starts of them.
    texts = Counter((r[0], r[3], r[1]) for r in stages[-1])
    assert [r.position for r in got] == sorted(r.position for r in got) and all(0 <= r.position <= 1 for r in got)
    for r in got:
        assert len(words(r.text)) == r["take"] > 0
        assert (r.doc_id, r.source, r.text) in texts or any((i, s) == (r.doc_id, r.source) and (t or "").startswith(r.text) for i, s, t in texts)
    sizes, taken = Counter(), Counter()
    for row in stages[-1]:
        sizes[row[3]] += len(words(row[1]))
    for r in got:
        taken[r.source] += r["take"]
    assert sum(taken.values()) <= sum(sizes.values()) + len(sizes) and all(taken[s] <= 3 * sizes[s] + 1 for s in sizes)
    assert bag(map(tuple, cp.run(spark, folder).collect())) == bag(map(tuple, got))
    assert len(set(common._LEFT) - left) < 40


def test_run_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], NAMES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_nothing_is_rejected_without_labels_and_items(spark, tmp_path):
    rows = [(i, f"text number {i} of quite different words {i * i} {i**3} {i**5}", "en", "s", 10, "x", "y", "z") for i in range(1, 20)]
    spark.createDataFrame(rows, NAMES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path))
    assert got.select(F.count_distinct("doc_id")).first()[0] == 19 and bag(r.text for r in got.collect()) == bag(r[1] for r in rows)
