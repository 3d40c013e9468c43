"""Three stages of the pipeline against brute force."""

import pytest
from llm_helpers import bag

import corpus_pipeline as cp

STAGES = dict(cp.STAGES)
NAMES = "doc_id long, text string, source string, n_chars long"


def row(i, text, source="a"):
    return (i, text, source, len(text))


def prose(i, n=30):
    return " ".join(f"w{i}x{j}" for j in range(n))


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    bench = [(0, " ".join(f"b{j}" for j in range(12))), (1, " ".join(f"c{j}" for j in range(12)))]
    rows = [row(i, f"menu\n{prose(i)}" if i < 3 else prose(i), "ab"[i % 2]) for i in range(10)]
    rows += [row(20, prose(4)), row(21, prose(5) + " " + bench[0][1]), row(22, f"{bench[0][1]} {prose(22)} {bench[1][1]}")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def result(spark, name, folder, rows):
    return STAGES[name](spark, spark.createDataFrame(rows, NAMES), folder)


def test_near_dedup(spark, given):
    folder, rows = given
    least = {}
    for r in rows:
        least[r[1]] = min(r[0], least.get(r[1], r[0]))
    got = result(spark, "near_dedup", folder, rows).select("doc_id", "text", "source", "n_chars").collect()
    assert bag(map(tuple, got)) == bag(r for r in rows if least[r[1]] == r[0])


def test_line_dedup(spark, given):
    folder, rows = given
    pages, counts = {}, {}
    for _, text, host, _ in rows:
        pages[host] = pages.get(host, 0) + 1
        for x in set(text.split("\n")):
            counts[host, x] = counts.get((host, x), 0) + 1
    expected = []
    for i, text, host, _ in rows:
        kept = "\n".join(x for x in text.split("\n") if not (counts[host, x] >= 2 and counts[host, x] > 0.1 * pages[host]))
        expected.append((i, kept, host, len(kept)))
    got = result(spark, "line_dedup", folder, rows).collect()
    assert bag(map(tuple, got)) == bag(expected) != bag(rows)


def test_decontamination(spark, given):
    folder, rows = given
    got = {r.doc_id: r for r in result(spark, "decontamination", folder, rows).collect()}
    assert sorted(got) == [r[0] for r in rows if r[0] != 22]
    for i, text, _, _ in rows:
        if i in (21, 22):
            continue
        assert got[i].text == text
    assert "b0" not in got[21].text and got[21].text.split() == prose(5).split() and got[21].n_chars == len(got[21].text)
