"""Boilerplate of hosts with few pages."""

from llm_helpers import bag

from phasegrid.llm import lines


def test_lines_of_small_hosts(spark):
    rows = [(n, i, f"menu\nonly {n} {i}" + ("\npair" if i < 2 else "")) for n in (1, 2, 4, 5, 12, 25) for i in range(n)]
    docs = spark.createDataFrame(rows, "source long, doc_id long, text string")
    expected = []
    for n, i, _ in rows:  # on n and (of two pages or more) on two of the host's n pages
        kept = (["menu"] if n == 1 else []) + [f"only {n} {i}"] + (["pair"] if i < 2 and (n == 1 or 2 <= 0.1 * n) else [])
        expected.append((n, i, "\n".join(kept)))
    assert bag(tuple(r) for r in lines.drop_lines(docs).select("source", "doc_id", "clean_text").collect()) == bag(expected)
