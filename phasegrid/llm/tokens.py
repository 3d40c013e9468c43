"""Token counts from an exact length histogram.

Each document is encoded once and only its length is kept; lengths are counted
before and after one shuffle. Suffix sums over the histogram then answer, for
every context limit: documents and tokens in all, how many documents are at
least that long, and the tokens left when every document is cut there. Rows
stand for the lengths found, between which the answers are linear, and for the
limits asked for. The histogram has a row for each length, not for each
document; its sums are taken in two levels, so that no task reads all of it.

Defined cases: a null or empty text has 0 tokens; a very long one is encoded
whole, and one that isn't valid UTF-8 with U+FFFD for what isn't; the strings
of special tokens are ordinary text; equal rows count as often as they stand
there; an empty table gives no rows, limits or not; a null in `by` is a group;
columns in `by` keep their names, an output that would clash with one gets an
underscore; other columns are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.common import aside, cut, strings

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Context limits that the query answers beside the lengths found.
LIMITS = tuple(1 << i for i in range(7, 18))
BLOCK = 512
BLANKS = re.compile(r"\s{1000}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def length(codec, text: str, pattern: str) -> int:
    """Tokens of a text. The codec's own pattern matcher overflows its stack
    on very long runs of blanks; texts with one are split here instead."""
    if not BLANKS.search(text):
        return len(codec.encode_ordinary(text))
    import regex

    return sum(len(codec._encode_single_piece(m[0])) for m in regex.finditer(pattern, text))


def n_tokens(docs: DataFrame, *, text: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text, by a byte-level BPE whose
    ranks stand in a file that only the driver needs."""
    import public_tokenizers

    with open(path or default_path(), "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())  # of fixed size
    pattern, made = public_tokenizers.PATTERN, []

    def count(column):
        import base64

        import pyarrow as pa
        import tiktoken

        if not made:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
            made.append(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}))
        return pa.array([length(made[0], x.decode(errors="replace"), pattern) for x in strings(column)], pa.int64())

    return docs.withColumn(name, F.arrow_udf(count, "long").asNondeterministic()(F.col(f"`{text}`").cast("string")))


OUT = ("context", "docs", "docs_at_least", "docs_below", "tokens_below", "tokens_kept", "tokens_lost", "share_below", "total_docs", "total_tokens")


def length_table(docs: DataFrame, *, text: str = "text", by: list[str] | None = None, path: str | None = None, limits: tuple[int, ...] = ()) -> DataFrame:
    """By context limit (each length found and each of `limits`, and `by`):
    docs (of that length), docs_at_least, docs_below, tokens_below, tokens_kept
    (all documents cut at the limit), tokens_lost, share_below (of documents:
    the limit is their quantile), total_docs and total_tokens."""
    by = by or []
    groups = [f"g{i}" for i in range(len(by))]
    rows = docs.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(by, groups)], F.col(f"`{text}`").alias("body"))
    counts = n_tokens(rows, text="body", path=path, name="context").groupBy(*groups, "context").agg(F.count(F.lit(1)).alias("docs"))
    if limits:
        counts = cut(counts)
        asked = counts.select(*groups).distinct().select(*groups, F.explode(F.lit([*map(int, limits)]).cast("array<long>")).alias("context"), F.lit(0).cast("long").alias("docs"))
        counts = counts.union(asked).groupBy(*groups, "context").agg(F.sum("docs").alias("docs"))
    hist = cut(counts).withColumn("block", F.floor(F.col("context") / BLOCK))
    tokens = (F.col("docs") * F.col("context")).alias("t")
    blocks = hist.groupBy(*groups, "block").agg(F.sum("docs").alias("block_docs"), F.sum(tokens).alias("block_tokens"))
    over, upto = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *[F.col(c).alias(f"by_{c}") for c in groups],
        F.col("block").alias("at"),
        F.coalesce(F.sum("block_docs").over(upto), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("block_tokens").over(upto), F.lit(0)).alias("tokens_before"),
        F.sum("block_docs").over(over).alias("total_docs"),
        F.sum("block_tokens").over(over).alias("total_tokens"),
    )
    same = F.col("block") == F.col("at")
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"by_{c}"))
    inside = Window.partitionBy(*groups, "block").orderBy("context").rowsBetween(Window.unboundedPreceding, -1)
    sums = hist.join(blocks, same).select(
        *groups,
        "context",
        "docs",
        (F.col("docs_before") + F.coalesce(F.sum("docs").over(inside), F.lit(0))).alias("docs_below"),
        (F.col("tokens_before") + F.coalesce(F.sum(F.col("docs") * F.col("context")).over(inside), F.lit(0))).alias("tokens_below"),
        "total_docs",
        "total_tokens",
    )
    at_least = F.col("total_docs") - F.col("docs_below")
    kept = F.col("tokens_below") + at_least * F.col("context")
    found = {"docs_at_least": at_least, "tokens_kept": kept, "tokens_lost": F.col("total_tokens") - kept, "share_below": F.col("docs_below") / F.col("total_docs")}
    names = aside(docs.select(*[f"`{c}`" for c in by]), *OUT)
    return sums.select(*[F.col(g).alias(c) for g, c in zip(groups, by)], *[found.get(c, F.col(c)).alias(n) for c, n in zip(OUT, names)])


def quantiles(found: DataFrame, shares: list[float], *, by: list[str] | None = None) -> DataFrame:
    """Of a length table (and by group): for each share, `context`, the least
    length that at least that share of the documents doesn't exceed."""
    by = [f"`{c}`" for c in by or []]
    reached = found.withColumn("share", F.explode(F.lit([*map(float, shares)]))).filter((F.col("docs") > 0) & (F.col("docs_below") + F.col("docs") >= F.col("share") * F.col("total_docs")))
    return reached.groupBy(*by, "share").agg(F.min("context").alias("context"))
