"""Line dedup by site-relative frequency.

A page's distinct lines (trimmed of blanks) are counted per host; a line that
stands on more than `ratio` of its host's pages, and on `min_pages` of them at
least, is boilerplate there and every occurrence goes. Counting combines
before the shuffle, so neither a hot host nor a hot line meets in one task.

Over a host there are at most (mean lines of a page / ratio) such lines. They
are broadcast where their number over all hosts is at most `broadcast_rows`;
beyond it the lines of all pages meet them in a shuffled join, whose hot keys
adaptive execution splits.

Defined cases: a null text has no lines and stays null; blank lines are never
boilerplate and stay; a null host is a host of its own; equal rows are as many
pages; other columns pass through, and those with an output's name are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import aside, cut

RATIO, MIN_PAGES, BROADCAST_ROWS = 0.1, 2, 200_000
BLANKS = " \t\r"


def _print(line: Column) -> Column:
    """128 bits that stand for a trimmed line."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _solid(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and line (a fingerprint) of each line to drop, with its pages and
    its host's pages."""
    pages = docs.select(F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").cast("string").alias("text"))
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _solid), _print))
    counts = pages.select("host", F.explode(own).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    totals = pages.groupBy(F.col("host").alias("site")).agg(F.count(F.lit(1)).alias("total"))
    both = counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).drop("site")
    return both.filter(F.col("pages") > F.lit(ratio) * F.col("total"))


def drop_lines(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with n_lines (that aren't blank), n_dropped and clean_text."""
    found = cut(boilerplate(docs, host=host, text=text, ratio=ratio, min_pages=min_pages).select("host", "line"))
    site, drops, lines, uid = aside(docs, "site", "drops", "lines", "uid")
    mine, body = F.col(f"`{host}`").cast("string"), F.col(f"`{text}`").cast("string")
    if found.count() <= broadcast_rows:
        sets = found.groupBy(F.col("host").alias(site)).agg(F.collect_list("line").alias(drops))
        marked = docs.join(F.broadcast(sets), mine.eqNullSafe(F.col(site)), "left").drop(site)
        keep = lambda x: F.coalesce(~F.array_contains(F.col(drops), _print(x)), F.lit(True)) | ~_solid(x)
        marked = marked.withColumn(lines, F.filter(_lines(body), keep))
    else:
        docs = cut(docs.withColumn(uid, F.monotonically_increasing_id()))
        each = docs.select(F.col(uid).alias("uid"), mine.alias("site"), F.posexplode(_lines(body)).alias("at", "x")).filter(_solid(F.col("x"))).select("uid", "site", "at", _print(F.col("x")).alias("own"))
        hits = each.join(found, F.col("site").eqNullSafe(F.col("host")) & (F.col("own") == F.col("line"))).groupBy(F.col("uid").alias(uid)).agg(F.collect_set("at").alias(drops))
        marked = docs.join(hits, uid, "left").drop(uid)
        keep = lambda x, i: ~F.array_contains(F.coalesce(F.col(drops), F.array().cast("array<int>")), i)
        marked = marked.withColumn(lines, F.filter(_lines(body), keep))
    n_lines = F.size(F.filter(_lines(body), _solid)).cast("long")
    kept = F.size(F.filter(F.col(lines), _solid)).cast("long")
    clean = F.when(body.isNotNull(), F.array_join(lines, "\n"))
    names = [f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_dropped", "clean_text", uid)]
    return marked.select(*names, n_lines.alias("n_lines"), (n_lines - kept).alias("n_dropped"), clean.alias("clean_text"))
