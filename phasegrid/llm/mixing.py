"""Mixing sources to target weights along a time-varying curriculum.

Targets. Sources in order of code points, null last, have the weights 5, 2, 1,
repeating, and share all words by weight; a target stops at 3 times its
source's words and the excess is shared again by weight among the others. That
is a level L with target = min(3 x size, L x weight), and L follows from one
ordered pass over the sources (a row each).

Curriculum. Each source's share changes along the run: its weight at time t in
[0, 1] is proportional to 1 + a(2t - 1), with a = -0.5, 0, 0.5, repeating. The
integral t + a(t^2 - t) is the source's cumulative demand, and its inverse
turns a document's offset in its source's words into a training position.
Documents follow each other by the MD5 of their id (then by size and a hash of
the whole row, so that reruns agree), as often as the target needs (3 times at
most); of the last one only the words needed are taken, so a source gives
exactly its rounded target. Rows sorted by position are the run.

Offsets are sums in two levels, over 4096 ranges of the MD5 and inside them,
so no source is summed by one task. Everything is DataFrame functions.

The windows over the table of sources are one task's work; MAX_SOURCES bounds
it, and more sources are an error rather than a slow task.

Defined cases: a null text has size 0; very long texts count whole; documents
of size 0 are never taken; equal rows are documents of their own; a null id is
ordered as an empty one; a null source is a source, the last; an empty table
gives no rows; other columns pass through, and those with an output's name are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.common import aside, cut, utf8

WEIGHTS, CAP, RAMPS, MAX_SOURCES = (5, 2, 1), 3, (-0.5, 0.0, 0.5), 1_000_000
WORD = r"[^\x20\x09-\x0D]+"
OWN = ("size", "source_size", "target", "taken", "positions", "takes")


def words(text: str) -> Column:
    return F.regexp_count(utf8(f"`{text}`"), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, *, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size: a row for each source) with rank and target.
    Its windows hold a row for each source, not for each document."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    most = (F.lit(float(cap)) * F.col("source_size")).alias("most")
    ranked = ranked.select("*", most, (most / F.col("weight")).alias("full_at"))
    order = Window.orderBy("full_at", "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The level is that of the first source, in this order, that it doesn't fill.
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())
    target = F.least("most", first["level"] * F.col("weight"))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = CAP, ramps=RAMPS, keep: list[str] | None = None) -> DataFrame:
    """A row for each document: the columns in keep (all but those with the
    names of these), size, source_size, target, taken, positions and takes (of
    each copy: its time in [0, 1], and the words it takes)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OWN]
    src, key, tie, bucket, size = aside(docs.select(*[f"`{c}`" for c in keep]), "src", "key", "tie", "bucket", "size")
    key_of = F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    tie_of = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{source}`").cast("string").alias(src), key_of.alias(key), tie_of.alias(tie), words(text).alias(size))
    rows = rows.withColumn(bucket, F.substring(key, 1, 3))
    sums = cut(rows.groupBy(F.col(src).alias("source"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("words")))
    own = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    if own.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = targets(own, weights=weights, cap=cap)
    sources = sources.withColumn("ramp", F.element_at(F.array(*[F.lit(float(a)) for a in ramps]), (F.col("rank") % len(ramps) + 1).cast("int")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    starts = starts.join(sources, F.col("s").eqNullSafe(F.col("source"))).select(F.struct("s", "bucket").alias("part"), F.struct("before", "source_size", "target", "ramp").alias("facts"))
    facts, part = aside(rows, "facts", "part")
    starts = starts.select(F.col("part").alias(part), F.col("facts").alias(facts))
    # A range of one source: its offset comes by a join, the sums inside by a window over the same distribution.
    rows = rows.withColumn(part, F.struct(F.col(src).alias("s"), F.col(bucket).alias("bucket"))).join(starts, part)
    inside = Window.partitionBy(part).orderBy(key, size, tie).rowsBetween(Window.unboundedPreceding, -1)
    (at, due) = aside(rows, "at", "due")
    rows = rows.withColumn(at, F.col(facts)["before"] + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    rows = rows.withColumn(due, F.floor(F.col(facts)["target"] + 0.5).cast("long"))
    whole, a = F.col(facts)["source_size"], F.col(facts)["ramp"]
    take = lambda p: F.greatest(F.lit(0), F.least(F.col(size), F.col(due) - p * whole - F.col(at))).cast("long")
    share = lambda p: (p * whole + F.col(at)) / F.nullif(F.col(due), F.lit(0)).cast("double")
    time = lambda y: F.when(a == 0, y).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * y) - (1 - a)) / F.nullif(2 * a, F.lit(0.0)))
    copies = F.filter(F.array(*[F.struct((time(share(p)) + F.lit(0.0)).alias("position"), take(p).alias("take")) for p in range(cap)]), lambda x: x["take"] > 0)
    (made,) = aside(rows, "made")
    rows = rows.withColumn(made, copies)
    return rows.select(
        *[f"`{c}`" for c in keep],
        F.col(size).alias("size"),
        whole.alias("source_size"),
        F.col(facts)["target"].alias("target"),
        sum((take(p) for p in range(1, cap)), take(0)).alias("taken"),
        F.col(made)["position"].alias("positions"),
        F.col(made)["take"].alias("takes"),
    )


def curriculum(docs: DataFrame, *, text: str = "text", **settings) -> DataFrame:
    """The training run: a row for each copy of a document, sorted by position,
    with docs' columns, copy, position and take; a text of which only some
    words are taken ends after them."""
    rows = mix(docs, text=text, **settings)
    names = [c for c in docs.columns if c not in (*OWN, "copy", "position", "take")]
    (made,) = aside(rows, "made")
    rows = rows.select(*[f"`{c}`" for c in names], "size", F.posexplode(F.arrays_zip("positions", "takes")).alias("copy", made))
    take = F.col(made)["takes"]
    # 'a b' splits before 'b': the pieces keep the blanks between words.
    body = F.when(take < F.col("size"), F.array_join(F.slice(F.split(F.col(f"`{text}`"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1), F.lit(1), F.greatest(take.cast("int"), F.lit(1))), "")).otherwise(F.col(f"`{text}`"))
    out = rows.select(*[body.alias(c) if c == text else F.col(f"`{c}`") for c in names], "copy", F.col(made)["positions"].alias("position"), take.alias("take"))
    return out.orderBy("position", "copy")


def schedule(docs: DataFrame, **settings) -> DataFrame:
    """What mix returns, with copies (how often a document is taken) and the
    first and last of their positions, sorted by the first; documents that
    aren't taken come last, by the MD5 of their id."""
    rows = mix(docs, **settings)
    doc_id = settings.get("doc_id", "doc_id")
    (order,) = aside(rows, "order")
    out = rows.select(
        "*",
        F.size("positions").cast("long").alias("copies"),
        F.element_at("positions", F.when(F.size("positions") > 0, 1)).alias("first_position"),
        F.element_at("positions", F.nullif(F.size("positions"), F.lit(0))).alias("last_position"),
        F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).alias(order),
    )
    # The second key deals out the documents without a position.
    return out.orderBy(F.col("first_position").asc_nulls_last(), order).drop(order)
