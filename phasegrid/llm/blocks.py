"""Groups of rows of any size, compared in blocks of bounded size.

A group (all rows of a key) of up to `block` rows is one task unit. A larger
one is dealt by the hash of its members into blocks.

dealt makes each pair of blocks a unit: no task holds more than two blocks and
every two members meet exactly once, but a group of m rows moves m * m / block
of them. That is for comparisons that must see every pair.

connecting is for those that only ask what is connected. Blocks are compared
within themselves first. Then one member of each component that a group has
found goes on, and they are compared among themselves. What is still apart is
compared in full, and exactly: the members outside a group's largest component
visit all of its blocks. A group of m rows whose members mostly hang together
moves about 2 m rows and those outside, once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from phasegrid.llm.common import Scratch, cut
from phasegrid.llm.components import components


def dealt(rows: DataFrame, key: str, parts: str, member: str) -> DataFrame:
    """rows by (key, bi, bj), with `first`: whether the row belongs to block
    bi. parts: into how many blocks the row's group is dealt."""
    own = F.pmod(F.xxhash64(F.lit(11), F.col(member)), F.col(parts))
    out = rows.withColumn("own_", own).withColumn("other_", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts).cast("long") - 1)))
    out = out.withColumn("bi", F.least("own_", "other_").cast("int")).withColumn("bj", F.greatest("own_", "other_").cast("int"))
    out = out.withColumn("first", F.col("own_") == F.col("bi")).drop("own_", "other_", parts)
    return together(out, key)


def together(rows: DataFrame, key: str) -> DataFrame:
    """rows, each unit (key, bi, bj) in one piece."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def units(batches: Iterator, key: str) -> Iterator:
    """Arrow tables of whole units, several small ones at a time, from batches
    sorted by (key, bi, bj); with them the starts of the units in the table."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        ids = [table[c].to_numpy() for c in (key, "bi", "bj")]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for x in ids:
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last).combine_chunks(), starts
        rest = table.slice(last).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


class Sets:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def fixed(column, width: int, kind):
    """The rows of a binary column, all of one length, as a matrix."""
    import numpy as np

    c = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if hasattr(c, "chunks"):
        c = c.chunk(0)
    offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    raw = np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(raw).view(kind).reshape(len(c), width)


def spread(work: Callable, rows: DataFrame, key: str, schema: str) -> DataFrame:
    """work(table, starts) over the units of dealt rows; yields batches."""

    def run(batches):
        for table, starts in units(batches, key):
            yield from work(table, starts)

    return rows.mapInArrow(run, schema)


LINKS = "a long, b long"


def connecting(rows: DataFrame, key: str, work: Callable, *, block: int, wide: int) -> DataFrame:
    """Links (a, b) between members of groups that connect all that are
    connected by links within a group. rows: key, node (once in a group),
    parts and wide_parts (into how many blocks the group is dealt for the
    first and for the last step, of `block` and `wide` rows or less) and what
    work needs. work(table, starts) gets units with bi, bj, first and label;
    members that have the same label are known to be connected."""
    columns = [c for c in rows.columns if c not in ("parts", "wide_parts")] + ["bi", "bj", "first", "label"]
    own = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), F.col("node")), F.col(parts)).cast("int")
    compare = lambda units_: spread(work, units_.select(columns), key, LINKS)

    seen = Observation()
    blocks = rows.observe(seen, F.max("parts").alias("most")).withColumn("bi", own(11, "parts"))
    found = cut(compare(together(blocks.withColumn("bj", F.col("bi")).withColumn("first", F.lit(True)).withColumn("label", F.col("node")), key)))
    if (seen.get["most"] or 0) <= 1:
        return found
    scratch = Scratch(rows.filter("parts > 1"), "groups")

    def labelled() -> DataFrame:
        roots = components(found).select(F.col("node").alias("member"), F.col("root").alias("found_"))
        big = scratch.read()
        return big.join(roots, F.col("node") == F.col("member"), "left").withColumn("label", F.coalesce("found_", "node")).drop("member", "found_")

    # One member for each component of a group.
    now = cut(labelled().select(key, "node", "label"))
    least = now.groupBy(key, "label").agg(F.min("node").alias("node"))
    counts = least.groupBy(F.bitwise_not(key).alias("k")).agg(F.ceil(F.count(F.lit(1)) / block).alias("n_parts"))
    least = least.withColumn("k", F.bitwise_not(key)).join(counts, "k").select(F.col(key).alias("g"), F.col("node").alias("member"), "label", "n_parts")
    chosen = scratch.read().drop("parts", "wide_parts").join(least, (F.col(key) == F.col("g")) & (F.col("node") == F.col("member"))).drop("g", "member")
    found = cut(found.union(compare(dealt(chosen, key, "n_parts", "node"))))

    # Those outside the largest component meet the whole group.
    now = labelled()
    sizes = cut(now.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n")))
    outside = F.sum("n") - F.max("n")
    groups = sizes.groupBy(F.bitwise_not(key).alias("k")).agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.ceil(outside / wide).alias("visits")).filter("visits > 0")
    now = now.withColumn("k", F.bitwise_not(key)).join(groups, "k")
    some = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    hosts = now.withColumn("bi", own(12, "wide_parts")).withColumn("visit", F.explode(some("visits"))).withColumn("bj", (-1 - F.col("visit")).cast("int")).withColumn("first", F.lit(False))
    guests = now.filter("label <> main").withColumn("bj", (-1 - own(13, "visits")).cast("int")).withColumn("visit", F.explode(some("wide_parts"))).withColumn("bi", F.col("visit").cast("int")).withColumn("first", F.lit(True))
    last = cut(compare(together(hosts.select(columns).union(guests.select(columns)), key)))
    scratch.drop()
    return found.union(last).filter("a <> b")
