"""The network of interferograms: epochs, spanning trees, loops, covariance.

Interferograms and epochs are few, so their graph is handled on the driver or
as tiny DataFrames that are broadcast; pixels are not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.model import DAYS_PER_YEAR, Ifg, Network


def years(first, second):
    return F.datediff(second, first) / F.lit(DAYS_PER_YEAR)


def epochs(ifgs: DataFrame) -> DataFrame:
    """epoch_idx, date, repeat (uses) and span (years since the first)."""
    dates = ifgs.select(F.explode(F.array("first_date", "second_date")).alias("date"))
    counts = dates.groupBy("date").agg(F.count(F.lit(1)).alias("repeat"))
    every = Window.partitionBy()
    return counts.select((F.dense_rank().over(Window.orderBy("date")) - 1).cast("int").alias("epoch_idx"), "date", "repeat", years(F.min("date").over(every), F.col("date")).alias("span"))


def intervals(epoch: DataFrame) -> DataFrame:
    """epoch_idx and its increment: years since the epoch before it."""
    return epoch.select("epoch_idx", "date", (F.col("span") - F.lag("span").over(Window.orderBy("date"))).alias("increment"))


def indexed(ifgs: DataFrame, epoch: DataFrame) -> DataFrame:
    """ifgs with the indices of their first and second epochs."""
    a = F.broadcast(epoch.select(F.col("date").alias("first_date"), F.col("epoch_idx").alias("first_idx")))
    b = F.broadcast(epoch.select(F.col("date").alias("second_date"), F.col("epoch_idx").alias("second_idx")))
    return ifgs.join(a, "first_date").join(b, "second_date")


def lookup(ifgs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first interferogram of each pair of dates, in either order."""
    key = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    own = ifgs.groupBy(key("first_date", "second_date").alias("pair")).agg(F.min("ifg_id").alias("ifg_id"))
    return pairs.withColumn("pair", key("date1", "date2")).join(F.broadcast(own), "pair", "left").drop("pair")


def members(ifgs: DataFrame, epoch: DataFrame) -> DataFrame:
    """(ifg_id, epoch_idx) for every interval an interferogram spans: epochs
    from its first up to but not including its second."""
    return indexed(ifgs, epoch).select("ifg_id", F.explode(F.sequence(F.col("first_idx"), F.col("second_idx") - 1)).alias("epoch_idx"))


class Union:
    """Disjoint sets of anything hashable."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


@dataclass(frozen=True)
class Tree:
    """A minimum spanning forest: its interferograms, whether it is one tree,
    and its number of trees."""

    ifgs: tuple[Ifg, ...]
    is_tree: bool
    n_trees: int


def spanning_tree(network: Network) -> Tree:
    """By weight, ties by id: the total order makes it unique."""
    sets, kept = Union(), []
    for i in sorted(network.ifgs, key=lambda i: (i.weight, i.ifg_id)):
        if sets.join(i.first, i.second):
            kept.append(i)
    n = len(network.dates) - len(kept)
    return Tree(tuple(sorted(kept)), n == 1, n)


def pixel_stack(phase: DataFrame, n: int) -> DataFrame:
    """(row, col, phase): an array of the n observations of each pixel, in
    order of their ids 0 to n-1, null where there is none. One aggregate
    instead of n joins; a group is a pixel, so it is small."""
    found = phase.filter(F.col("phase").isNotNull()).groupBy("row", "col").agg(F.map_from_entries(F.collect_list(F.struct("ifg_id", "phase"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    return found.select("row", "col", F.transform(every, lambda i: F.try_element_at("m", i)).alias("phase"))


#: Patterns of missing observations whose answers a worker keeps at once.
PATTERNS = 4096


def pixel_trees(stack: DataFrame, network: Network) -> DataFrame:
    """stack with mst (array of booleans): the spanning forest of each pixel's
    own observations. Pixels with the same observations share the answer, which
    a worker computes once for each pattern it meets and keeps for PATTERNS."""
    order = sorted(network.ifgs, key=lambda i: (i.weight, i.ifg_id))
    known: dict[bytes, list[bool]] = {}

    def trees(column):
        import numpy as np
        import pyarrow as pa

        n = len(order)
        flat = column.flatten()
        valid = np.asarray(flat.is_valid()).reshape(-1, n)
        out = np.zeros(valid.shape, bool)
        for r, own in enumerate(valid):
            key = own.tobytes()
            if key not in known:
                sets, kept = Union(), [False] * n
                for i in order:
                    if own[i.ifg_id]:
                        kept[i.ifg_id] = sets.join(i.first, i.second)
                if len(known) >= PATTERNS:
                    known.clear()
                known[key] = kept
            out[r] = known[key]
        ends = np.arange(0, n * (len(valid) + 1), n, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return stack.withColumn("mst", F.arrow_udf(trees, "array<boolean>")("phase"))


def covariance_pattern(ifgs: DataFrame, maxvar: DataFrame) -> DataFrame:
    """Temporal covariance (i, j, value) of all pairs of interferograms: 1 for
    the same pair of epochs, 0.5 where they share their first or their second,
    -0.5 where one begins as the other ends, else 0; times the root of the
    product of their variances. maxvar: ifg_id, maxvar."""
    one = ifgs.select("ifg_id", "first_date", "second_date").join(maxvar, "ifg_id")
    a = one.toDF("i", "fi", "si", "vi")
    b = one.toDF("j", "fj", "sj", "vj")
    theta = (
        F.when((F.col("fi") == F.col("fj")) & (F.col("si") == F.col("sj")), 1.0)
        .when((F.col("fi") == F.col("fj")) | (F.col("si") == F.col("sj")), 0.5)
        .when((F.col("fi") == F.col("sj")) | (F.col("si") == F.col("fj")), -0.5)
        .otherwise(0.0)
    )
    # Both sides have a row for each interferogram of the network.
    return a.join(F.broadcast(b)).select("i", "j", (theta * F.sqrt(F.col("vi") * F.col("vj"))).alias("value"))


def covariance_matrix(network: Network, maxvar: list[float]):
    """The same as a matrix, for kernels."""
    import numpy as np

    n, out = len(network.ifgs), np.zeros((len(network.ifgs),) * 2)
    for i, a in enumerate(network.ifgs):
        for j, b in enumerate(network.ifgs):
            same = (a.first == b.first) + (a.second == b.second)
            out[i, j] = (0.5 * same if same else -0.5 * (a.first == b.second or a.second == b.first)) * np.sqrt(maxvar[i] * maxvar[j])
    assert out.shape == (n, n)
    return out


@dataclass(frozen=True)
class Loop:
    """A closed loop: its interferograms with the sign of their direction."""

    edges: tuple[tuple[Ifg, int], ...]

    @property
    def weight(self) -> int:
        return sum(i.days for i, _ in self.edges)

    def order(self):
        """By weight, then first dates, then second dates."""
        return self.weight, [i.first for i, _ in self.edges], [i.second for i, _ in self.edges]


def cycles(neighbours: dict[int, set[int]], length: int) -> list[list[int]]:
    """Simple cycles of a length, one for each set of vertices: that which
    comes first in lexicographic order from its least vertex. Paths grow a
    vertex at a time, and only through vertices above their start."""
    paths = [[v] for v in sorted(neighbours)]
    for _ in range(length - 1):
        paths = [p + [w] for p in paths for w in sorted(neighbours[p[-1]]) if w > p[0] and w not in p]
    found: dict[frozenset, list[int]] = {}
    for p in paths:
        if p[0] in neighbours[p[-1]]:
            found.setdefault(frozenset(p), p)
    return list(found.values())


def signed_loops(network: Network, longest: int) -> list[Loop]:
    """All loops of 3 to longest interferograms, signed (+1 forward in time)
    and sorted."""
    index, edges, near = network.index(), {}, {}
    for i in network.ifgs:
        a, b = index[i.first], index[i.second]
        edges.setdefault((a, b), i)
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for n in range(3, longest + 1):
        for path in cycles(near, n):
            own = [(edges[min(p), max(p)], 1 if p[1] > p[0] else -1) for p in zip(path, path[1:] + path[:1])]
            out.append(Loop(tuple(sorted(own, key=lambda e: (e[0].first, e[0].second, e[1])))))
    return sorted(out, key=Loop.order)


def limit_redundancy(loops: list[Loop], most: int) -> list[Loop]:
    """In order, loops of which some interferogram has been used `most` times
    or less so far."""
    used: dict[int, int] = {}
    kept = []
    for loop in loops:
        if any(used.get(i.ifg_id, 0) <= most for i, _ in loop.edges):
            kept.append(loop)
            for i, _ in loop.edges:
                used[i.ifg_id] = used.get(i.ifg_id, 0) + 1
    return kept


def loop_table(spark, loops: list[Loop]) -> DataFrame:
    """(loop_id, ifg_id, sign, weight, size) of the edges of the loops."""
    rows = [(n, i.ifg_id, s, loop.weight, len(loop.edges)) for n, loop in enumerate(loops) for i, s in loop.edges]
    return spark.createDataFrame(rows, "loop_id int, ifg_id int, sign int, weight int, size int")


def loops_sql(ifgs: DataFrame, length: int) -> DataFrame:
    """Loops of a length as a plan: paths of `length` epochs by self-joins of
    the edge list, and of each set of epochs the first path. For networks too
    wide for the driver. (path: array of dates.)"""
    edges = ifgs.select(F.col("first_date").alias("a"), F.col("second_date").alias("b"))
    both = edges.union(edges.select("b", "a")).distinct()
    paths = both.filter("b > a").select(F.array("a", "b").alias("path"))
    for _ in range(length - 2):
        near = both.select("a", "b")
        paths = paths.join(near, F.element_at("path", -1) == F.col("a")).filter((F.col("b") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"))
    closed = paths.join(both, (F.element_at("path", -1) == F.col("a")) & (F.element_at("path", 1) == F.col("b")), "left_semi")
    return closed.groupBy(F.array_sort("path").alias("epochs")).agg(F.min("path").alias("path"))


def epoch_baselines(network: Network, bperp: list[float], reference: int = 0) -> list[float]:
    """Baselines of the epochs, that of the reference epoch being 0, from
    those of the interferograms, by least squares."""
    import numpy as np

    index, a = network.index(), np.zeros((len(network.ifgs) + 1, len(network.dates)))
    a[0, reference] = 1
    for r, i in enumerate(network.ifgs, 1):
        a[r, index[i.first]], a[r, index[i.second]] = -1, 1
    return np.linalg.lstsq(a, np.concatenate([[0.0], bperp]), rcond=None)[0].tolist()
