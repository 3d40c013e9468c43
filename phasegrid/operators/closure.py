"""Phase closure: sums around loops, breaches, and masks of bad unwrapping."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.model import Network
from phasegrid.operators.network import limit_redundancy, loop_table, signed_loops


def closures(phase: DataFrame, loops: DataFrame, *, subtract_median: bool = True) -> DataFrame:
    """(loop_id, row, col, closure): the signed sum of a loop's phases in
    radians; null where one is missing; less the loop's median if asked."""
    near = phase.join(F.broadcast(loops), "ifg_id")
    sums = near.groupBy("loop_id", "row", "col").agg(F.sum(F.col("sign") * F.col("phase")).alias("total"), F.count("phase").alias("n"), F.max("size").alias("size"))
    sums = sums.select("loop_id", "row", "col", F.when(F.col("n") == F.col("size"), F.col("total")).alias("closure"))
    if not subtract_median:
        return sums
    # An exact median of each loop; a row for each loop, broadcast back.
    centre = sums.groupBy("loop_id").agg(F.median("closure").alias("centre"))
    return sums.join(F.broadcast(centre), "loop_id").select("loop_id", "row", "col", (F.col("closure") - F.col("centre")).alias("closure"))


def breaches(closure: DataFrame, loops: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(ifg_id, row, col, breaches): loops of an interferogram whose closure
    at the pixel exceeds threshold * pi. No closure is no breach."""
    over = (F.abs("closure") > threshold * math.pi).cast("int")
    near = closure.select("loop_id", "row", "col", F.coalesce(over, F.lit(0)).alias("over")).join(F.broadcast(loops.select("loop_id", "ifg_id")), "loop_id")
    return near.groupBy("ifg_id", "row", "col").agg(F.sum("over").cast("int").alias("breaches"))


def occurrences(loops: DataFrame) -> DataFrame:
    """In how many loops each interferogram is."""
    return loops.groupBy("ifg_id").agg(F.count(F.lit(1)).cast("int").alias("n_loops"))


def dropped(breach: DataFrame, uses: DataFrame, drop_threshold: float, min_loops: int) -> DataFrame:
    """Interferograms of more than min_loops loops where the share of pixels
    that breach all of them exceeds the threshold."""
    share = breach.join(F.broadcast(uses), "ifg_id").groupBy("ifg_id").agg(F.avg((F.col("breaches") == F.col("n_loops")).cast("int")).alias("share"), F.max("n_loops").alias("n_loops"))
    return share.filter((F.col("share") > drop_threshold) & (F.col("n_loops") > min_loops)).select("ifg_id", "share")


def mask(phase: DataFrame, breach: DataFrame, uses: DataFrame) -> DataFrame:
    """Null phases at pixels that breach every loop of their interferogram."""
    bad = breach.join(F.broadcast(uses), "ifg_id").filter(F.col("breaches") == F.col("n_loops")).select("ifg_id", "row", "col", F.lit(True).alias("bad"))
    return phase.join(bad, ["ifg_id", "row", "col"], "left").select("ifg_id", "row", "col", F.when(F.col("bad").isNull(), F.col("phase")).alias("phase"))


@dataclass
class Closure:
    """What the iterated check ends with."""

    network: Network
    phase: DataFrame
    loops: DataFrame
    closure: DataFrame
    breaches: DataFrame


def iterate(phase: DataFrame, network: Network, *, longest: int = 4, redundancy: int = 2, threshold: float = 0.5, drop_threshold: float = 0.5, min_loops: int = 2, subtract_median: bool = True) -> Closure:
    """Drop interferograms that are in no loop or breach too much, until none
    is; then mask the rest. The list only shrinks, so rounds are bounded by
    the number of interferograms."""
    spark, now = phase.sparkSession, network
    while True:
        loops = limit_redundancy(signed_loops(now, longest), redundancy)
        used = {i.ifg_id for loop in loops for i, _ in loop.edges}
        if not used:
            raise ValueError("no closed loop is left")
        table = loop_table(spark, loops)
        rows = phase.filter(F.col("ifg_id").isin(*used))
        found = closures(rows, table, subtract_median=subtract_median)
        breach, uses = breaches(found, table, threshold), occurrences(table)
        gone = {r["ifg_id"] for r in dropped(breach, uses, drop_threshold, min_loops).collect()}
        kept = tuple(i for i in now.ifgs if i.ifg_id in used - gone)
        if len(kept) == len(now.ifgs):
            return Closure(now, mask(rows, breach, uses), table, found, breach)
        now = Network(kept, tuple(sorted({d for i in kept for d in (i.first, i.second)})))
