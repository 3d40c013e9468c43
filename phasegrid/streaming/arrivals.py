"""Interferograms that arrive while a network is being processed.

The network's tree, covariance and design matrix are global, so a new epoch
needs the inversion again; what can be kept up to date are sums. A stream of
observations is folded into the normal equations of each pixel's weighted rate,
one small batch at a time, and the rate read from them whenever it is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sums(observations: DataFrame) -> DataFrame:
    """(row, col, sy, ss, n) of observations (row, col, phase, time_span,
    variance). Works on a stream (output mode complete) as on a table."""
    valid = observations.filter(F.col("phase").isNotNull())
    weight = F.col("time_span") / F.col("variance")
    return valid.groupBy("row", "col").agg(F.sum(weight * F.col("phase")).alias("sy"), F.sum(weight * F.col("time_span")).alias("ss"), F.count(F.lit(1)).alias("n"))


def rates(table: DataFrame) -> DataFrame:
    """(row, col, rate, error, samples) from sums."""
    return table.select("row", "col", (F.col("sy") / F.col("ss")).alias("rate"), (1 / F.sqrt("ss")).alias("error"), F.col("n").cast("int").alias("samples"))


def follow(spark, folder: str, table: str, checkpoint: str):
    """Start a query that keeps `table` (in memory) at the sums of all Parquet
    files that arrive in a folder; each file counts once."""
    kind = "row int, col int, phase double, time_span double, variance double"
    stream = spark.readStream.schema(kind).parquet(folder)
    return sums(stream).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
