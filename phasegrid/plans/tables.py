"""The driver's tables read as a stack of interferograms.

An interferogram is a pair of years (of an order and of its shipment), a pixel
one of 12 x 16 cells by part number, and its phase the mean price of the lines
that meet there, in whole thousandths, so that sums of phases are the same in
any order. Every eleventh cell (by a sum over its lines) holds no data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.model import Grid, Network
from phasegrid.operators.network import years

ROWS, COLS = 12, 16
GRID = Grid(ROWS, COLS, 150.9, -34.2, 0.0008, -0.0008, 74.0, 92.0)
WAVELENGTH = 0.0562356424

STACK_SQL = """
cells AS (
  SELECT least(year(o_orderdate), year(l_shipdate)) AS y1, greatest(year(o_orderdate), year(l_shipdate)) AS y2, (l_partkey % 192)::INT AS pix,
    sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS cents, count(*) AS n, sum(l_linenumber)::BIGINT AS ln, sum(floor(l_discount * 100 + 0.5)::BIGINT)::BIGINT AS disc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) <> year(l_shipdate) GROUP BY ALL
),
phase AS (
  SELECT (dense_rank() OVER (ORDER BY y1, y2) - 1)::INT AS ifg_id, (pix // 16)::INT AS "row", (pix % 16)::INT AS col,
    CASE WHEN ln % 11 <> 0 THEN ((cents // n) // 100 - 30000) / 1000.0::DOUBLE END AS phase, (disc // n) / 10.0::DOUBLE AS coh, y1, y2
  FROM cells
),
ifgs AS (
  SELECT DISTINCT ifg_id, make_date(y1, 1 + (y1 * 5) % 12, 1) AS first_date, make_date(y2, 1 + (y2 * 5) % 12, 1) AS second_date,
    date_diff('day', make_date(y1, 1 + (y1 * 5) % 12, 1), make_date(y2, 1 + (y2 * 5) % 12, 1)) / 365.25::DOUBLE AS time_span FROM phase
),
ep AS (SELECT d AS date, (row_number() OVER (ORDER BY d) - 1)::INT AS epoch_idx, count AS repeat, date_diff('day', min(d) OVER (), d) / 365.25::DOUBLE AS span
  FROM (SELECT d, count(*) AS count FROM (SELECT first_date AS d FROM ifgs UNION ALL SELECT second_date FROM ifgs) GROUP BY d))
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each (pair of years, pixel) that has lines."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % (ROWS * COLS)).cast("int").alias("pix"), "l_extendedprice", "l_discount", "l_linenumber", F.year("l_shipdate").alias("ys"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("yo"))
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    near = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("ys <> yo")
    return near.groupBy(F.least("ys", "yo").alias("y1"), F.greatest("ys", "yo").alias("y2"), "pix").agg(F.sum(cents("l_extendedprice")).alias("cents"), F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("ln"), F.sum(cents("l_discount")).alias("disc"))


def _date(y: str):
    return F.make_date(F.col(y), 1 + (F.col(y) * 5) % 12, F.lit(1))


def observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """phase (ifg_id, row, col, phase, coh) and ifgs."""
    found = cells(spark, sf_dir)
    pairs = found.select("y1", "y2").distinct()
    ids = pairs.select("y1", "y2", (F.row_number().over(Window.orderBy("y1", "y2")) - 1).alias("ifg_id"))
    value = F.when(F.col("ln") % 11 != 0, (F.floor(F.floor(F.col("cents") / F.col("n")) / 100) - 30000) / F.lit(1000.0))
    phase = found.join(F.broadcast(ids), ["y1", "y2"]).select("ifg_id", F.floor(F.col("pix") / COLS).cast("int").alias("row"), (F.col("pix") % COLS).alias("col"), value.alias("phase"), (F.floor(F.col("disc") / F.col("n")) / F.lit(10.0)).alias("coh"))
    ifgs = ids.select("ifg_id", _date("y1").alias("first_date"), _date("y2").alias("second_date"))
    return phase, ifgs.withColumn("time_span", years(F.col("first_date"), F.col("second_date"))).withColumn("wavelength", F.lit(WAVELENGTH))


def network(ifgs: DataFrame) -> Network:
    """The few interferograms as a network, weighed by id."""
    rows = [r.asDict() | {"nan_fraction": r["ifg_id"] % 5} for r in ifgs.collect()]
    return Network.of(rows)
