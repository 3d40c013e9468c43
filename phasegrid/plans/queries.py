"""The engine's operators as queries on the driver's tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions import geometry
from phasegrid.operators import aps, closure, dem, inversion, metadata, network, orbital, rasters, reference, units
from phasegrid.plans.tables import COLS, GRID, ROWS, STACK_SQL, WAVELENGTH, observations, read
from phasegrid.plans.tables import network as network_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def positive_zeros(sql: str) -> str:
    """sql with 0 added to whatever is rounded, as -0 and 0 print apart."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += f"{sql[at:start]}({sql[start:start + 6]}{positive_zeros(sql[start + 6:end - 1])}) + 0)"
        at = end
    return out + sql[at:]


def query(sql: str | None = None, recursive: bool = False):
    """Register a query under its name, and the SQL of its result; the SQL may
    use the tables of STACK_SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            uses = any(f" {t}" in body for t in ("phase", "ifgs", "ep", "cells"))
            head = "WITH " + "RECURSIVE " * recursive
            if body.startswith("WITH "):
                body, glue = body[5:], ", "
            else:
                glue = " "
            body = positive_zeros(body)
            ORACLES[f.__name__] = f"{head}{STACK_SQL.strip()}{glue}{body}" if uses else f"{head}{body}" if glue == ", " else body
        return f

    return register


def solved(rows: str) -> str:
    """SQL of Gauss and Jordan's elimination: of `rows` (key, m: a list of n
    rows of numbers, the right-hand side last; n) the CTE solution (key, x)."""
    return f"""
gj AS (
  SELECT key, n, 1 AS k, m FROM ({rows})
  UNION ALL
  SELECT key, n, k + 1, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 2), lambda j: CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)) FROM gj WHERE k <= n
),
solution AS (SELECT key, list_transform(range(1, n + 1), lambda i: m[i][n + 1]) AS x FROM gj WHERE k = n + 1)
"""


def r(c, n: int = 6):
    """Rounded, so that the order of sums doesn't show: to where the exact
    value is never, or hardly ever, half way."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def stack(spark, sf):
    return observations(spark, sf)


@query("SELECT ifg_id, \"row\", col, round(phase, 6) AS phase, round(coh, 6) AS coh FROM phase")
def observation_stack(spark: SparkSession, sf: str) -> DataFrame:
    """The stack itself: a row for each pixel of each interferogram."""
    phase, _ = stack(spark, sf)
    return phase.select("ifg_id", "row", "col", r("phase").alias("phase"), r("coh").alias("coh"))


@query("SELECT ifg_id, \"row\", col, CASE WHEN abs(coalesce(phase, 0) - 0) > 1e-6 THEN round(phase * (1000 * 0.0562356424::DOUBLE / (4 * pi())), 6) END AS phase FROM phase")
def nodata_and_mm(spark, sf):
    """Nodata as null and radians as millimetres."""
    phase, ifgs = stack(spark, sf)
    zeroed = phase.withColumn("phase", F.coalesce("phase", F.lit(0.0)))
    out = units.convert(zeroed, ifgs.withColumn("units", F.lit("RADIANS")))
    return out.select("ifg_id", "row", "col", r("phase").alias("phase"))


@query(f"SELECT ifg_id, \"row\", col, round(phase * 4 * pi() / (1000 * {WAVELENGTH}::DOUBLE), 6) AS radians FROM phase")
def mm_to_radians(spark, sf):
    phase, ifgs = stack(spark, sf)
    near = phase.join(F.broadcast(ifgs.select("ifg_id", "wavelength")), "ifg_id")
    return near.select("ifg_id", "row", "col", r(units.mm_to_radians(F.col("phase"), F.col("wavelength"))).alias("radians"))


@query("SELECT ifg_id, \"row\", col, CASE WHEN coh >= 0.5 THEN round(phase, 6) END AS phase FROM phase")
def coherence_mask(spark, sf):
    phase, _ = stack(spark, sf)
    out = units.mask_coherence(phase.select("ifg_id", "row", "col", "phase"), phase, 0.5)
    return out.select("ifg_id", "row", "col", r("phase").alias("phase"))


@query('SELECT "row", col, nullif(round(median(coh), 6), 0) AS coh_median, nullif(round(avg(coh), 6), 0) AS coh_mean, nullif(round(stddev_pop(coh), 6), 0) AS coh_std FROM phase GROUP BY ALL')
def coherence_statistics(spark, sf):
    phase, _ = stack(spark, sf)
    return rasters.coherence_stats(phase).select("row", "col", *[r(c).alias(c) for c in ("coh_median", "coh_mean", "coh_std")])


@query("SELECT ifg_id, sum((phase IS NULL)::INT)::BIGINT AS nan_count, round(avg((phase IS NULL)::INT), 6) AS nan_fraction FROM phase GROUP BY ifg_id")
def nan_fractions(spark, sf):
    phase, _ = stack(spark, sf)
    return rasters.nan_fraction(phase).select("ifg_id", "nan_count", r("nan_fraction").alias("nan_fraction"))


@query('SELECT ifg_id, ("row" // 2)::INT AS "row", (col // 3)::INT AS col, CASE WHEN avg((phase IS NULL)::INT) < 0.5 THEN round(avg(phase), 6) END AS phase FROM phase GROUP BY ifg_id, "row" // 2, col // 3')
def multilook(spark, sf):
    phase, _ = stack(spark, sf)
    return rasters.multilook(phase, GRID, 3, 2, 0.5).select("ifg_id", "row", "col", r("phase").alias("phase"))


@query('SELECT ifg_id, ("row" // 5)::INT AS "row", (col // 5)::INT AS col, CASE WHEN avg((phase IS NULL)::INT) < 0.2 THEN round(avg(phase), 9) END AS phase FROM phase WHERE "row" // 5 < 2 AND col // 5 < 3 GROUP BY ifg_id, "row" // 5, col // 5')
def block_mean(spark, sf):
    phase, _ = stack(spark, sf)
    return rasters.multilook(phase, GRID, 5, 5, 0.2, strict=True).select("ifg_id", "row", "col", r("phase", 9).alias("phase"))


@query('SELECT ifg_id, "row" - 2 AS "row", col - 3 AS col, round(phase, 6) AS phase FROM phase WHERE "row" BETWEEN 2 AND 8 AND col BETWEEN 3 AND 11')
def crop(spark, sf):
    phase, _ = stack(spark, sf)
    return rasters.crop(phase, 2, 3, 9, 12).select("ifg_id", "row", "col", r("phase").alias("phase"))


@query('SELECT ifg_id, r2 AS "row", c2 AS col, round(phase, 6) AS phase FROM phase, (SELECT unnest(range(0, 6))::INT AS r2), (SELECT unnest(range(0, 8))::INT AS c2) WHERE "row" = floor((r2 + 0.5) * 2) AND col = floor((c2 + 0.5) * 2)')
def nearest_resample(spark, sf):
    phase, _ = stack(spark, sf)
    return rasters.nearest(phase, 2, 2).select("ifg_id", "row", "col", r("phase").alias("phase"))


@query("SELECT epoch_idx, date, repeat, round(span, 6) AS span FROM ep")
def epochs(spark, sf):
    _, ifgs = stack(spark, sf)
    return network.epochs(ifgs).select("epoch_idx", "date", "repeat", r("span").alias("span"))


@query("SELECT epoch_idx, round(span - lag(span) OVER (ORDER BY date), 6) AS increment FROM ep")
def epoch_increments(spark, sf):
    _, ifgs = stack(spark, sf)
    return network.intervals(network.epochs(ifgs)).select("epoch_idx", r("increment").alias("increment"))


@query("SELECT ifg_id, a.epoch_idx AS first_idx, b.epoch_idx AS second_idx, round(time_span, 6) AS time_span FROM ifgs JOIN ep a ON a.date = first_date JOIN ep b ON b.date = second_date")
def epoch_indices(spark, sf):
    _, ifgs = stack(spark, sf)
    return network.indexed(ifgs, network.epochs(ifgs)).select("ifg_id", "first_idx", "second_idx", r("time_span").alias("time_span"))


@query("SELECT ifg_id, e.epoch_idx FROM ifgs JOIN ep e ON e.date >= first_date AND e.date < second_date")
def epoch_membership(spark, sf):
    _, ifgs = stack(spark, sf)
    return network.members(ifgs, network.epochs(ifgs))


@query("SELECT a.date AS date1, b.date AS date2, min(ifg_id) AS ifg_id FROM ep a JOIN ep b ON a.date <> b.date LEFT JOIN ifgs ON least(a.date, b.date) = first_date AND greatest(a.date, b.date) = second_date GROUP BY ALL")
def date_pair_lookup(spark, sf):
    _, ifgs = stack(spark, sf)
    dates = network.epochs(ifgs).select("date")
    pairs = dates.toDF("date1").join(dates.toDF("date2"), F.col("date1") != F.col("date2"))
    return network.lookup(ifgs, pairs)


PIXELS = """
WITH w AS (SELECT DISTINCT "row", col FROM phase WHERE phase IS NOT NULL),
f AS (SELECT w."row", w.col, ifgs.ifg_id FROM w, ifgs)
SELECT "row", col, list(round(phase, 6) ORDER BY ifg_id) AS phase FROM f LEFT JOIN phase USING ("row", col, ifg_id) GROUP BY ALL
"""


@query(PIXELS)
def pixel_stack(spark, sf):
    phase, ifgs = stack(spark, sf)
    return network.pixel_stack(phase, ifgs.count()).withColumn("phase", F.transform("phase", lambda x: F.round(x, 6)))


VARIANCE = "(1 + ifg_id % 4)::DOUBLE"


@query(f"SELECT a.ifg_id AS i, b.ifg_id AS j, round(CASE WHEN a.first_date = b.first_date AND a.second_date = b.second_date THEN 1.0 WHEN a.first_date = b.first_date OR a.second_date = b.second_date THEN 0.5 WHEN a.first_date = b.second_date OR a.second_date = b.first_date THEN -0.5 ELSE 0 END * sqrt({VARIANCE.replace('ifg_id', 'a.ifg_id')} * {VARIANCE.replace('ifg_id', 'b.ifg_id')}), 6) AS value FROM ifgs a, ifgs b")
def temporal_covariance(spark, sf):
    _, ifgs = stack(spark, sf)
    maxvar = ifgs.select("ifg_id", (1 + F.col("ifg_id") % 4).cast("double").alias("maxvar"))
    return network.covariance_pattern(ifgs, maxvar).select("i", "j", r("value").alias("value"))


REACH = """
e AS (SELECT ifg_id, a.epoch_idx AS u, b.epoch_idx AS v, ifg_id % 5 AS w FROM ifgs JOIN ep a ON a.date = first_date JOIN ep b ON b.date = second_date),
pe AS (SELECT "row", col, e.*, row_number() OVER (PARTITION BY "row", col ORDER BY w, ifg_id) AS pos, phase FROM phase JOIN e USING (ifg_id) WHERE phase IS NOT NULL),
reach AS (
  SELECT "row", col, pos, u AS node FROM pe
  UNION
  SELECT t."row", t.col, t.pos, CASE WHEN pe.u = t.node THEN pe.v ELSE pe.u END FROM reach t JOIN pe ON pe."row" = t."row" AND pe.col = t.col AND pe.pos < t.pos AND (pe.u = t.node OR pe.v = t.node)
),
tree AS (SELECT * FROM pe WHERE NOT EXISTS (SELECT 1 FROM reach t WHERE t."row" = pe."row" AND t.col = pe.col AND t.pos = pe.pos AND t.node = pe.v))
"""


@query(f'WITH {REACH.strip()} SELECT "row", col, ifg_id FROM tree', recursive=True)
def pixel_spanning_trees(spark, sf):
    """Interferograms of each pixel's own minimum spanning forest."""
    phase, ifgs = stack(spark, sf)
    net = network_of(ifgs)
    trees = network.pixel_trees(network.pixel_stack(phase, len(net.ifgs)), net)
    return trees.select("row", "col", F.posexplode("mst").alias("ifg_id", "used")).filter("used").drop("used")


SERIES = f"""
WITH {REACH.strip()},
walk AS (
  SELECT DISTINCT "row", col, 0 AS node, 0.0::DOUBLE AS total FROM tree
  UNION
  SELECT s."row", s.col, CASE WHEN t.u = s.node THEN t.v ELSE t.u END, round(s.total + CASE WHEN t.u = s.node THEN t.phase ELSE -t.phase END, 6)
  FROM walk s JOIN tree t ON t."row" = s."row" AND t.col = s.col AND (t.u = s.node OR t.v = s.node)
),
steps AS (SELECT "row", col, node AS epoch_idx, total - lag(total) OVER (PARTITION BY "row", col ORDER BY node) AS tsincr, total AS tscuml FROM walk),
gaps AS (SELECT epoch_idx, span - lag(span) OVER (ORDER BY epoch_idx) AS gap FROM ep)
SELECT "row", col, epoch_idx::INT AS epoch_idx, round(tsincr / gap, 6) AS velocity, round(tsincr, 6) AS tsincr, round(tscuml, 6) AS tscuml FROM steps JOIN gaps USING (epoch_idx) WHERE epoch_idx > 0
"""


def _series(spark, sf):
    phase, ifgs = stack(spark, sf)
    net = network_of(ifgs)
    trees = network.pixel_trees(network.pixel_stack(phase, len(net.ifgs)), net)
    return inversion.increments(inversion.velocities(trees, net, least=3), net), ifgs, net


@query(SERIES, recursive=True)
def time_series(spark, sf):
    """Velocity, increment and cumulative displacement of each epoch."""
    series, _, _ = _series(spark, sf)
    return series.select("row", "col", "epoch_idx", *[r(c).alias(c) for c in ("velocity", "tsincr", "tscuml")])


#: For pixels whose tree spans all epochs. Least squares with the covariance v
#: of the observations and smoothing g as one symmetric system: v l + b x = d
#: and b' l = g x.
SMOOTHED = f"""
WITH {REACH.strip()},
gap AS (SELECT list(gap ORDER BY epoch_idx) AS gap, count(*) AS n FROM (SELECT epoch_idx, span - lag(span) OVER (ORDER BY epoch_idx) AS gap FROM ep) WHERE gap IS NOT NULL),
w AS (SELECT list(own ORDER BY i) AS w FROM (
  SELECT i, list(value ORDER BY j) AS own FROM (
    SELECT a.ifg_id AS i, b.ifg_id AS j, (0.5 * ((a.first_date = b.first_date)::INT + (a.second_date = b.second_date)::INT) - 0.5 * (a.first_date = b.second_date OR a.second_date = b.first_date)::INT) * sqrt({VARIANCE.replace("ifg_id", "a.ifg_id")} * {VARIANCE.replace("ifg_id", "b.ifg_id")}) AS value FROM ifgs a, ifgs b) GROUP BY i)),
g AS (SELECT list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j:
    (CASE WHEN i = 1 THEN 1 ELSE -1.0 / (n - 1) END * CASE WHEN j = 1 THEN 1 ELSE -1.0 / (n - 1) END + CASE WHEN i = n THEN 1 ELSE -1.0 / (n - 1) END * CASE WHEN j = n THEN 1 ELSE -1.0 / (n - 1) END
    + 0.01::DOUBLE * CASE WHEN i = j THEN CASE WHEN i IN (1, n) THEN 1 ELSE 2 END WHEN abs(i - j) = 1 THEN -1 ELSE 0 END)::DOUBLE)) AS g FROM gap),
o AS (SELECT "row", col, list(ifg_id + 1 ORDER BY ifg_id) AS ids, list(u ORDER BY ifg_id) AS us, list(v ORDER BY ifg_id) AS vs, list(phase ORDER BY ifg_id) AS d FROM tree GROUP BY ALL),
{solved("""SELECT "row" * 1000 + col AS key, 2 * n AS n, list_concat(
    list_transform(range(1, n + 1), lambda i: list_concat(list_transform(ids, lambda j: w[ids[i]][j]), list_transform(range(1, n + 1), lambda c: CASE WHEN us[i] < c AND c <= vs[i] THEN gap[c] ELSE 0 END), [d[i]])),
    list_transform(range(1, n + 1), lambda c: list_concat(list_transform(range(1, n + 1), lambda i: CASE WHEN us[i] < c AND c <= vs[i] THEN gap[c] ELSE 0 END), list_transform(range(1, n + 1), lambda j: -g[c][j]), [0.0::DOUBLE]))) AS m
  FROM o, w, g, gap WHERE len(ids) = n""").strip()}
SELECT key // 1000 AS "row", key % 1000 AS col, c::INT AS epoch_idx, round(list_sum(list_transform(range(1, c + 1), lambda i: x[n + i] * gap[i])), 4) AS tscuml
FROM (SELECT key, x, gap, n, unnest(range(1, n + 1)) AS c FROM solution, gap)
"""


@query(SMOOTHED, recursive=True)
def time_series_laplacian(spark, sf):
    """The same by smoothing."""
    phase, ifgs = stack(spark, sf)
    net = network_of(ifgs)
    vcm = network.covariance_matrix(net, [1.0 + i.ifg_id % 4 for i in net.ifgs])
    trees = network.pixel_trees(network.pixel_stack(phase, len(net.ifgs)), net)
    found = inversion.increments(inversion.velocities(trees, net, method=1, least=3, vcm=vcm), net)
    return found.select("row", "col", "epoch_idx", r("tscuml", 4).alias("tscuml"))


LINEAR = """
WITH c AS (SELECT ifg_id FROM ifgs JOIN ep a ON a.date = first_date JOIN ep b ON b.date = second_date WHERE b.epoch_idx = a.epoch_idx + 1),
k AS (SELECT p."row", p.col, b.epoch_idx, p.phase FROM phase p JOIN c USING (ifg_id) JOIN ifgs USING (ifg_id) JOIN ep b ON b.date = second_date),
s AS (SELECT "row", col, epoch_idx, CASE WHEN count(*) FILTER (phase IS NULL) OVER w = 0 THEN sum(phase) OVER w END AS tscuml FROM k WINDOW w AS (PARTITION BY "row", col ORDER BY epoch_idx ROWS UNBOUNDED PRECEDING)),
z AS (SELECT "row", col, epoch_idx, tscuml FROM s UNION ALL SELECT DISTINCT "row", col, 0, 0.0::DOUBLE FROM s)
"""


def _sequential(spark, sf):
    """Increments of consecutive epochs, the network whose design matrix is
    diagonal, cumulated, with a zero epoch before."""
    phase, ifgs = stack(spark, sf)
    near = network.indexed(ifgs, network.epochs(ifgs)).filter("second_idx = first_idx + 1").select("ifg_id", F.col("second_idx").alias("epoch_idx"))
    rows = phase.join(F.broadcast(near), "ifg_id").select("row", "col", "epoch_idx", F.col("phase").alias("tsincr"))
    return rows.withColumn("tscuml", inversion.cumulated("tsincr")), network.epochs(ifgs)


@query(LINEAR + 'SELECT "row", col, epoch_idx::INT AS epoch_idx, round(tscuml, 6) AS tscuml FROM z')
def cumulative_series(spark, sf):
    series, _ = _sequential(spark, sf)
    return inversion.with_zero_epoch(series).select("row", "col", "epoch_idx", r("tscuml").alias("tscuml"))


@query(
    LINEAR
    + """, g AS (SELECT "row", col, regr_slope(tscuml, span) AS rate, regr_intercept(tscuml, span) AS intercept, regr_r2(tscuml, span) AS r2, regr_sxx(tscuml, span) AS sxx, regr_syy(tscuml, span) AS syy, regr_sxy(tscuml, span) AS sxy, regr_count(tscuml, span) AS n FROM z JOIN ep USING (epoch_idx) GROUP BY "row", col)
SELECT "row", col, CASE WHEN n > 1 THEN round(rate, 6) END AS rate, CASE WHEN n > 1 THEN round(intercept, 6) END AS intercept, CASE WHEN n > 1 THEN round(CASE WHEN syy = 0 THEN 0 ELSE r2 END, 6) END AS r2,
  CASE WHEN n > 2 THEN round(2 * sqrt(greatest(syy - sxy * sxy / sxx, 0) / sxx / (n - 2)), 6) WHEN n = 2 THEN 0 END AS error, CASE WHEN n > 1 THEN n::BIGINT END AS samples FROM g"""
)
def linear_rate(spark, sf):
    """The flagship: rate, error and fit of each pixel's cumulative series."""
    series, epoch = _sequential(spark, sf)
    out = inversion.linear_rate(inversion.with_zero_epoch(series), epoch, nsig=2.0)
    return out.select("row", "col", *[r(c).alias(c) for c in ("rate", "intercept", "r2", "error")], "samples")


def _products(terms: list[str], value: str) -> str:
    """SQL of the normal equations of a model with these terms."""
    return "[" + ", ".join("[" + ", ".join(f"sum(({a}) * ({b}))" for b in [*terms, value]) + "]" for a in terms) + "]"


@query(
    LINEAR
    + f""", q AS (SELECT "row", col, count(tscuml) AS n, {_products(["1.0::DOUBLE", "span", "sin(2 * pi() * span)", "cos(2 * pi() * span)"], "tscuml")} AS m FROM z JOIN ep USING (epoch_idx) WHERE tscuml IS NOT NULL GROUP BY "row", col),
{solved('SELECT "row" * 1000 + col AS key, m, 4::BIGINT AS n FROM q WHERE n >= 4').strip()}
SELECT "row", col, CASE WHEN n >= 4 THEN list_transform(x, lambda v: round(v, 4)) END AS coefficients FROM q LEFT JOIN solution ON key = "row" * 1000 + col""",
    recursive=True,
)
def annual_trend(spark, sf):
    """Coefficients of a line and a yearly cycle."""
    series, epoch = _sequential(spark, sf)
    out = inversion.trend(inversion.with_zero_epoch(series), epoch, "annual_linear")
    return out.select("row", "col", F.transform("coefficients", lambda x: F.round(x, 4)).alias("coefficients"))


@query(LINEAR + ', q AS (SELECT "row", col, count(tscuml) AS n, sum(span) AS t1, sum(span * span) AS t2, sum(span * span * span) AS t3, sum(span * span * span * span) AS t4, sum(tscuml) AS y, sum(tscuml * span) AS ty, sum(tscuml * span * span) AS tty FROM z JOIN ep USING (epoch_idx) WHERE tscuml IS NOT NULL GROUP BY "row", col), d AS (SELECT *, n * (t2 * t4 - t3 * t3) - t1 * (t1 * t4 - t2 * t3) + t2 * (t1 * t3 - t2 * t2) AS det FROM q) SELECT "row", col, CASE WHEN n >= 3 THEN round((n * (t2 * tty - t3 * ty) - t1 * (t1 * tty - t2 * ty) + y * (t1 * t3 - t2 * t2)) / det, 4) END AS curvature FROM d')
def quadratic_trend(spark, sf):
    series, epoch = _sequential(spark, sf)
    out = inversion.trend(inversion.with_zero_epoch(series), epoch, "quadratic")
    return out.select("row", "col", r(F.col("coefficients")[2], 4).alias("curvature"))


#: Whitening from the last observation to the first, of spans and phases at
#: once; the worst residual goes until none is above the limit.
ROBUST = f"""
WITH {REACH.strip()},
w AS (SELECT list(own ORDER BY i) AS w FROM (
  SELECT i, list(value ORDER BY j) AS own FROM (
    SELECT a.ifg_id AS i, b.ifg_id AS j, (0.5 * ((a.first_date = b.first_date)::INT + (a.second_date = b.second_date)::INT) - 0.5 * (a.first_date = b.second_date OR a.second_date = b.first_date)::INT) * sqrt({VARIANCE.replace("ifg_id", "a.ifg_id")} * {VARIANCE.replace("ifg_id", "b.ifg_id")}) AS value FROM ifgs a, ifgs b) GROUP BY i)),
o AS (SELECT "row", col, list(ifg_id + 1 ORDER BY ifg_id) AS ids, list(time_span ORDER BY ifg_id) AS s0, list(tree.phase ORDER BY ifg_id) AS y0 FROM tree JOIN ifgs USING (ifg_id) GROUP BY ALL),
st AS (
  SELECT "row", col, len(ids) AS n0, ids, s0, y0, len(ids) AS k, list_transform(ids, lambda i: list_transform(ids, lambda j: w[i][j])) AS v, s0 AS s, y0 AS y, []::DOUBLE[] AS zs, []::DOUBLE[] AS zy FROM o, w
  UNION ALL
  SELECT "row", col, n0, kept, list_transform(left_over, lambda i: s0[i]), list_transform(left_over, lambda i: y0[i]), CASE WHEN k > 0 THEN k - 1 ELSE len(kept) END,
    CASE WHEN k > 0 THEN list_transform(range(1, k), lambda i: list_transform(range(1, k), lambda j: v[i][j] - v[i][k] * v[k][j] / v[k][k])) ELSE list_transform(kept, lambda i: list_transform(kept, lambda j: w[i][j])) END,
    CASE WHEN k > 0 THEN list_transform(range(1, k), lambda i: s[i] - v[i][k] / v[k][k] * s[k]) ELSE list_transform(left_over, lambda i: s0[i]) END,
    CASE WHEN k > 0 THEN list_transform(range(1, k), lambda i: y[i] - v[i][k] / v[k][k] * y[k]) ELSE list_transform(left_over, lambda i: y0[i]) END,
    CASE WHEN k > 0 THEN list_prepend(s[k] / sqrt(v[k][k]), zs) ELSE [] END, CASE WHEN k > 0 THEN list_prepend(y[k] / sqrt(v[k][k]), zy) ELSE [] END
  FROM (SELECT *, list_transform(left_over, lambda i: ids[i]) AS kept
    FROM (SELECT *, list_filter(range(1, len(ids) + 1), lambda i: k > 0 OR i <> list_position(far, list_max(far))) AS left_over
      FROM (SELECT *, list_transform(range(1, len(zs) + 1), lambda i: abs(zs[i] * list_dot_product(zs, zy) / list_dot_product(zs, zs) - zy[i])) AS far FROM st)
      WHERE k > 0 OR (list_max(far) > 50 AND len(ids) >= 3))), w
),
f AS (SELECT *, list_dot_product(zs, zs) AS norm, list_max(list_transform(range(1, len(zs) + 1), lambda i: abs(zs[i] * list_dot_product(zs, zy) / list_dot_product(zs, zs) - zy[i]))) AS worst FROM st WHERE k = 0)
SELECT "row", col, CASE WHEN len(ids) >= 3 THEN round(list_dot_product(zs, zy) / norm, 6) END AS rate, CASE WHEN len(ids) >= 3 THEN round(1 / sqrt(norm), 6) END AS error, CASE WHEN len(ids) >= 3 THEN len(ids) ELSE n0 END::INT AS samples
FROM f WHERE len(ids) < 3 OR worst <= 50
"""


@query(ROBUST, recursive=True)
def stack_rate(spark, sf):
    """Robust weighted rate of each pixel over its spanning tree."""
    phase, ifgs = stack(spark, sf)
    net = network_of(ifgs)
    vcm = network.covariance_matrix(net, [1.0 + i.ifg_id % 4 for i in net.ifgs])
    trees = network.pixel_trees(network.pixel_stack(phase, len(net.ifgs)), net)
    out = inversion.stacked_rate(trees, net, vcm, nsig=50.0)
    return out.select("row", "col", r("rate").alias("rate"), r("error").alias("error"), "samples")


@query(f'WITH v AS (SELECT ifg_id, time_span, {VARIANCE} AS variance FROM ifgs) SELECT "row", col, round(sum(time_span * phase / variance) / sum(time_span * time_span / variance), 6) AS rate, round(1 / sqrt(sum(time_span * time_span / variance)), 6) AS error, count(*)::INT AS samples FROM phase JOIN v USING (ifg_id) WHERE phase IS NOT NULL GROUP BY "row", col')
def weighted_rate(spark, sf):
    phase, ifgs = stack(spark, sf)
    out = inversion.weighted_rate(phase, ifgs.withColumn("variance", (1 + F.col("ifg_id") % 4).cast("double")))
    return out.select("row", "col", r("rate").alias("rate"), r("error").alias("error"), "samples")


@query(f'WITH v AS (SELECT ifg_id, time_span, {VARIANCE} AS variance FROM ifgs), w AS (SELECT "row", col, sum(time_span * phase / variance) / sum(time_span * time_span / variance) AS rate, 1 / sqrt(sum(time_span * time_span / variance)) AS error FROM phase JOIN v USING (ifg_id) WHERE phase IS NOT NULL GROUP BY "row", col) SELECT "row", col, CASE WHEN error <= 0.105 THEN round(rate, 6) END AS rate, CASE WHEN error <= 0.105 THEN round(error, 6) END AS error FROM w')
def masked_rate(spark, sf):
    phase, ifgs = stack(spark, sf)
    rates = inversion.weighted_rate(phase, ifgs.withColumn("variance", (1 + F.col("ifg_id") % 4).cast("double"))).drop("samples")
    return units.mask_rate(rates, 0.105).select("row", "col", r("rate").alias("rate"), r("error").alias("error"))


LOS = "WITH g AS (SELECT \"row\", col, radians(20 + 1.5::DOUBLE * \"row\" + 0.5::DOUBLE * col) AS incidence FROM (SELECT DISTINCT \"row\", col FROM phase)) "


def _incidence(phase):
    return phase.select("row", "col").distinct().withColumn("incidence", F.radians(F.lit(20.0) + 1.5 * F.col("row") + 0.5 * F.col("col")))


@query(LOS + 'SELECT ifg_id, "row", col, round(-phase / cos(incidence), 6) AS vertical, round(-phase / sin(incidence), 6) AS horizontal FROM phase JOIN g USING ("row", col)')
def los_projection(spark, sf):
    phase, _ = stack(spark, sf)
    g = _incidence(phase)
    base = phase.select("ifg_id", "row", "col", F.col("phase").alias("vertical"), F.col("phase").alias("horizontal"))
    out = units.project(units.project(base, g, "vertical", -1, value="vertical"), g, "horizontal", -1, value="horizontal")
    return out.select("ifg_id", "row", "col", r("vertical").alias("vertical"), r("horizontal").alias("horizontal"))


@query(LOS + 'SELECT ifg_id, "row", col, round(phase * sin(incidence) * sin(0.3::DOUBLE), 6) AS east, round(phase * sin(incidence) * cos(0.3::DOUBLE), 6) AS north, round(phase * cos(incidence), 6) AS up FROM phase JOIN g USING ("row", col)')
def los_components(spark, sf):
    phase, _ = stack(spark, sf)
    near = phase.join(_incidence(phase), ["row", "col"]).withColumn("v", units.los_components(F.col("phase"), units.unit_vector(F.col("incidence"), F.lit(0.3))))
    return near.select("ifg_id", "row", "col", *[r(F.col("v")[c]).alias(c) for c in ("east", "north", "up")])


@query('SELECT a."row", a.col, CASE WHEN a.phase IS NOT NULL AND b.phase IS NOT NULL THEN round(a.phase * 2 - b.phase + 1, 6) END AS value FROM phase a JOIN phase b USING ("row", col) WHERE a.ifg_id = 0 AND b.ifg_id = 1')
def raster_calculator(spark, sf):
    phase, _ = stack(spark, sf)
    band = lambda i: phase.filter(F.col("ifg_id") == i).select("row", "col", F.col("phase").alias("value"))
    return units.calculate({"A": band(0), "B": band(1)}, "A * 2 - B + 1").select("row", "col", r("value").alias("value"))


@query('SELECT y::INT AS y, x::INT AS x, CASE WHEN bool_and(n > 4) THEN round(avg(sd), 6) END AS score FROM (SELECT y, x, ifg_id, stddev_pop(phase) AS sd, count(phase) AS n FROM phase, (SELECT unnest([1, 4, 7, 10]) AS y), (SELECT unnest([1, 6, 11]) AS x) WHERE abs("row" - y) <= 1 AND abs(col - x) <= 1 GROUP BY ALL) GROUP BY y, x')
def reference_scores(spark, sf):
    """Deviation around the candidates of the reference pixel."""
    phase, _ = stack(spark, sf)
    places = reference.candidates(GRID, 3, 4, 3)
    return reference.scores(phase, places, 3, 4 / 9).select("y", "x", r("score").alias("score"))


@query('SELECT y, x FROM (SELECT y::INT AS y, x::INT AS x, CASE WHEN bool_and(n > 3) THEN round(avg(sd), 6) END AS score FROM (SELECT y, x, ifg_id, stddev_pop(phase) AS sd, count(phase) AS n FROM phase, (SELECT unnest([1, 4, 7, 10]) AS y), (SELECT unnest([1, 6, 11]) AS x) WHERE abs("row" - y) <= 1 AND abs(col - x) <= 1 GROUP BY ALL) GROUP BY y, x) WHERE score IS NOT NULL ORDER BY score, y, x LIMIT 1')
def reference_pixel(spark, sf):
    phase, _ = stack(spark, sf)
    found = reference.scores(phase, reference.candidates(GRID, 3, 4, 3), 3, 3 / 9)
    return reference.best(found.withColumn("score", F.round("score", 6))).select("y", "x")


@query('SELECT ifg_id, round(median(phase), 6) AS ref FROM phase JOIN (SELECT "row", col FROM phase GROUP BY ALL HAVING bool_and(phase IS NOT NULL)) USING ("row", col) GROUP BY ifg_id')
def reference_phase_image(spark, sf):
    phase, _ = stack(spark, sf)
    return reference.phase_by_image(phase).select("ifg_id", r("ref").alias("ref"))


@query('WITH m AS (SELECT ifg_id, median(phase) AS ref FROM phase WHERE abs("row" - 6) <= 2 AND abs(col - 8) <= 2 GROUP BY ifg_id) SELECT ifg_id, "row", col, round(phase - ref, 6) AS phase FROM phase JOIN m USING (ifg_id)')
def reference_phase_chip(spark, sf):
    phase, _ = stack(spark, sf)
    ref = reference.phase_by_chip(phase, 6, 8, 5, 0.2)
    return reference.subtract(phase, ref).select("ifg_id", "row", "col", r("phase").alias("phase"))


@query('SELECT ifg_id, round(avg(phase), 9) AS mean, round(stddev_pop(phase), 6) AS std FROM phase WHERE abs("row" - 6) <= 2 AND abs(col - 8) <= 2 GROUP BY ifg_id')
def reference_area(spark, sf):
    phase, _ = stack(spark, sf)
    return reference.area_stats(phase, 6, 8, 5).select("ifg_id", r("mean", 9).alias("mean"), r("std").alias("std"))


PLANE = """
WITH t AS (SELECT *, (col + 1) * 74.0::DOUBLE AS x, ("row" + 1) * 92.0::DOUBLE AS y FROM phase),
m AS (SELECT ifg_id, count(*) AS n, regr_sxx(phase, x) AS xx, regr_sxx(phase, y) AS yy, regr_sxy(x, y) AS xy, regr_sxy(phase, x) AS px, regr_sxy(phase, y) AS py, avg(x) AS mx, avg(y) AS my, avg(phase) AS mp FROM t WHERE phase IS NOT NULL GROUP BY ifg_id),
c AS (SELECT *, (px * yy - py * xy) / (xx * yy - xy * xy) AS a, (py * xx - px * xy) / (xx * yy - xy * xy) AS b FROM m)
"""


@query(PLANE + 'SELECT ifg_id, "row", col, round(mp + a * (x - mx) + b * (y - my), 5) AS orbit, round(phase - (mp + a * (x - mx) + b * (y - my)), 5) AS phase FROM t JOIN c USING (ifg_id)')
def orbital_planar(spark, sf):
    """A plane fitted to each interferogram, and what is left."""
    phase, _ = stack(spark, sf)
    out = orbital.independent(phase, GRID, "planar")
    return out.select("ifg_id", "row", "col", r("orbit", 5).alias("orbit"), r(F.col("phase") - F.col("orbit"), 5).alias("phase"))


QUADRATIC = ["x * x", "y * y", "x * y", "x", "y", "1.0::DOUBLE"]


@query(
    f"""WITH t AS (SELECT ifg_id, "row", col, phase, (col - 7.5::DOUBLE) / 8 AS x, ("row" - 5.5::DOUBLE) / 6 AS y FROM phase),
q AS (SELECT ifg_id, {_products(QUADRATIC, "phase")} AS m FROM t WHERE phase IS NOT NULL GROUP BY ifg_id),
{solved("SELECT ifg_id AS key, m, 6::BIGINT AS n FROM q").strip()},
f AS (SELECT ifg_id, "row", col, phase - (s.x[1] * t.x * t.x + s.x[2] * t.y * t.y + s.x[3] * t.x * t.y + s.x[4] * t.x + s.x[5] * t.y + s.x[6]) AS left_over FROM t JOIN solution s ON key = ifg_id),
d AS (SELECT ifg_id, median(left_over) AS shift FROM f GROUP BY ifg_id)
SELECT ifg_id, "row", col, round(left_over + shift, 3) AS phase FROM f JOIN d USING (ifg_id)""",
    recursive=True,
)
def orbital_quadratic(spark, sf):
    phase, _ = stack(spark, sf)
    out = orbital.corrected(orbital.independent(phase, GRID, "quadratic", offset=True))
    return out.select("ifg_id", "row", "col", r("phase", 3).alias("phase"))


#: In a tree each interferogram's own ramp is the difference of its epochs'.
NETWORK = PLANE.rstrip() + """,
e AS (SELECT ifg_id, a.epoch_idx AS u, b.epoch_idx AS v, row_number() OVER (ORDER BY ifg_id % 5, ifg_id) AS pos FROM ifgs JOIN ep a ON a.date = first_date JOIN ep b ON b.date = second_date),
reach AS (SELECT pos, u AS node FROM e UNION SELECT t.pos, CASE WHEN e.u = t.node THEN e.v ELSE e.u END FROM reach t JOIN e ON e.pos < t.pos AND (e.u = t.node OR e.v = t.node)),
tree AS (SELECT u, v, a, b, mp - a * mx - b * my AS c FROM e JOIN c USING (ifg_id) WHERE NOT EXISTS (SELECT 1 FROM reach t WHERE t.pos = e.pos AND t.node = e.v)),
walk AS (
  SELECT 0 AS node, -1 AS before, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c
  UNION ALL
  SELECT CASE WHEN t.u = w.node THEN t.v ELSE t.u END, w.node, w.a + CASE WHEN t.u = w.node THEN t.a ELSE -t.a END, w.b + CASE WHEN t.u = w.node THEN t.b ELSE -t.b END, w.c + CASE WHEN t.u = w.node THEN t.c ELSE -t.c END
  FROM walk w JOIN tree t ON (t.u = w.node AND t.v <> w.before) OR (t.v = w.node AND t.u <> w.before)
),
d AS (SELECT ifg_id, s.a - f.a AS a, s.b - f.b AS b, s.c - f.c AS c FROM e JOIN walk f ON f.node = e.u JOIN walk s ON s.node = e.v)
SELECT ifg_id, "row", col, round(phase - (d.a * x + d.b * y + d.c), 4) AS phase FROM t JOIN d USING (ifg_id)
"""


@query(NETWORK, recursive=True)
def orbital_network(spark, sf):
    phase, ifgs = stack(spark, sf)
    out = orbital.corrected(orbital.by_network(phase, GRID, network_of(ifgs), "planar"))
    return out.select("ifg_id", "row", "col", r("phase", 4).alias("phase"))


TRIANGLES = """
WITH e AS (SELECT ifg_id, a.epoch_idx AS u, b.epoch_idx AS v, date_diff('day', first_date, second_date) AS days FROM ifgs JOIN ep a ON a.date = first_date JOIN ep b ON b.date = second_date),
l AS (SELECT x.u AS p, x.v AS q, y.v AS z, x.ifg_id AS i, y.ifg_id AS j, w.ifg_id AS k, x.days + y.days + w.days AS weight FROM e x JOIN e y ON y.u = x.v JOIN e w ON w.u = x.u AND w.v = y.v),
o AS (SELECT *, (row_number() OVER (ORDER BY weight, p, q, z) - 1)::INT AS loop_id FROM l),
ed AS (SELECT loop_id, i AS ifg_id, 1 AS sign FROM o UNION ALL SELECT loop_id, j, 1 FROM o UNION ALL SELECT loop_id, k, -1 FROM o),
cl0 AS (SELECT loop_id, "row", col, CASE WHEN count(phase) = 3 THEN sum(sign * phase) END AS c FROM phase JOIN ed USING (ifg_id) GROUP BY ALL),
cl AS (SELECT loop_id, "row", col, c - median(c) OVER (PARTITION BY loop_id) AS closure FROM cl0),
br AS (SELECT ifg_id, "row", col, sum(coalesce(abs(closure) > 0.5 * pi(), false)::INT)::INT AS breaches FROM cl JOIN ed USING (loop_id) GROUP BY ALL),
oc AS (SELECT ifg_id, count(*)::INT AS n_loops FROM ed GROUP BY ifg_id)
"""


def _loops(spark, sf):
    phase, ifgs = stack(spark, sf)
    loops = network.loop_table(spark, network.signed_loops(network_of(ifgs), 3))
    return phase, loops, closure.closures(phase, loops)


@query(TRIANGLES + "SELECT p::INT AS p, q::INT AS q, z::INT AS z, weight::INT AS weight FROM l")
def loops_of_three(spark, sf):
    """Loops by self-joins of the edge list."""
    _, ifgs = stack(spark, sf)
    epoch = network.epochs(ifgs).select("date", "epoch_idx")
    found = network.loops_sql(ifgs, 3).select("epochs")
    for i, name in enumerate(("p", "q", "z")):
        found = found.withColumn("date", F.col("epochs")[i]).join(F.broadcast(epoch), "date").withColumnRenamed("epoch_idx", name).drop("date")
    return found.select("p", "q", "z", (2 * F.datediff(F.col("epochs")[2], F.col("epochs")[0])).alias("weight"))


@query(TRIANGLES + "SELECT loop_id, ifg_id, sign::INT AS sign, weight::INT AS weight FROM ed JOIN o USING (loop_id)")
def signed_loops(spark, sf):
    _, ifgs = stack(spark, sf)
    return network.loop_table(spark, network.signed_loops(network_of(ifgs), 3)).drop("size")


@query(TRIANGLES + 'SELECT loop_id, "row", col, round(closure, 6) AS closure FROM cl')
def phase_closure(spark, sf):
    _, _, found = _loops(spark, sf)
    return found.select("loop_id", "row", "col", r("closure").alias("closure"))


@query(TRIANGLES + 'SELECT ifg_id, "row", col, breaches FROM br')
def closure_breaches(spark, sf):
    _, loops, found = _loops(spark, sf)
    return closure.breaches(found, loops)


@query(TRIANGLES + "SELECT ifg_id, n_loops FROM oc")
def loop_occurrences(spark, sf):
    _, loops, _ = _loops(spark, sf)
    return closure.occurrences(loops)


@query(TRIANGLES + "SELECT ifg_id, round(avg((breaches = n_loops)::INT), 6) AS share FROM br JOIN oc USING (ifg_id) GROUP BY ifg_id HAVING avg((breaches = n_loops)::INT) > 0.2 AND max(n_loops) > 2")
def closure_drops(spark, sf):
    _, loops, found = _loops(spark, sf)
    out = closure.dropped(closure.breaches(found, loops), closure.occurrences(loops), 0.2, 2)
    return out.select("ifg_id", r("share").alias("share"))


@query(TRIANGLES + 'SELECT p.ifg_id, p."row", p.col, CASE WHEN breaches = n_loops THEN NULL ELSE round(phase, 6) END AS phase FROM phase p LEFT JOIN br USING (ifg_id, "row", col) LEFT JOIN oc USING (ifg_id)')
def closure_mask(spark, sf):
    phase, loops, found = _loops(spark, sf)
    out = closure.mask(phase, closure.breaches(found, loops), closure.occurrences(loops))
    return out.select("ifg_id", "row", "col", r("phase").alias("phase"))


@query()
def closure_iterated(spark, sf):
    """The closure check repeated until no interferogram is dropped."""
    phase, ifgs = stack(spark, sf)
    out = closure.iterate(phase.select("ifg_id", "row", "col", "phase"), network_of(ifgs), threshold=8.0, min_loops=2)
    return out.phase.select("ifg_id", "row", "col", r("phase").alias("phase"))


BPERP = "WITH b AS (SELECT ifg_id, \"row\", col, ((ifg_id * 37) % 101 - 50) + 0.1::DOUBLE * col AS bperp FROM phase) "


def _bperp(phase):
    return phase.select("ifg_id", "row", "col", ((F.col("ifg_id") * 37) % 101 - 50 + F.lit(0.1) * F.col("col")).alias("bperp"))


DEM = (
    BPERP
    + ', s AS (SELECT "row", col, count(*) AS n, regr_sxx(phase, bperp) AS bb, regr_sxx(phase, time_span) AS tt, regr_sxy(bperp, time_span) AS bt, regr_sxy(phase, bperp) AS yb, regr_sxy(phase, time_span) AS yt FROM phase JOIN b USING (ifg_id, "row", col) JOIN ifgs USING (ifg_id) WHERE phase IS NOT NULL GROUP BY "row", col), f AS (SELECT "row", col, CASE WHEN n >= 10 THEN (yb * tt - yt * bt) / (bb * tt - bt * bt) END AS slope, CASE WHEN n >= 10 THEN (yt * bb - yb * bt) / (bb * tt - bt * bt) END AS velocity FROM s) '
)


@query(DEM + 'SELECT "row", col, round(slope, 6) AS slope, round(velocity, 6) AS velocity, round(slope * (800000 + 10 * col) * sin(0.4::DOUBLE) * -0.001, 5) AS dem_error FROM f')
def dem_error(spark, sf):
    phase, ifgs = stack(spark, sf)
    fitted = dem.fit(phase.select("ifg_id", "row", "col", "phase"), _bperp(phase), ifgs)
    geo = phase.select("row", "col").distinct().select("row", "col", (F.lit(800000.0) + 10 * F.col("col")).alias("range_dist"), F.lit(0.4).alias("look_angle"))
    out = fitted.join(dem.errors(fitted, geo), ["row", "col"])
    return out.select("row", "col", r("slope").alias("slope"), r("velocity").alias("velocity"), r("dem_error", 5).alias("dem_error"))


@query(DEM + 'SELECT ifg_id, "row", col, round(phase - slope * bperp, 6) AS phase FROM phase JOIN b USING (ifg_id, "row", col) LEFT JOIN f USING ("row", col)')
def dem_corrected(spark, sf):
    phase, ifgs = stack(spark, sf)
    own = phase.select("ifg_id", "row", "col", "phase")
    return dem.correct(own, _bperp(phase), dem.fit(own, _bperp(phase), ifgs)).select("ifg_id", "row", "col", r("phase").alias("phase"))


@query(BPERP + 'SELECT ifg_id, round(avg(m), 6) AS bperp FROM (SELECT ifg_id, avg(bperp) AS m FROM b GROUP BY ifg_id, "row" // 6, col // 8) GROUP BY ifg_id')
def mean_baseline(spark, sf):
    phase, _ = stack(spark, sf)
    return dem.mean_baseline(rasters.with_tiles(_bperp(phase), rasters.tiles(ROWS, COLS, 2, 2))).select("ifg_id", r("bperp").alias("bperp"))


FILTER = LINEAR + ', i AS (SELECT "row", col, epoch_idx, phase AS v FROM k), t AS (SELECT epoch_idx, lag(span) OVER (ORDER BY epoch_idx) + (span - lag(span) OVER (ORDER BY epoch_idx)) / 2 AS t FROM ep) '


@query(FILTER + 'SELECT a."row", a.col, a.epoch_idx::INT AS epoch_idx, round(any_value(a.v) - sum(b.v * exp(-0.5 * ((tb.t - ta.t) / (600 / 365.25::DOUBLE)) ** 2)) / sum(exp(-0.5 * ((tb.t - ta.t) / (600 / 365.25::DOUBLE)) ** 2)), 6) AS high FROM i a JOIN t ta USING (epoch_idx) JOIN i b ON a."row" = b."row" AND a.col = b.col AND b.v IS NOT NULL AND a.v IS NOT NULL JOIN t tb ON tb.epoch_idx = b.epoch_idx GROUP BY a."row", a.col, a.epoch_idx')
def temporal_filter(spark, sf):
    """Increments less their Gaussian means in time."""
    series, _ = _sequential(spark, sf)
    _, ifgs = stack(spark, sf)
    out = aps.temporal_highpass(series.select("row", "col", "epoch_idx", "tsincr"), network_of(ifgs), 600)
    return out.filter(F.col("high").isNotNull()).select("row", "col", "epoch_idx", r("high").alias("high"))


#: The transform's low-pass as sums: a Gaussian of the frequency is a product
#: of one of rows and one of columns, and so is its kernel among 4096 cells.
ATMOSPHERE = SERIES[: SERIES.rindex("SELECT")].rstrip() + """,
ti AS (SELECT epoch_idx, lag(span) OVER (ORDER BY epoch_idx) + (span - lag(span) OVER (ORDER BY epoch_idx)) / 2 AS t FROM ep),
hi AS (
  SELECT a."row", a.col, a.epoch_idx, any_value(a.tsincr) - sum(b.tsincr * exp(-0.5 * ((tb.t - ta.t) / (600 / 365.25::DOUBLE)) ** 2)) / sum(exp(-0.5 * ((tb.t - ta.t) / (600 / 365.25::DOUBLE)) ** 2)) AS h
  FROM steps a JOIN ti ta USING (epoch_idx) JOIN steps b ON a."row" = b."row" AND a.col = b.col AND b.epoch_idx > 0 JOIN ti tb ON tb.epoch_idx = b.epoch_idx WHERE a.epoch_idx > 0 GROUP BY a."row", a.col, a.epoch_idx
),
gr AS (SELECT epoch_idx, r::INT AS "row", c::INT AS col FROM ep, (SELECT unnest(range(12)) AS r), (SELECT unnest(range(16)) AS c) WHERE epoch_idx > 0),
fl AS (SELECT epoch_idx, "row", col, h FROM (
  SELECT g.epoch_idx, g."row", g.col, n.h, row_number() OVER (PARTITION BY g.epoch_idx, g."row", g.col ORDER BY (n."row" - g."row") ** 2 + (n.col - g.col) ** 2, n."row", n.col) AS k FROM gr g JOIN hi n USING (epoch_idx)) WHERE k = 1),
sg AS (SELECT sqrt(avg(d2) - avg(sqrt(d2)) ** 2) AS sigma FROM (SELECT ((i - 2048) / 1000::DOUBLE * 74) ** 2 + ((j - 2048) / 1000::DOUBLE * 92) ** 2 AS d2 FROM (SELECT unnest(range(4096)) AS i), (SELECT unnest(range(4096)) AS j))),
kn AS (SELECT m, sum(exp(-0.5 * (k / 1000::DOUBLE * 74 / sigma) ** 2) * cos(2 * pi() * k * m / 4096)) / 4096 AS wx, sum(exp(-0.5 * (k / 1000::DOUBLE * 92 / sigma) ** 2) * cos(2 * pi() * k * m / 4096)) / 4096 AS wy
  FROM (SELECT unnest(range(-2048, 2048)) AS k), (SELECT unnest(range(-15, 16)) AS m), sg GROUP BY m),
lw AS (SELECT o.epoch_idx, o."row", o.col, sum(f.h * x.wx * y.wy) AS low FROM hi o JOIN fl f USING (epoch_idx) JOIN kn x ON x.m = o.col - f.col JOIN kn y ON y.m = o."row" - f."row" GROUP BY ALL),
iv AS (SELECT ifg_id, e.epoch_idx FROM ifgs JOIN ep e ON e.date > first_date AND e.date <= second_date)
SELECT ifg_id, gr."row", gr.col, CASE WHEN count(low) = count(*) THEN round(sum(low), 4) END AS aps FROM gr JOIN iv USING (epoch_idx) LEFT JOIN lw USING (epoch_idx, "row", col) GROUP BY ifg_id, gr."row", gr.col
"""


@query(ATMOSPHERE, recursive=True)
def atmosphere(spark, sf):
    """The atmospheric correction of each interferogram."""
    series, ifgs, net = _series(spark, sf)
    high = aps.temporal_highpass(series.select("row", "col", "epoch_idx", "tsincr"), net, 600)
    low = aps.spatial_lowpass(high, GRID, 1.0)
    spans = network.members(ifgs, network.epochs(ifgs)).select("ifg_id", (F.col("epoch_idx") + 1).alias("epoch_idx"))
    return aps.correction(low, spans).select("ifg_id", "row", "col", r("aps", 4).alias("aps"))


def _misfit(x: str) -> str:
    """SQL of the distance of means m, a bin apart, to an exponential decay."""
    return f"sqrt(list_sum(list_transform(range(1, len(m) + 1), lambda i: (m[i] - m[1] * exp(-({x}) * ((i - 1) * 0.184::DOUBLE))) ** 2)))"


#: The lags of half the plane, in circles; then the simplex search, step by step.
DECAY = f"""
WITH z AS (SELECT ifg_id, "row", col, phase FROM phase WHERE phase IS NOT NULL),
n AS (SELECT ifg_id, count(*) FILTER (phase <> 0) AS n FROM z GROUP BY ifg_id),
k AS (SELECT kr::INT AS kr, kc::INT AS kc, sqrt(((kc - 8) * 74.0::DOUBLE) ** 2 + ((kr - 6) * 92.0::DOUBLE) ** 2) / 1000 AS d FROM (SELECT unnest(range(12)) AS kr), (SELECT unnest(range(16)) AS kc) WHERE kc * 12 + kr < 108),
g AS (SELECT kr, kc, ceil(d / 0.184::DOUBLE)::INT AS bin FROM k WHERE d < 0.644::DOUBLE),
ac AS (SELECT a.ifg_id, kr, kc, bin, sum(a.phase * b.phase) AS s FROM z a, g, z b WHERE b.ifg_id = a.ifg_id AND b."row" = (a."row" + kr + 6) % 12 AND b.col = (a.col + kc + 8) % 16 GROUP BY ALL),
v AS (SELECT ifg_id, bin, s / n AS v FROM ac JOIN n USING (ifg_id)),
l AS (SELECT greatest(1, max(bin) - 1) AS last FROM g),
ms AS (SELECT ifg_id, list(m ORDER BY bin) AS m FROM (SELECT ifg_id, bin, avg(v) AS m FROM v GROUP BY ALL), l WHERE bin <= last GROUP BY ifg_id),
i AS (SELECT ifg_id, m, 2 / (last * 0.184::DOUBLE) AS a, 2 / (last * 0.184::DOUBLE) * 1.05::DOUBLE AS b FROM ms, l),
st AS (
  SELECT ifg_id, m, 0 AS step, a, b, {_misfit("a")} AS fa, {_misfit("b")} AS fb, false AS done FROM i
  UNION ALL
  SELECT ifg_id, m, step + 1, a, CASE WHEN stop THEN b WHEN fx < fa THEN CASE WHEN ff < fx THEN far ELSE x END WHEN fn <= least(fx, fb) THEN near ELSE a + 0.5 * (b - a) END,
    fa, CASE WHEN stop THEN fb WHEN fx < fa THEN least(ff, fx) WHEN fn <= least(fx, fb) THEN fn ELSE fs END, stop
  FROM (SELECT *, {_misfit("near")} AS fn, {_misfit("a + 0.5 * (b - a)")} AS fs, abs(b - a) <= 1e-6 AND abs(fb - fa) <= 1e-6 AS stop
    FROM (SELECT *, CASE WHEN fx < fb THEN 1.5 * a - 0.5 * b ELSE 0.5 * (a + b) END AS near
      FROM (SELECT *, {_misfit("x")} AS fx, {_misfit("far")} AS ff
        FROM (SELECT *, 2 * a - b AS x, 3 * a - 2 * b AS far
          FROM (SELECT ifg_id, m, step, CASE WHEN fb < fa THEN b ELSE a END AS a, CASE WHEN fb < fa THEN a ELSE b END AS b, least(fa, fb) AS fa, greatest(fa, fb) AS fb FROM st WHERE NOT done AND step < 200)))))
),
al AS (SELECT ifg_id, arg_max(CASE WHEN fa <= fb THEN a ELSE b END, step) AS alpha FROM st GROUP BY ifg_id)
SELECT ifg_id, round(max(v), 3) AS maxvar, round(any_value(alpha), 2) AS alpha FROM v JOIN al USING (ifg_id) GROUP BY ifg_id
"""


@query(DECAY, recursive=True)
def distance_covariance(spark, sf):
    """Variance at lag zero and its decay with distance."""
    phase, _ = stack(spark, sf)
    out = aps.distance_covariance(phase, GRID)
    return out.select("ifg_id", r("maxvar", 3).alias("maxvar"), r("alpha", 2).alias("alpha"))


LAGS = 'WITH z AS (SELECT ifg_id, "row", col, phase FROM phase WHERE phase IS NOT NULL AND phase <> 0), n AS (SELECT ifg_id, count(*) AS n FROM z GROUP BY ifg_id), g AS (SELECT a.ifg_id, b.col - a.col AS dx, b."row" - a."row" AS dy, sum(a.phase * b.phase) AS s FROM z a JOIN z b ON a.ifg_id = b.ifg_id AND b.col - a.col BETWEEN 0 AND 2 AND b."row" - a."row" BETWEEN -2 AND 2 GROUP BY ALL) '


@query(LAGS + "SELECT ifg_id, dx, dy, round(s / n, 3) AS covariance FROM g JOIN n USING (ifg_id)")
def lag_covariance(spark, sf):
    phase, _ = stack(spark, sf)
    return aps.lag_covariance(phase, 2).select("ifg_id", "dx", "dy", r("covariance", 3).alias("covariance"))


@query(LAGS + "SELECT ifg_id, ceil(sqrt((dx * 74.0::DOUBLE) ** 2 + (dy * 92.0::DOUBLE) ** 2) / 1000 / (92.0::DOUBLE * 2 / 1000))::INT AS bin, round(avg(s / n), 3) AS covariance FROM g JOIN n USING (ifg_id) GROUP BY ALL")
def binned_covariance(spark, sf):
    phase, _ = stack(spark, sf)
    return aps.binned(aps.lag_covariance(phase, 2), GRID.x_size, GRID.y_size).select("ifg_id", "bin", r("covariance", 3).alias("covariance"))


META = {"semi_major": 6378137.0, "semi_minor": 6356752.3141, "sar_to_earth": 7152000.0, "near_range": 820000.0, "range_pixel": 20.0, "heading": -165.0, "look_direction": 90.0}


def _pixels(phase):
    lon, lat = geometry.lonlat(GRID)
    return phase.select("row", "col").distinct().select("row", "col", lon.alias("lon"), lat.alias("lat"), (100.0 + 50 * F.col("col")).alias("range_px"), (10.0 * F.col("row")).alias("height"))


ANGLES = f"""
WITH p AS (SELECT DISTINCT "row", col, radians({GRID.y_first}::DOUBLE + "row" * {GRID.y_step}::DOUBLE) AS lat, 820000 + 20 * (100.0::DOUBLE + 50 * col) AS rd, 10.0::DOUBLE * "row" AS h FROM phase),
e AS (SELECT *, sqrt(((6378137.0::DOUBLE ** 2 * cos(lat)) ** 2 + (6356752.3141::DOUBLE ** 2 * sin(lat)) ** 2) / ((6378137.0::DOUBLE * cos(lat)) ** 2 + (6356752.3141::DOUBLE * sin(lat)) ** 2)) AS re FROM p)
"""


@query(ANGLES + 'SELECT "row", col, rd AS range_dist, round(acos((7152000.0::DOUBLE ** 2 + rd ** 2 - re ** 2) / (2 * 7152000.0::DOUBLE * rd)), 6) AS look_angle, round(pi() - acos((rd ** 2 + (re + h) ** 2 - 7152000.0::DOUBLE ** 2) / (2 * rd * (re + h))), 6) AS incidence_angle FROM e')
def pixel_angles(spark, sf):
    phase, _ = stack(spark, sf)
    out = geometry.angles(_pixels(phase), META)
    return out.select("row", "col", "range_dist", r("look_angle").alias("look_angle"), r("incidence_angle").alias("incidence_angle"))


GEODESIC = """,
a AS (SELECT *, acos((7152000.0::DOUBLE ** 2 + rd ** 2 - re ** 2) / (2 * 7152000.0::DOUBLE * rd)) AS look, pi() - acos((rd ** 2 + (re + h) ** 2 - 7152000.0::DOUBLE ** 2) / (2 * rd * (re + h))) AS incidence FROM e),
s0 AS (SELECT *, radians(150.9::DOUBLE + col * 0.0008::DOUBLE) AS lon, incidence - look AS centre, radians(-165.0::DOUBLE) + radians(90.0::DOUBLE) AS az FROM a),
s1 AS (SELECT *, asin(-(sin(centre) * sin(az))) / cos(lat) + lon AS lon2 FROM s0),
s2 AS (SELECT *, -pi() / 2 + 2 * atan(cos(0.5 * (az + lon2 - lon)) / cos(0.5 * (az - lon2 + lon)) * tan(0.5 * (pi() / 2 + lat - centre))) AS lat2, (6378137.0::DOUBLE - 6356752.3141) / 6378137.0 AS f FROM s1),
u AS (SELECT "row", col, f, lon2 - lon AS omega, atan((1 - f) * tan(lat)) AS u1, atan((1 - f) * tan(lat2)) AS u2 FROM s2),
v AS (
  SELECT 0 AS i, *, omega AS lam FROM u
  UNION ALL
  SELECT i + 1, "row", col, f, omega, u1, u2, omega + (1 - c) * f * sin_a * (sigma + c * sin_s * (middle + c * cos_s * (2 * middle ** 2 - 1)))
  FROM (SELECT *, cos_s - 2 * sin(u1) * sin(u2) / (1 - sin_a ** 2) AS middle, f / 16 * (1 - sin_a ** 2) * (4 + f * (4 - 3 * (1 - sin_a ** 2))) AS c
    FROM (SELECT *, atan2(sin_s, cos_s) AS sigma, cos(u1) * cos(u2) * sin(lam) / sin_s AS sin_a
      FROM (SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS sin_s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cos_s FROM v WHERE i < 25)))
),
o AS (SELECT "row", col, atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) AS a FROM v WHERE i = 25)
SELECT "row", col, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END, 6) AS azimuth_angle FROM o
"""


@query(ANGLES.rstrip() + GEODESIC, recursive=True)
def azimuth_angles(spark, sf):
    """Azimuth to the satellite along a geodesic, by iteration."""
    phase, _ = stack(spark, sf)
    return geometry.pixel_geometry(_pixels(phase), META).select("row", "col", r("azimuth_angle").alias("azimuth_angle"))


@query('SELECT DISTINCT "row", col, round((120.5::DOUBLE + 0.02::DOUBLE * ((40 * "row" - 1499.5::DOUBLE) / 400)) * cos(0.35::DOUBLE) - (-30.25::DOUBLE + 0.01::DOUBLE * ((40 * "row" - 1499.5::DOUBLE) / 400)) * sin(0.35::DOUBLE), 6) AS bperp FROM phase')
def perpendicular_baseline(spark, sf):
    phase, _ = stack(spark, sf)
    meta = F.struct(*[F.lit(v).alias(k) for k, v in {"azimuth_n": 3000, "azimuth_looks": 4, "prf": 1600.0, "base_c": 120.5, "base_n": -30.25, "rate_c": 0.02, "rate_n": 0.01}.items()])
    rows = phase.select("row", "col").distinct()
    return rows.select("row", "col", r(geometry.perpendicular_baseline(40 * F.col("row"), F.lit(0.35), meta)).alias("bperp"))


@query('SELECT min(round(phase, 6)) AS least, max(round(phase, 6)) AS greatest, sum((phase IS NULL)::INT)::BIGINT AS missing FROM phase')
def product_statistics(spark, sf):
    phase, _ = stack(spark, sf)
    return rasters.statistics(phase.withColumn("value", F.round("phase", 6)))


@query('SELECT round(quantile_cont(phase, 0.002) - (SELECT avg(phase) FROM phase WHERE "row" < 3 AND col < 3), 6) AS low, round(quantile_cont(phase, 0.998) - (SELECT avg(phase) FROM phase WHERE "row" < 3 AND col < 3), 6) AS high FROM phase')
def plot_range(spark, sf):
    phase, _ = stack(spark, sf)
    values = phase.withColumnRenamed("phase", "value")
    return rasters.plot_range(values, values.filter("row < 3 AND col < 3")).select(r("low").alias("low"), r("high").alias("high"))


@query('SELECT step::INT AS step, round(a + (b - a) * step / 8, 6) AS level FROM (SELECT min(phase) AS a, max(phase) AS b FROM phase), (SELECT unnest(range(0, 9)) AS step)')
def colour_breaks(spark, sf):
    phase, _ = stack(spark, sf)
    return rasters.colour_breaks(phase, 8, "phase").select("step", r("level").alias("level"))


@query('SELECT point::INT AS point, "row", col, round(phase, 6) AS phase FROM (SELECT unnest(range(0, 500)) AS point) JOIN phase ON "row" = trunc(1 + 9 * (point / 499.0::DOUBLE))::INT AND col = trunc(2 + 11 * (point / 499.0::DOUBLE))::INT WHERE ifg_id = 0')
def profile(spark, sf):
    phase, _ = stack(spark, sf)
    return rasters.profile(phase.filter("ifg_id = 0"), (1, 2), (10, 13), value="phase").select("point", "row", "col", r("phase").alias("phase"))


@query("SELECT p_partkey, list_transform(CASE WHEN len(regexp_extract_all(p, '(\\d{8})', 1)) > 0 THEN regexp_extract_all(p, '(\\d{8})', 1) ELSE regexp_extract_all(p, '(\\d{6})', 1) END, lambda x: CASE WHEN length(x) = 8 THEN strptime(x, '%Y%m%d') ELSE strptime(CASE WHEN x[1:2]::INT >= 50 THEN '19' ELSE '20' END || x, '%Y%m%d') END::DATE) AS dates FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'geo_' || strftime(DATE '1990-01-01' + (p_partkey * 7)::INT, '%y%m%d') || '-' || strftime(DATE '1996-01-01' + (p_partkey * 9)::INT, '%y%m%d') || '.unw' ELSE strftime(DATE '2001-01-01' + p_partkey::INT, '%Y%m%d') || '_x.tif' END AS p FROM part)")
def epochs_in_names(spark, sf):
    """Dates parsed from file names."""
    day = lambda start, k, f: F.date_format(F.date_add(F.lit(start).cast("date"), (F.col("p_partkey") * k).cast("int")), f)
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("geo_"), day("1990-01-01", 7, "yyMMdd"), F.lit("-"), day("1996-01-01", 9, "yyMMdd"), F.lit(".unw"))).otherwise(F.concat(day("2001-01-01", 1, "yyyyMMdd"), F.lit("_x.tif")))
    parts = read(spark, sf, "part").select("p_partkey", metadata.epochs_in(name).alias("found"))
    return parts.select("p_partkey", F.transform("found", metadata.to_date).alias("dates"))


@query("WITH d AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, sum(floor(value * 1000 + 0.5)::BIGINT) / 1000.0::DOUBLE AS v FROM events GROUP BY ALL), c AS (SELECT user_id, day, sum(v) OVER (PARTITION BY user_id ORDER BY day) AS y, date_diff('day', DATE '2024-01-01', day) / 365.25::DOUBLE AS t FROM d) SELECT user_id, round(regr_slope(y, t), 2) AS rate, round(regr_intercept(y, t), 3) AS intercept, regr_count(y, t)::BIGINT AS samples FROM c GROUP BY user_id HAVING count(*) > 1")
def event_rates(spark, sf):
    """Linear rates of running totals, a series for each user."""
    from pyspark.sql import Window

    day = read(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.sum(F.floor(F.col("value") * 1000 + 0.5).cast("long")) / F.lit(1000.0)).alias("v"))
    total = day.select("user_id", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("epoch_idx"), F.sum("v").over(Window.partitionBy("user_id").orderBy("day")).alias("tscuml"))
    epoch = total.select("epoch_idx").distinct().select("epoch_idx", (F.col("epoch_idx") / F.lit(365.25)).alias("span"))
    out = inversion.linear_rate(total, epoch, by=("user_id",)).filter("samples > 1")
    return out.select("user_id", r("rate", 2).alias("rate"), r("intercept", 3).alias("intercept"), "samples")


EPOCH_BASELINES = f"""
WITH e AS (SELECT a.epoch_idx AS u, b.epoch_idx AS v, ((ifg_id * 37) % 101 - 50)::DOUBLE AS d FROM ifgs JOIN ep a ON a.date = first_date JOIN ep b ON b.date = second_date),
h AS (SELECT u AS i, v AS j, -d AS y FROM e UNION ALL SELECT v, u, d FROM e),
c AS (SELECT a.epoch_idx AS i, b.epoch_idx AS j, CASE WHEN a.epoch_idx = b.epoch_idx THEN (SELECT count(*) FROM h WHERE h.i = a.epoch_idx) + (a.epoch_idx = 0)::INT ELSE -(SELECT count(*) FROM h WHERE h.i = a.epoch_idx AND h.j = b.epoch_idx) END::DOUBLE AS w FROM ep a, ep b),
y AS (SELECT epoch_idx AS i, coalesce((SELECT sum(y) FROM h WHERE h.i = epoch_idx), 0)::DOUBLE AS y FROM ep),
rws AS (SELECT c.i, list_append(list(w ORDER BY j), any_value(y.y)) AS row FROM c JOIN y USING (i) GROUP BY c.i),
{solved("SELECT 0 AS key, list(row ORDER BY i) AS m, count(*)::BIGINT AS n FROM rws").strip()}
SELECT (i - 1)::INT AS epoch_idx, round(x[i], 6) AS bperp FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM solution)
"""


@query(EPOCH_BASELINES, recursive=True)
def epoch_baselines(spark, sf):
    """Baselines of the epochs from those of the interferograms."""
    _, ifgs = stack(spark, sf)
    net = network_of(ifgs)
    found = network.epoch_baselines(net, [math.fmod(i.ifg_id * 37, 101) - 50 for i in net.ifgs])
    return spark.createDataFrame([(i, round(b, 6)) for i, b in enumerate(found)], "epoch_idx int, bperp double")


@query(
    """WITH e AS (SELECT ifg_id, a.epoch_idx AS u, b.epoch_idx AS v, row_number() OVER (ORDER BY ifg_id % 5, ifg_id) AS pos FROM ifgs JOIN ep a ON a.date = first_date JOIN ep b ON b.date = second_date),
reach AS (SELECT pos, u AS node FROM e UNION SELECT t.pos, CASE WHEN e.u = t.node THEN e.v ELSE e.u END FROM reach t JOIN e ON e.pos < t.pos AND (e.u = t.node OR e.v = t.node)),
tree AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM reach t WHERE t.pos = e.pos AND t.node = e.v)),
n AS (SELECT ((SELECT count(*) FROM ep) - (SELECT count(*) FROM tree))::INT AS n_trees)
SELECT ifg_id, n_trees = 1 AS is_tree, n_trees FROM tree, n""",
    recursive=True,
)
def network_tree(spark, sf):
    """The network's minimum spanning tree."""
    _, ifgs = stack(spark, sf)
    tree = network.spanning_tree(network_of(ifgs))
    return spark.createDataFrame([(i.ifg_id, tree.is_tree, tree.n_trees) for i in tree.ifgs], "ifg_id int, is_tree boolean, n_trees int")
