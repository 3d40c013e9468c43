"""DEM error: phase on perpendicular baseline and time, by sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(phase: DataFrame, bperp: DataFrame, ifgs: DataFrame, least: int = 10) -> DataFrame:
    """(row, col, slope, velocity): the least squares of phase on 1, baseline
    and time span at each pixel with `least` (4 at least) valid phases; null
    where a baseline is missing. Centred sums, in closed form."""
    if least < 4:
        raise ValueError("at least 4 observations are needed")
    near = phase.filter(F.col("phase").isNotNull()).join(bperp, ["ifg_id", "row", "col"], "left").join(F.broadcast(ifgs.select("ifg_id", "time_span")), "ifg_id")
    y, b, t = F.col("phase"), F.col("bperp"), F.col("time_span")
    sums = near.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.count("bperp").alias("nb"), F.regr_sxx(y, b).alias("bb"), F.regr_sxx(y, t).alias("tt"), F.regr_sxy(b, t).alias("bt"), F.regr_sxy(y, b).alias("yb"), F.regr_sxy(y, t).alias("yt"))
    det = F.col("bb") * F.col("tt") - F.col("bt") * F.col("bt")
    ok = (F.col("n") >= least) & (F.col("nb") == F.col("n")) & (F.abs(det) > 1e-12 * F.col("bb") * F.col("tt"))
    slope = (F.col("yb") * F.col("tt") - F.col("yt") * F.col("bt")) / det
    velocity = (F.col("yt") * F.col("bb") - F.col("yb") * F.col("bt")) / det
    return sums.select("row", "col", F.when(ok, slope).alias("slope"), F.when(ok, velocity).alias("velocity"))


def errors(fitted: DataFrame, geometry: DataFrame) -> DataFrame:
    """(row, col, dem_error) in metres. geometry: range_dist, look_angle."""
    return fitted.join(geometry, ["row", "col"]).select("row", "col", (F.col("slope") * F.col("range_dist") * F.sin("look_angle") * -0.001).alias("dem_error"))


def correct(phase: DataFrame, bperp: DataFrame, fitted: DataFrame) -> DataFrame:
    """phase less slope times baseline; null where there is no slope."""
    near = phase.join(bperp, ["ifg_id", "row", "col"], "left").join(fitted.select("row", "col", "slope"), ["row", "col"], "left")
    return near.select("ifg_id", "row", "col", (F.col("phase") - F.col("slope") * F.col("bperp")).alias("phase"))


def mean_baseline(bperp: DataFrame) -> DataFrame:
    """Mean baseline of each interferogram: the mean over tiles of the means
    in them. bperp: with tile_id."""
    return bperp.groupBy("ifg_id", "tile_id").agg(F.avg("bperp").alias("m")).groupBy("ifg_id").agg(F.avg("m").alias("bperp"))
