"""Atmospheric filtering: high-pass in time, low-pass in space; and the
covariance of an image with distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import kernels
from phasegrid.model import DAYS_PER_YEAR, Grid, Network


def kernel(distance, sigma: float):
    return F.exp(-0.5 * F.pow(distance / F.lit(sigma), 2))


def temporal_lowpass(series: DataFrame, times: DataFrame, cutoff: float, least: int = 1, *, value: str = "tsincr") -> DataFrame:
    """(row, col, epoch_idx, value, low): Gaussian means over the valid values
    of the same pixel; null where it has fewer than `least` of them. times:
    epoch_idx, t; a table of the few epochs, and so of their pairs."""
    valid = series.filter(F.col(value).isNotNull()).select("row", "col", "epoch_idx", F.col(value).alias("v"))
    t = times.select("epoch_idx", "t")
    pairs = t.toDF("epoch_idx", "t1").crossJoin(t.toDF("target", "t2")).select("epoch_idx", "target", kernel(F.col("t1") - F.col("t2"), cutoff).alias("w"))
    sums = valid.join(F.broadcast(pairs), "epoch_idx").groupBy("row", "col", "target").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("low"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("row", "col", F.col("target").alias("epoch_idx"), "low", "n")
    out = series.join(sums, ["row", "col", "epoch_idx"], "left")
    return out.select("row", "col", "epoch_idx", value, F.when((F.col("n") >= least) & F.col(value).isNotNull(), F.col("low")).alias("low"))


def midpoints(network: Network, spark) -> DataFrame:
    """epoch_idx (from 1) and the middle of the interval that ends there."""
    spans = network.spans()
    return spark.createDataFrame([(i + 1, a + (b - a) / 2) for i, (a, b) in enumerate(zip(spans, spans[1:]))], "epoch_idx int, t double")


def temporal_highpass(series: DataFrame, network: Network, cutoff_days: int, least: int = 1, *, value: str = "tsincr") -> DataFrame:
    """series less its low-pass, as `high`. The cutoff is whole days."""
    if not isinstance(cutoff_days, int) or cutoff_days < 1:
        raise ValueError("the cutoff must be a whole number of days, 1 or more")
    low = temporal_lowpass(series, midpoints(network, series.sparkSession), cutoff_days / DAYS_PER_YEAR, least, value=value)
    return low.select("row", "col", "epoch_idx", (F.col(value) - F.col("low")).alias("high"))


def _image(pdf, grid: Grid, value: str):
    import numpy as np

    out = np.full((grid.nrows, grid.ncols), np.nan)
    out[pdf["row"], pdf["col"]] = pdf[value]
    return out


def spatial_lowpass(images: DataFrame, grid: Grid, cutoff: float, *, by: str = "epoch_idx", value: str = "high", fill: str | None = "nearest", pad: int = 4096) -> DataFrame:
    """(by, row, col, low): each image filtered; a cutoff of 0 takes that of
    the image's own covariance. An image is one task, as a transform needs all
    of it; images are many."""

    def one(key, pdf):
        import numpy as np
        import pandas as pd

        image = _image(pdf, grid, value)
        if np.isnan(image).all():
            low = image
        else:
            own = cutoff or 1 / kernels.covariance_with_distance(image, grid.x_size, grid.y_size)[1]
            low = kernels.gaussian_lowpass(image, own, grid.x_size, grid.y_size, fill, pad)
        row, col = np.mgrid[: grid.nrows, : grid.ncols]
        return pd.DataFrame({by: key[0], "row": row.ravel(), "col": col.ravel(), "low": low.ravel()})

    out = images.select(by, "row", "col", value).groupBy(by).applyInPandas(one, f"{by} int, row int, col int, low double")
    return out.withColumn("low", F.nanvl("low", F.lit(None).cast("double")))


def correction(low: DataFrame, spans: DataFrame) -> DataFrame:
    """(ifg_id, row, col, aps): the sum over the intervals that each
    interferogram spans. spans: ifg_id, epoch_idx of the interval's end."""
    near = low.join(F.broadcast(spans), "epoch_idx")
    return near.groupBy("ifg_id", "row", "col").agg(F.when(F.count("low") == F.count(F.lit(1)), F.sum("low")).alias("aps"))


def correct(phase: DataFrame, aps: DataFrame) -> DataFrame:
    return phase.join(aps, ["ifg_id", "row", "col"], "left").select("ifg_id", "row", "col", (F.col("phase") - F.col("aps")).alias("phase"))


def distance_covariance(phase: DataFrame, grid: Grid, *, alpha: bool = True) -> DataFrame:
    """(ifg_id, maxvar, alpha) of each interferogram, an image to a task."""

    def one(key, pdf):
        import pandas as pd

        maxvar, a = kernels.covariance_with_distance(_image(pdf, grid, "phase"), grid.x_size, grid.y_size, alpha)
        return pd.DataFrame({"ifg_id": [key[0]], "maxvar": [maxvar], "alpha": [a]})

    return phase.select("ifg_id", "row", "col", "phase").groupBy("ifg_id").applyInPandas(one, "ifg_id int, maxvar double, alpha double")


def lag_covariance(phase: DataFrame, most: int) -> DataFrame:
    """Autocovariance of each interferogram at lags of up to `most` cells, as
    a plan: sum over pixels of phase times the phase a lag away, over the
    number of non-zero phases. Linear in the pixels for a given `most`."""
    cells = phase.filter(F.col("phase").isNotNull() & (F.col("phase") != 0)).select("ifg_id", "row", "col", "phase")
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    near = cells.select("ifg_id", "row", "col", "phase", lags.alias("dy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("dx"))
    near = near.select("ifg_id", (F.col("row") + F.col("dy")).alias("row"), (F.col("col") + F.col("dx")).alias("col"), "dx", "dy", F.col("phase").alias("p"))
    sums = near.join(cells, ["ifg_id", "row", "col"]).groupBy("ifg_id", "dx", "dy").agg(F.sum(F.col("p") * F.col("phase")).alias("s"))
    n = cells.groupBy("ifg_id").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(F.broadcast(n), "ifg_id").select("ifg_id", "dx", "dy", (F.col("s") / F.col("n")).alias("covariance"))


def binned(lag: DataFrame, x_size: float, y_size: float) -> DataFrame:
    """Means of a covariance in rings of two cells: bin 0 is lag zero."""
    width = max(x_size, y_size) * 2 / 1000
    r = F.sqrt(F.pow(F.col("dx") * x_size, 2) + F.pow(F.col("dy") * y_size, 2)) / 1000
    return lag.groupBy("ifg_id", F.ceil(r / width).cast("int").alias("bin")).agg(F.avg("covariance").alias("covariance"))
