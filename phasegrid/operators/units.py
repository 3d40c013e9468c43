"""Nodata, units, masks and projections: one column expression each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.model import MM_PER_METRE, NODATA_TOLERANCE


def null_nodata(value: Column, nodata: float = 0.0, tolerance: float = NODATA_TOLERANCE) -> Column:
    """Null where a value is nodata or NaN. Every later operator sees nulls."""
    return F.when(F.isnan(value) | (F.abs(value - nodata) <= tolerance), None).otherwise(value)


def radians_to_mm(value: Column, wavelength: Column) -> Column:
    return value * (F.lit(MM_PER_METRE) * wavelength / F.lit(4 * math.pi))


def mm_to_radians(value: Column, wavelength: Column) -> Column:
    return value * F.lit(4 * math.pi) / (F.lit(MM_PER_METRE) * wavelength)


def convert(phase: DataFrame, ifgs: DataFrame, *, nan_conversion: bool = True, nodata: float = 0.0) -> DataFrame:
    """phase with nodata as null (unless switched off) and in millimetres
    (unless its interferogram says it is already). ifgs: wavelength, units."""
    near = phase.join(F.broadcast(ifgs.select("ifg_id", "wavelength", "units")), "ifg_id")
    value = null_nodata(F.col("phase"), nodata) if nan_conversion else F.col("phase")
    value = F.when(F.col("units") == "RADIANS", radians_to_mm(value, F.col("wavelength"))).otherwise(value)
    return near.select("ifg_id", "row", "col", value.alias("phase"))


def mask_coherence(phase: DataFrame, coherence: DataFrame, threshold: float) -> DataFrame:
    """Keep phases where coherence is at least the threshold. A threshold of
    0 keeps every pixel that has a coherence."""
    near = phase.join(coherence.select("ifg_id", "row", "col", "coh"), ["ifg_id", "row", "col"], "left")
    return near.select("ifg_id", "row", "col", F.when(F.col("coh") >= threshold, F.col("phase")).alias("phase"))


def coherence_of(ifgs: DataFrame, files: DataFrame) -> DataFrame:
    """The coherence file of each interferogram: the one with its two dates.
    Two such files are an error."""
    near = ifgs.join(files, ["first_date", "second_date"])
    many = near.groupBy("ifg_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    return many.select("ifg_id", F.when(F.col("n") == 1, F.col("path")).otherwise(F.raise_error(F.lit("more than one coherence file"))).alias("path"))


def mask_rate(rates: DataFrame, maxsig: float) -> DataFrame:
    """Null rate and error where the error exceeds maxsig; 0 switches it off."""
    if maxsig == 0:
        return rates
    over = F.col("error") > maxsig
    return rates.withColumn("rate", F.when(over, None).otherwise(F.col("rate"))).withColumn("error", F.when(over, None).otherwise(F.col("error")))


def masked_percent(rates: DataFrame, maxsig: float) -> DataFrame:
    """Percent of the pixels with an error whose error exceeds maxsig."""
    over = F.when(F.col("error").isNotNull(), (F.col("error") > maxsig).cast("int"))
    return rates.agg((F.avg(over) * 100).alias("masked_percent"))


def masked_share(rates: DataFrame) -> DataFrame:
    """Percent of pixels without a rate."""
    return rates.agg((F.avg(F.col("rate").isNull().cast("int")) * 100).alias("masked_percent"))


#: Direction of the projection -> its divisor of a line-of-sight value.
PROJECTIONS = {"los": lambda angle: F.lit(1.0), "vertical": F.cos, "horizontal": F.sin}


def project(values: DataFrame, geometry: DataFrame | None, direction: str, polarity: int, *, value: str = "value") -> DataFrame:
    """Line-of-sight values along a direction, times polarity (1 or -1).
    Without a geometry (row, col, incidence) values stay as they are."""
    if polarity not in (1, -1):
        raise ValueError("polarity must be 1 or -1")
    if geometry is None:
        return values
    near = values.join(geometry.select("row", "col", "incidence"), ["row", "col"], "left")
    return near.withColumn(value, F.col(value) / PROJECTIONS[direction](F.col("incidence")) * polarity).drop("incidence")


def unit_vector(incidence: Column, azimuth: Column) -> Column:
    """East, north and up components of a line of sight."""
    return F.struct((F.sin(incidence) * F.sin(azimuth)).alias("east"), (F.sin(incidence) * F.cos(azimuth)).alias("north"), F.cos(incidence).alias("up"))


def los_components(value: Column, vector: Column) -> Column:
    return F.struct(*[(value * vector[c]).alias(c) for c in ("east", "north", "up")])


def calculate(bands: dict[str, DataFrame], expression: str) -> DataFrame:
    """Raster algebra: an SQL expression over bands (row, col, value) named by
    their keys; null where any band is null or missing."""
    out = None
    for name, band in bands.items():
        one = band.select("row", "col", F.col("value").alias(name))
        out = one if out is None else out.join(one, ["row", "col"])
    have = [F.col(b).isNotNull() for b in bands]
    good = have[0]
    for h in have[1:]:
        good = good & h
    return out.select("row", "col", F.when(good, F.expr(expression)).alias("value"))
