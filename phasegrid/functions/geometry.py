"""Imaging geometry of each pixel, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import kernels
from phasegrid.model import Grid


def lonlat(grid: Grid) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel's corner, in degrees."""
    return F.lit(grid.x_first) + F.col("col") * F.lit(grid.x_step), F.lit(grid.y_first) + F.col("row") * F.lit(grid.y_step)


def pixel_of(grid: Grid, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Column and row nearest to a place, halves to even."""
    return F.bround((lon - F.lit(grid.x_first)) / F.lit(grid.x_step)).cast("int"), F.bround((lat - F.lit(grid.y_first)) / F.lit(grid.y_step)).cast("int")


def wavelength(frequency: Column) -> Column:
    return F.lit(3e8) / frequency


def earth_radius(lat: Column, major: float, minor: float) -> Column:
    """Radius of the ellipsoid at a latitude in radians."""
    c, s = F.cos(lat), F.sin(lat)
    return F.sqrt((F.pow(F.lit(major**2) * c, 2) + F.pow(F.lit(minor**2) * s, 2)) / (F.pow(F.lit(major) * c, 2) + F.pow(F.lit(minor) * s, 2)))


def _clamped_acos(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


def angles(pixels: DataFrame, meta: dict) -> DataFrame:
    """pixels (row, col, lon, lat in degrees, range_px, height) with
    range_dist, look_angle and incidence_angle (radians): two triangles of
    satellite, Earth's centre and ground."""
    major, minor, se = meta["semi_major"], meta["semi_minor"], meta["sar_to_earth"]
    lat = F.radians("lat")
    out = pixels.withColumn("range_dist", F.lit(meta["near_range"]) + F.lit(meta["range_pixel"]) * F.col("range_px"))
    out = out.withColumn("radius_", earth_radius(lat, major, minor))
    out = out.withColumn("look_angle", _clamped_acos((F.lit(se**2) + F.pow("range_dist", F.lit(2)) - F.pow("radius_", F.lit(2))) / (F.lit(2 * se) * F.col("range_dist"))))
    out = out.withColumn("ground_", F.col("radius_") + F.col("height"))
    out = out.withColumn("incidence_angle", F.lit(math.pi) - _clamped_acos((F.pow("range_dist", F.lit(2)) + F.pow("ground_", F.lit(2)) - F.lit(se**2)) / (2 * F.col("range_dist") * F.col("ground_"))))
    return out.drop("radius_", "ground_")


def satellite(pixels: DataFrame, heading: float, look: float) -> DataFrame:
    """pixels with the satellite's latitude and longitude (radians), from its
    heading and look direction in degrees (+90 is right)."""
    lat, lon = F.radians("lat"), F.radians("lon")
    centre = F.col("incidence_angle") - F.col("look_angle")
    azimuth = F.lit(math.radians(heading) + math.radians(look))
    sat_lon = F.asin(-(F.sin(centre) * F.sin(azimuth))) / F.cos(lat) + lon
    part = F.cos(0.5 * (azimuth + sat_lon - lon)) / F.cos(0.5 * (azimuth - sat_lon + lon)) * F.tan(0.5 * (F.lit(math.pi / 2) + lat - centre))
    return pixels.withColumn("sat_lon", sat_lon).withColumn("sat_lat", F.lit(-math.pi / 2) + 2 * F.atan(part))


def azimuth(pixels: DataFrame, major: float, minor: float) -> DataFrame:
    """pixels with azimuth_angle (radians) from the ground to the satellite.
    The geodesic is found by iteration, for all pixels of a batch at once."""

    def inverse(lat1, lon1, lat2, lon2):
        import numpy as np
        import pyarrow as pa

        a = [np.asarray(x.to_numpy(zero_copy_only=False), float) for x in (lat1, lon1, lat2, lon2)]
        out = kernels.vincenty_azimuth(*a, major, minor)
        return pa.array(out, mask=np.isnan(out))

    return pixels.withColumn("azimuth_angle", F.arrow_udf(inverse, "double")(F.radians("lat"), F.radians("lon"), "sat_lat", "sat_lon"))


def pixel_geometry(pixels: DataFrame, meta: dict) -> DataFrame:
    """All of the above."""
    return azimuth(satellite(angles(pixels, meta), meta["heading"], meta["look_direction"]), meta["semi_major"], meta["semi_minor"])


def perpendicular_baseline(azimuth_px: Column, look: Column, meta: Column) -> Column:
    """From the baseline and its rate at the pixel's azimuth line. meta: a
    struct with azimuth_n, azimuth_looks, prf, base_c, base_n, rate_c, rate_n."""
    time = (azimuth_px - (meta["azimuth_n"] / 2 - 0.5)) / (meta["prf"] / meta["azimuth_looks"])
    return (meta["base_c"] + meta["rate_c"] * time) * F.cos(look) - (meta["base_n"] + meta["rate_n"] * time) * F.sin(look)


def radar_coordinates(table: DataFrame) -> DataFrame:
    """A lookup table (row, col, range_px, azimuth_px) with 0 as null."""
    return table.select("row", "col", F.nullif("range_px", F.lit(0.0)).alias("range_px"), F.nullif("azimuth_px", F.lit(0.0)).alias("azimuth_px"))


def sampled_lookup(table: DataFrame, xlooks: int, ylooks: int, left: int, right: int, top: int, bottom: int) -> DataFrame:
    """The lookup table at the middle of each look window of a crop."""
    start = lambda first, looks: first + (looks // 2 - 1 if looks % 2 == 0 else (looks - 1) // 2)
    x0, y0 = start(left, xlooks), start(top, ylooks)
    keep = (F.col("col") >= x0) & (F.col("col") < right) & ((F.col("col") - x0) % xlooks == 0) & (F.col("row") >= y0) & (F.col("row") < bottom) & ((F.col("row") - y0) % ylooks == 0)
    rows = table.filter(keep)
    return radar_coordinates(rows.withColumn("row", ((F.col("row") - y0) / ylooks).cast("int")).withColumn("col", ((F.col("col") - x0) / xlooks).cast("int")))
