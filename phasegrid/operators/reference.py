"""Reference pixel and reference phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.model import Grid


def check(grid: Grid, chip: int, min_fraction: float, nx: int, ny: int) -> None:
    """Errors in the settings of the search."""
    if chip < 1 or chip % 2 == 0 or chip > min(grid.nrows, grid.ncols):
        raise ValueError("the chip must be odd and fit the image")
    if not 0 <= min_fraction <= 1:
        raise ValueError("the least fraction must be from 0 to 1")
    for n, size in ((nx, grid.ncols), (ny, grid.nrows)):
        if n < 1 or n > size - chip + 1:
            raise ValueError("the search window doesn't fit the image")


def steps(size: int, n: int, radius: int) -> list[int]:
    """Candidate positions along an axis: every size // n cells, as far as
    the chip stays inside."""
    return list(range(radius, size - radius, size // n))


def candidates(grid: Grid, nx: int, ny: int, chip: int) -> list[tuple[int, int]]:
    """(row, col) of the candidates, rows outer."""
    radius = chip // 2
    return [(r, c) for r in steps(grid.nrows, ny, radius) for c in steps(grid.ncols, nx, radius)]


def scores(phase: DataFrame, places: list[tuple[int, int]], chip: int, min_fraction: float) -> DataFrame:
    """(y, x, score): the mean over interferograms of the deviation in the
    chip around a candidate; null unless every interferogram has more than
    chip^2 * min_fraction valid pixels there. Candidates are a small table."""
    h, least = chip // 2, chip * chip * min_fraction
    points = F.broadcast(phase.sparkSession.createDataFrame(places, "y int, x int"))
    inside = phase.join(points, (F.abs(F.col("row") - F.col("y")) <= h) & (F.abs(F.col("col") - F.col("x")) <= h))
    each = inside.groupBy("y", "x", "ifg_id").agg(F.stddev_pop("phase").alias("sd"), F.count("phase").alias("n"))
    return each.groupBy("y", "x").agg(F.when(F.min(F.col("n") > least), F.avg("sd")).alias("score"))


def best(score: DataFrame) -> DataFrame:
    """The candidate of least score; ties go to the first in row order."""
    return score.filter(F.col("score").isNotNull()).orderBy("score", "y", "x").limit(1)


def reference_pixel(phase: DataFrame, grid: Grid, *, refx: int = -1, refy: int = -1, nx: int = 10, ny: int = 10, chip: int = 21, min_fraction: float = 0.5) -> tuple[int, int]:
    """(row, col): the given pixel, or the best candidate where either
    coordinate is -1."""
    if refx != -1 and refy != -1:
        if not (0 <= refx < grid.ncols and 0 <= refy < grid.nrows):
            raise ValueError("the reference pixel is outside the image")
        return refy, refx
    check(grid, chip, min_fraction, nx, ny)
    found = best(scores(phase, candidates(grid, nx, ny, chip), chip, min_fraction)).collect()
    if not found:
        raise ValueError("no candidate has enough valid pixels")
    return found[0]["y"], found[0]["x"]


def chip_of(phase: DataFrame, row: int, col: int, chip: int) -> DataFrame:
    h = chip // 2
    return phase.filter((F.abs(F.col("row") - row) <= h) & (F.abs(F.col("col") - col) <= h))


def area_stats(phase: DataFrame, row: int, col: int, chip: int) -> DataFrame:
    """Mean and deviation of each interferogram in the reference area."""
    return chip_of(phase, row, col, chip).groupBy("ifg_id").agg(F.avg("phase").alias("mean"), F.stddev_pop("phase").alias("std"))


def phase_by_image(phase: DataFrame) -> DataFrame:
    """(ifg_id, ref): the median of each interferogram over the pixels that
    every interferogram has. The semi-join is on the pixel; the median of an
    interferogram merges counts of values."""
    whole = phase.groupBy("row", "col").agg(F.bool_and(F.col("phase").isNotNull()).alias("ok"), F.count(F.lit(1)).alias("n"))
    whole = whole.filter("ok").select("row", "col")
    return phase.join(whole, ["row", "col"], "left_semi").groupBy("ifg_id").agg(F.median("phase").alias("ref"))


def phase_by_chip(phase: DataFrame, row: int, col: int, chip: int, min_fraction: float) -> DataFrame:
    """(ifg_id, ref): the median of each interferogram in the chip around the
    reference pixel; an error where fewer than chip^2 * min_fraction are valid."""
    least = chip * chip * min_fraction
    found = chip_of(phase, row, col, chip).groupBy("ifg_id").agg(F.median("phase").alias("ref"), F.count("phase").alias("n"))
    return found.select("ifg_id", F.when(F.col("n") >= least, F.col("ref")).otherwise(F.raise_error(F.lit("too few valid pixels around the reference pixel")).cast("double")).alias("ref"))


def subtract(phase: DataFrame, ref: DataFrame) -> DataFrame:
    """phase less the reference phase of its interferogram."""
    return phase.join(F.broadcast(ref), "ifg_id").select("ifg_id", "row", "col", (F.col("phase") - F.col("ref")).alias("phase"))
