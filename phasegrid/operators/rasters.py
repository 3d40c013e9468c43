"""Multi-looking, crops, resampling and statistics of rasters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.model import Grid


def multilook(phase: DataFrame, grid: Grid, xlooks: int, ylooks: int, threshold: float, *, strict: bool = False, by: tuple[str, ...] = ("ifg_id",), value: str = "phase") -> DataFrame:
    """Mean of the valid cells of each block of ylooks x xlooks; null where
    the share of cells without a value reaches the threshold. strict: the rule
    of the plain resampler instead, which drops partial blocks and keeps one
    whose share is below the threshold (or both are zero)."""
    block = phase.groupBy(*by, F.floor(F.col("row") / ylooks).cast("int").alias("row"), F.floor(F.col("col") / xlooks).cast("int").alias("col"))
    out = block.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("cells"), F.avg(F.col(value).isNull().cast("int")).alias("empty"))
    if strict:
        out = out.filter((F.col("row") < grid.nrows // ylooks) & (F.col("col") < grid.ncols // xlooks))
        keep = (F.col("empty") < threshold) | ((F.col("empty") == 0) & (F.lit(threshold) == 0))
    else:
        keep = F.col("empty") < threshold
    return out.select(*by, "row", "col", F.when(keep, F.col("mean")).alias(value))


def looked(grid: Grid, xlooks: int, ylooks: int) -> Grid:
    """The grid after multi-looking."""
    return replace(grid, nrows=-(-grid.nrows // ylooks), ncols=-(-grid.ncols // xlooks), x_step=grid.x_step * xlooks, y_step=grid.y_step * ylooks, x_size=grid.x_size * xlooks, y_size=grid.y_size * ylooks)


def check_looks(*looks: int) -> None:
    if any(not isinstance(n, int) or n < 1 for n in looks):
        raise ValueError("looks must be whole numbers of 1 or more")


def common_resolution(grids: DataFrame) -> None:
    """Grids (x_step, y_step) that differ are an error."""
    if grids.select("x_step", "y_step").distinct().count() > 1:
        raise ValueError("the rasters have different resolutions")


def extents(grids: DataFrame, how: str) -> DataFrame:
    """The area to work on, of grids (x_first, x_last, y_first, y_last; y runs
    south): their intersection, their union, or (same) the one they share."""
    if how == "intersection":
        return grids.agg(F.max("x_first").alias("x_first"), F.min("x_last").alias("x_last"), F.min("y_first").alias("y_first"), F.max("y_last").alias("y_last"))
    if how == "union":
        return grids.agg(F.min("x_first").alias("x_first"), F.max("x_last").alias("x_last"), F.max("y_first").alias("y_first"), F.min("y_last").alias("y_last"))
    if how == "same":
        rounded = grids.select(*[F.bround(c, 4).alias(c) for c in ("x_first", "x_last", "y_first", "y_last")])
        return rounded.groupBy(*rounded.columns).count().agg(*[F.when(F.count(F.lit(1)) == 1, F.min(c)).otherwise(F.raise_error(F.lit("the rasters cover different areas"))).alias(c) for c in rounded.columns])
    raise ValueError(f"no such crop: {how}")


def snap(value: Column, first: float, step: float) -> Column:
    """A custom crop edge moved to the nearest cell edge, halves to even."""
    return F.lit(first) + F.bround((value - first) / step) * step


def crop(phase: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """Rows top to bottom and columns left to right (ends excluded), counted
    anew from 0. The bounds are pushed to the scan."""
    inside = (F.col("row") >= top) & (F.col("row") < bottom) & (F.col("col") >= left) & (F.col("col") < right)
    return phase.filter(inside).withColumn("row", F.col("row") - top).withColumn("col", F.col("col") - left)


def nearest(phase: DataFrame, xfactor: float, yfactor: float) -> DataFrame:
    """Nearest-neighbour resampling: the value of each new cell is that of
    the old cell that holds its centre. Factors are old cells to a new one;
    below 1 they give an old cell to several new ones."""

    def held(old: str, factor: float):
        """The new cells whose centres the old cell holds."""
        first = F.ceil(F.col(old) / factor - 0.5).cast("int") - 1
        near = F.sequence(F.greatest(first, F.lit(0)), F.greatest(F.ceil((F.col(old) + 1) / factor - 0.5).cast("int"), F.lit(0)))
        return F.filter(near, lambda new: F.floor((new + 0.5) * factor) == F.col(old))

    rows = phase.withColumn("row_", F.explode(held("row", yfactor))).withColumn("col_", F.explode(held("col", xfactor)))
    return rows.select("ifg_id", F.col("row_").alias("row"), F.col("col_").alias("col"), "phase")


def nan_fraction(phase: DataFrame) -> DataFrame:
    """Cells without a value, and their share, of each interferogram."""
    empty = F.col("phase").isNull().cast("int")
    return phase.groupBy("ifg_id").agg(F.sum(empty).alias("nan_count"), F.avg(empty).alias("nan_fraction"))


def coherence_stats(coherence: DataFrame) -> DataFrame:
    """Median, mean and deviation of each pixel; exact zeros are no data."""
    return coherence.groupBy("row", "col").agg(*[F.nullif(f, F.lit(0.0)).alias(n) for f, n in ((F.median("coh"), "coh_median"), (F.avg("coh"), "coh_mean"), (F.stddev_pop("coh"), "coh_std"))])


def statistics(values: DataFrame, value: str = "value") -> DataFrame:
    """Least, greatest and number of missing values of a product."""
    return values.agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.sum(F.col(value).isNull().cast("int")).alias("missing"))


def plot_range(values: DataFrame, area: DataFrame, value: str = "value") -> DataFrame:
    """0.2 and 99.8 percentiles of the values less the mean of an area."""
    mean = area.agg(F.avg(value).alias("mean"))
    return values.agg(F.percentile(value, F.lit(0.002)).alias("low"), F.percentile(value, F.lit(0.998)).alias("high")).crossJoin(mean).select((F.col("low") - F.col("mean")).alias("low"), (F.col("high") - F.col("mean")).alias("high"))


def colour_breaks(values: DataFrame, n: int, value: str = "value") -> DataFrame:
    """n + 1 equally spaced breaks from the least to the greatest value."""
    ends = values.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step")).select("step", (F.col("a") + (F.col("b") - F.col("a")) * F.col("step") / n).alias("level"))


def profile(values: DataFrame, start: tuple[int, int], stop: tuple[int, int], n: int = 500, value: str = "value") -> DataFrame:
    """Values at n points on the line between two pixels (row, col), each that
    of the cell the point falls in."""
    at = F.col("point") / (n - 1)
    points = values.sparkSession.range(n).select(F.col("id").cast("int").alias("point"))
    points = points.select("point", (start[0] + (stop[0] - start[0]) * at).cast("int").alias("row"), (start[1] + (stop[1] - start[1]) * at).cast("int").alias("col"))
    return values.join(F.broadcast(points), ["row", "col"]).select("point", "row", "col", value)


def tiles(nrows: int, ncols: int, down: int, across: int) -> list[tuple[int, int, int, int, int]]:
    """(tile, top, left, bottom, right) of a raster cut into down x across
    parts, the first ones a cell larger where the cut isn't even."""

    def cuts(n, k):
        each, more = divmod(n, k)
        ends = [0]
        for i in range(k):
            ends.append(ends[-1] + each + (i < more))
        return ends

    rows, cols = cuts(nrows, down), cuts(ncols, across)
    return [(i * across + j, rows[i], cols[j], rows[i + 1], cols[j + 1]) for i in range(down) for j in range(across)]


def two_factors(n: int) -> tuple[int, int]:
    """Two factors of n that are as near as can be, the smaller one first."""
    a = next(k for k in range(int(n**0.5), 0, -1) if n % k == 0)
    return a, n // a


def with_tiles(phase: DataFrame, cut: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """phase with tile_id; the tiles are a table of a few rows."""
    spark = phase.sparkSession
    edges = spark.createDataFrame(cut, "tile_id int, r0 int, c0 int, r1 int, c1 int")
    inside = (F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r1")) & (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c1"))
    return phase.join(F.broadcast(edges), inside).drop("r0", "c0", "r1", "c1")
