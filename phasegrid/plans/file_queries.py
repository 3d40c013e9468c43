"""Readers, writers and metadata as queries on the driver's tables: files are
written to the shared folder, read back, and held against SQL on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from phasegrid.config import PARAMETERS, REQUIRED, Config, ConfigError
from phasegrid.functions import geometry, kernels
from phasegrid.operators import inversion, metadata, rasters, units
from phasegrid.plans.queries import VARIANCE, query, r, stack
from phasegrid.plans.tables import COLS, GRID, ROWS, read
from phasegrid.sources import headers
from phasegrid.sources import rasters as files
from phasegrid.sources.shared import shared_folder

CELLS = """
WITH g AS (SELECT ifg_id, r::INT AS "row", c::INT AS col FROM ifgs, (SELECT unnest(range(12)) AS r), (SELECT unnest(range(16)) AS c)),
v AS (SELECT ifg_id, "row", col, round(phase, 3) AS value FROM g LEFT JOIN phase USING (ifg_id, "row", col))
"""


def _named(spark: SparkSession, sf: str) -> DataFrame:
    phase, _ = stack(spark, sf)
    return phase.select(F.format_string("ifg_%03d.tif", "ifg_id").alias("name"), "row", "col", F.col("phase").alias("value"))


def _written(spark: SparkSession, sf: str) -> str:
    """The stack as GeoTIFFs in a folder."""
    folder = shared_folder(spark, "tiffs")
    made = files.geotiffs(_named(spark, sf), ROWS, COLS, GRID.x_first, GRID.y_first, GRID.x_step, GRID.y_step, metadata={"PHASE_UNITS": "RADIANS", "LOOKS": "1"})
    files.save(made, folder)
    return folder


def _id(path: str = "path"):
    return F.regexp_extract(path, r"ifg_(\d+)", 1).cast("int").alias("ifg_id")


@query(CELLS + 'SELECT ifg_id, "row", col, value FROM v')
def geotiff_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every image written as a GeoTIFF and read back."""
    found = files.read_geotiffs(spark, _written(spark, sf))
    return found.select(_id(), "row", "col", r("value", 3).alias("value"))


@query("SELECT ifg_id, 12 AS nrows, 16 AS ncols, round(150.9::DOUBLE, 6) AS x_first, round(150.9::DOUBLE + 16 * 0.0008::DOUBLE, 6) AS x_last, round(-34.2::DOUBLE, 6) AS y_first, round(-34.2::DOUBLE - 12 * 0.0008::DOUBLE, 6) AS y_last, 'RADIANS' AS units, 'interferogram' AS kind FROM ifgs")
def geotiff_headers(spark, sf):
    """Size, corners and metadata of the same files, without their cells."""
    found = files.geotiff_headers(spark, _written(spark, sf))
    corners = [r(c).alias(c) for c in ("x_first", "x_last", "y_first", "y_last")]
    return found.select(_id(), "nrows", "ncols", *corners, F.col("metadata")["PHASE_UNITS"].alias("units"), metadata.kind_of(F.col("metadata")).alias("kind"))


def _tall(spark: SparkSession, sf: str, encode) -> tuple[str, int]:
    """All images under each other as one raw raster, and its rows."""
    phase, ifgs = stack(spark, sf)
    n, folder = ifgs.count() * ROWS, shared_folder(spark, "raw")
    rows = phase.select(F.lit("stack").alias("name"), (F.col("ifg_id") * ROWS + F.col("row")).alias("row"), "col", F.col("phase").alias("value"))
    files.save(files.images(rows, n, COLS, lambda _, image: encode(image)), folder)
    return f"{folder}/stack", n


def _back(pixels: DataFrame) -> DataFrame:
    return pixels.select(F.floor(F.col("row") / ROWS).cast("int").alias("ifg_id"), (F.col("row") % ROWS).alias("row"), "col", r("value", 3).alias("value"))


@query(CELLS + 'SELECT ifg_id, "row", col, coalesce(value, 0) AS value FROM v')
def gamma_round_trip(spark, sf):
    """The stack as a big-endian raw raster, and back; no data is 0 there."""
    path, n = _tall(spark, sf, files.gamma_bytes)
    return _back(files.read_gamma(spark, path, {"NROWS": n, "NCOLS": COLS}))


@query(CELLS + 'SELECT ifg_id, "row", col, coalesce(value, 0) AS value FROM v')
def roipac_round_trip(spark, sf):
    """The stack as a little-endian raster of two bands, and back."""
    path, n = _tall(spark, sf, files.roipac_bytes)
    return _back(files.read_roipac(spark, path, {"NROWS": n, "NCOLS": COLS}))


def _parsed(texts: DataFrame, parse, schema: str) -> DataFrame:
    """parse(row) of every row; headers are short, one to a row."""

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pylist([parse(x) for x in b.to_pylist()], kind)

    return texts.mapInArrow(run, schema)


def _epoch_text(date: str, incidence):
    """A GAMMA header of one acquisition."""
    lines = "date: %s  5 4 3.25\nradar_frequency: %.1f Hz\nincidence_angle: %.4f degrees\nheading: -169.5 degrees\nazimuth_angle: 90.0 degrees\nrange_pixel_spacing: 7.5 m\nazimuth_pixel_spacing: 14.0 m\nprf: 1600.5 Hz\nnear_range_slc: 800000.0 m\nsar_to_earth_center: 7152000.0 m\nearth_semi_major_axis: 6378137.0 m\nearth_semi_minor_axis: 6356752.3141 m\nrange_samples: 500\nrange_looks: 2\nazimuth_lines: 3000\nazimuth_looks: 8\n"
    return F.format_string(lines, F.date_format(date, "yyyy MM dd"), F.lit(5405000000.0) + F.col("ifg_id") * 1e6, incidence)


@query(
    """SELECT ifg_id, first_date, second_date, round(time_span, 6) AS time_span, '05:04:3.25' AS first_time, round(3e8::DOUBLE / (5405000000::DOUBLE + ifg_id * 1000000), 9) AS wavelength, round(30 + 0.01::DOUBLE * ifg_id + 0.025::DOUBLE, 6) AS incidence,
  16 AS ncols, 12 AS nrows, round(-34.2::DOUBLE, 6) AS lat, CASE WHEN ifg_id % 2 = 1 THEN 'initial' ELSE 'precise' END AS which, round(CASE WHEN ifg_id % 2 = 1 THEN 7.5 ELSE 10 + ifg_id END, 3)::DOUBLE AS baseline_c, round(0.25::DOUBLE, 3) AS rate_n FROM ifgs"""
)
def gamma_headers(spark, sf):
    """Headers of interferograms from the texts of their epochs, DEM and
    baseline, joined by interferogram."""
    _, ifgs = stack(spark, sf)
    incidence = F.lit(30.0) + F.lit(0.01) * F.col("ifg_id")
    precise = F.when(F.col("ifg_id") % 2 == 1, "0.0 0.0 0.0").otherwise(F.format_string("0.5 %.1f -3.0", F.lit(10.0) + F.col("ifg_id")))
    baseline = F.concat(F.lit("initial_baseline(TCN):  0.5 7.5 -2.0 m m m\ninitial_baseline_rate: 0.0 0.1 0.25 m/s m/s m/s\nprecision_baseline(TCN): "), precise, F.lit(" m m m\nprecision_baseline_rate: 0.0 0.1 0.25 m/s m/s m/s\n"))
    dem = F.lit("width: 16\nnlines: 12\ncorner_lat: -34.2 decimal degrees\ncorner_lon: 150.9 decimal degrees\npost_lat: -0.0008 decimal degrees\npost_lon: 0.0008 decimal degrees\nellipsoid_name: WGS 84\n")
    texts = ifgs.select("ifg_id", _epoch_text("first_date", incidence).alias("a"), _epoch_text("second_date", incidence + F.lit(0.05)).alias("b"), dem.alias("dem"), baseline.alias("baseline"))

    def parse(x):
        h = headers.gamma(x["dem"], [x["a"], x["b"]], x["baseline"])
        which = "precise" if x["ifg_id"] % 2 == 0 else "initial"
        return {"ifg_id": x["ifg_id"], "first_date": h["FIRST_DATE"], "second_date": h["SECOND_DATE"], "time_span": h["TIME_SPAN_YEAR"], "first_time": h["FIRST_TIME"], "wavelength": h["WAVELENGTH_METRES"], "incidence": h["INCIDENCE_DEGREES"], "ncols": h["NCOLS"], "nrows": h["NROWS"], "lat": h["LAT"], "which": which, "baseline_c": h["BASELINE_C"], "rate_n": h["BASELINE_RATE_N"]}

    found = _parsed(texts, parse, "ifg_id int, first_date date, second_date date, time_span double, first_time string, wavelength double, incidence double, ncols int, nrows int, lat double, which string, baseline_c double, rate_n double")
    return found.select("ifg_id", "first_date", "second_date", r("time_span").alias("time_span"), "first_time", r("wavelength", 9).alias("wavelength"), r("incidence").alias("incidence"), "ncols", "nrows", r("lat").alias("lat"), "which", r("baseline_c", 3).alias("baseline_c"), r("rate_n", 3).alias("rate_n"))


@query("SELECT ifg_id, first_date, second_date, round(time_span, 6) AS time_span, 16 AS ncols, 12 AS nrows, round(150.9::DOUBLE + 16 * 0.0008::DOUBLE, 6) AS x_last, round(0.05 + 0.001::DOUBLE * ifg_id, 6) AS wavelength, 'ORIGINAL_IFG' AS data_type FROM ifgs UNION ALL SELECT -1, NULL, NULL, NULL, 16, 12, round(150.9::DOUBLE + 16 * 0.0008::DOUBLE, 6), NULL, 'ORIGINAL_DEM'")
def roipac_headers(spark, sf):
    """Headers in the other format, of all interferograms and a DEM; dates
    stand in the text or in the file's name."""
    _, ifgs = stack(spark, sf)
    grid = "WIDTH 16\nFILE_LENGTH 12\nX_FIRST 150.9\nY_FIRST -34.2\nX_STEP 0.0008\nY_STEP -0.0008\n"
    dates = F.concat_ws("-", F.date_format("first_date", "yyMMdd"), F.date_format("second_date", "yyMMdd"))
    stamp = F.when(F.col("ifg_id") % 2 == 0, F.concat(F.lit("DATE x\nDATE12 "), dates, F.lit("\n"))).otherwise("")
    texts = ifgs.select("ifg_id", F.concat(F.lit(grid), stamp, F.format_string("WAVELENGTH %.4f\n", F.lit(0.05) + F.lit(0.001) * F.col("ifg_id"))).alias("text"), F.concat(F.lit("geo_"), dates, F.lit(".unw.rsc")).alias("name"))
    texts = texts.union(spark.createDataFrame([(-1, grid + "DATUM WGS84\n", "dem.rsc")], "ifg_id int, text string, name string"))

    def parse(x):
        h = headers.roipac(x["text"], x["name"])
        return {"ifg_id": x["ifg_id"], "first_date": h.get("FIRST_DATE"), "second_date": h.get("SECOND_DATE"), "time_span": h.get("TIME_SPAN_YEAR"), "ncols": h["NCOLS"], "nrows": h["NROWS"], "x_last": h["X_LAST"], "wavelength": h.get("WAVELENGTH_METRES"), "data_type": h["DATA_TYPE"]}

    found = _parsed(texts, parse, "ifg_id int, first_date date, second_date date, time_span double, ncols int, nrows int, x_last double, wavelength double, data_type string")
    return found.select("ifg_id", "first_date", "second_date", r("time_span").alias("time_span"), "ncols", "nrows", r("x_last").alias("x_last"), r("wavelength").alias("wavelength"), "data_type")


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 8 AS k, 'in/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.unw' WHEN 1 THEN '.a.tif' ELSE '' END AS path FROM part)
SELECT p_partkey, ['interferogram', 'coherence', 'baseline', 'lookup', 'incidence', 'dem', 'unknown', 'interferogram'][k + 1] AS kind, CASE WHEN k = 7 THEN 2 WHEN k = 6 THEN 0 ELSE 1 END::INT AS kept,
  'out/' || p_partkey || ['_unw', '.a_tif', ''][p_partkey % 3 + 1] || '.tif' AS converted, 'out/' || p_partkey || ['_unw', '.a_tif', ''][p_partkey % 3 + 1] || '_ifg.tif' AS sampled FROM p"""
)
def file_manifest(spark, sf):
    """Kind by metadata, metadata pruned by kind, and names of outputs."""
    keys = [*metadata.KINDS.values(), "OTHER"]
    k = F.col("p_partkey") % 8
    own = F.create_map(F.lit("X"), F.lit("1"))
    own = F.map_concat(own, F.element_at(F.array(*[F.create_map(F.lit(key), F.lit("1")) for key in keys], F.create_map(F.lit(keys[0]), F.lit("1"), F.lit(keys[5]), F.lit("1"))), (k + 1).cast("int")))
    path = F.concat(F.lit("in/"), F.col("p_partkey").cast("string"), F.element_at(F.array(F.lit(".unw"), F.lit(".a.tif"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")))
    parts = read(spark, sf, "part").select("p_partkey", path.alias("path"), metadata.kind_of(own).alias("kind"), F.size(metadata.prune(own, [*metadata.KINDS.values()])).alias("kept"))
    named = metadata.manifest(parts.select("path"), "out/")
    return parts.join(named, "path").select("p_partkey", "kind", "kept", "converted", "sampled")


@query("SELECT 'missing' AS fault, p_partkey || '_20200101.tif' AS path FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'few', p_partkey || '_20200101.tif' FROM part WHERE p_partkey % 7 <> 0")
def file_list_faults(spark, sf):
    """A list of files written and read back: those that don't exist, and
    those with fewer than two dates in their names."""
    listing = read(spark, sf, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit("_20200101.tif")).alias("path"))
    folder = shared_folder(spark, "lists")
    listing.select(F.concat(F.lit(" "), "path", F.lit("\n")).alias("value")).write.text(folder)
    found = spark.read.text(folder).select(F.trim("value").alias("path")).filter("path <> ''")
    there = listing.filter("p_partkey % 5 <> 0").select("path")
    named = listing.select("path", F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("20190101-"), "path")).otherwise(F.col("path")).alias("full"))
    few = metadata.few_epochs(found.join(named, "path").select(F.col("full").alias("path")), 2)
    return metadata.missing(found, there).select(F.lit("missing").alias("fault"), "path").union(few.select(F.lit("few"), "path"))


@query("SELECT p_partkey, max(k)::BIGINT AS a, (p_partkey // max(k))::BIGINT AS b, max(k) = p_partkey // max(k) AS square FROM part, (SELECT unnest(range(1, 1000)) AS k) WHERE k * k <= p_partkey AND p_partkey % k = 0 GROUP BY p_partkey")
def near_factors(spark, sf):
    """Two factors as near as can be, and whether they make a square, of each
    distinct key. Its SQL tries factors up to 999 only; this tries all."""
    rows = read(spark, sf, "part").select("p_partkey").filter("p_partkey > 0").distinct()

    def parse(x):
        import numpy as np

        a, b = rasters.two_factors(x["p_partkey"])
        # A view of one cell, as a x b cells needn't fit in memory.
        return {"p_partkey": x["p_partkey"], "a": a, "b": b, "square": kernels.is_square(np.broadcast_to(False, (a, b)))}

    return _parsed(rows, parse, "p_partkey long, a long, b long, square boolean")


MERCATOR = """
WITH s AS (SELECT s_suppkey, -79.5::DOUBLE + (s_suppkey * 37) % 160 AS lat, -179.5::DOUBLE + (s_suppkey * 53) % 358 AS lon FROM supplier),
p AS (SELECT s_suppkey, 0 AS k, lat, lon, floor((lon + 180) / 6) + 1 AS zone FROM s UNION ALL SELECT s_suppkey, 1, lat - 0.0008::DOUBLE, lon + 0.0008::DOUBLE, floor((lon + 180) / 6) + 1 FROM s),
c AS (SELECT *, (1 / 298.257223563::DOUBLE) / (2 - 1 / 298.257223563::DOUBLE) AS n, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS lam FROM p),
e AS (SELECT *, 2 * sqrt(n) / (1 + n) AS e FROM c),
t AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM e),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS radius FROM t),
m AS (SELECT s_suppkey, k, radius * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS east, radius * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS north FROM x)
SELECT a.s_suppkey, round(abs(b.east - a.east), 4) AS east, round(abs(b.north - a.north), 4) AS north FROM m a JOIN m b ON a.s_suppkey = b.s_suppkey AND a.k = 0 AND b.k = 1
"""


@query(MERCATOR)
def cell_sizes(spark, sf):
    """Metres of a cell at each supplier's place, through transverse Mercator."""
    rows = read(spark, sf, "supplier").select("s_suppkey", (F.lit(-79.5) + (F.col("s_suppkey") * 37) % 160).alias("lat"), (F.lit(-179.5) + (F.col("s_suppkey") * 53) % 358).alias("lon"))

    def parse(x):
        east, north = kernels.cell_size(x["lat"], x["lon"], 0.0008, -0.0008)
        return {"s_suppkey": x["s_suppkey"], "east": east, "north": north}

    found = _parsed(rows, parse, "s_suppkey long, east double, north double")
    return found.select("s_suppkey", r("east", 4).alias("east"), r("north", 4).alias("north"))


@query('SELECT ifg_id, r2 AS "row", c2 AS col, round(phase, 6) AS phase FROM phase, (SELECT unnest(range(0, 24))::INT AS r2), (SELECT unnest(range(0, 40))::INT AS c2) WHERE "row" = floor((r2 + 0.5) * 0.5) AND col = floor((c2 + 0.5) * 0.4)')
def nearest_finer(spark, sf):
    """Nearest-neighbour resampling to smaller cells."""
    phase, _ = stack(spark, sf)
    return rasters.nearest(phase, 0.4, 0.5).select("ifg_id", "row", "col", r("phase").alias("phase"))


@query(f'WITH v AS (SELECT ifg_id, time_span, {VARIANCE} AS variance FROM ifgs), w AS (SELECT "row", col, 1 / sqrt(sum(time_span * time_span / variance)) AS error FROM phase JOIN v USING (ifg_id) WHERE phase IS NOT NULL GROUP BY "row", col) SELECT round(100 * avg((error > 0.105)::INT), 6) AS masked_percent FROM w')
def masked_percent(spark, sf):
    """Percent of the pixels with a rate whose error is above the limit."""
    phase, ifgs = stack(spark, sf)
    rates = inversion.weighted_rate(phase, ifgs.withColumn("variance", (1 + F.col("ifg_id") % 4).cast("double")))
    return units.masked_percent(rates, 0.105).select(r("masked_percent").alias("masked_percent"))


@query('WITH b AS (SELECT min(col) FILTER (phase IS NOT NULL) AS c0, max(col) FILTER (phase IS NOT NULL) + 1 AS c1, min("row") FILTER (phase IS NOT NULL) AS r0, max("row") FILTER (phase IS NOT NULL) + 1 AS r1 FROM phase GROUP BY ifg_id) SELECT \'intersection\' AS how, round(150.9::DOUBLE + max(c0) * 0.0008::DOUBLE, 6) AS x_first, round(150.9::DOUBLE + min(c1) * 0.0008::DOUBLE, 6) AS x_last, round(-34.2::DOUBLE - max(r0) * 0.0008::DOUBLE, 6) AS y_first, round(-34.2::DOUBLE - min(r1) * 0.0008::DOUBLE, 6) AS y_last FROM b UNION ALL SELECT \'union\', round(150.9::DOUBLE + min(c0) * 0.0008::DOUBLE, 6), round(150.9::DOUBLE + max(c1) * 0.0008::DOUBLE, 6), round(-34.2::DOUBLE - min(r0) * 0.0008::DOUBLE, 6), round(-34.2::DOUBLE - max(r1) * 0.0008::DOUBLE, 6) FROM b')
def stack_extents(spark, sf):
    """Crop extents of the whole stack, from all cells with data."""
    phase, _ = stack(spark, sf)
    x, y = lambda c: F.lit(150.9) + c * F.lit(0.0008), lambda c: F.lit(-34.2) - c * F.lit(0.0008)
    boxes = phase.filter(F.col("phase").isNotNull()).groupBy("ifg_id").agg(x(F.min("col")).alias("x_first"), x(F.max("col") + 1).alias("x_last"), y(F.min("row")).alias("y_first"), y(F.max("row") + 1).alias("y_last"))
    out = [rasters.extents(boxes, how).select(F.lit(how).alias("how"), *[r(c).alias(c) for c in ("x_first", "x_last", "y_first", "y_last")]) for how in ("intersection", "union")]
    return out[0].union(out[1])


@query(
    """WITH s AS (SELECT s_suppkey, s_suppkey % 12 AS looks, 2 * (s_suppkey % 6) + s_suppkey % 7 // 6 + 1 AS chip, 1 + s_suppkey % 9 AS n FROM supplier),
v AS (SELECT *, looks >= 1 AND chip % 2 = 1 AS valid FROM s)
SELECT s_suppkey, valid, CASE WHEN valid THEN looks END::INT AS looks, CASE WHEN valid THEN chip END::INT AS chip, CASE WHEN valid THEN 2 END::INT AS steps,
  CASE WHEN valid THEN [1, 1, 1, 2, 1, 2, 1, 2, 3][n]::INT * 100 + [1, 2, 3, 2, 5, 3, 7, 4, 3][n]::INT END::INT AS tiles FROM v"""
)
def configurations(spark, sf):
    """Configuration files parsed, written and parsed again; those with a
    value out of range or an even chip are errors."""
    needed = "".join(f"{k}: x\n" for k, v in PARAMETERS.items() if v[1] is REQUIRED and k not in ("ifglksx", "refchipsize"))
    text = F.concat(F.lit(needed + "# a comment\nifglksx: "), (F.col("s_suppkey") % 12).cast("string"), F.lit("\nrefchipsize = "), (2 * (F.col("s_suppkey") % 6) + F.floor(F.col("s_suppkey") % 7 / 6) + 1).cast("string"), F.lit("  # inline\nprocesses: "), (1 + F.col("s_suppkey") % 9).cast("string"), F.lit("\n[correct]\nsteps =\n  orbfit\n  refphase\n"))

    def parse(x):
        try:
            c = Config.parse(Config.parse(x["text"]).text())
        except ConfigError:
            return {"s_suppkey": x["s_suppkey"], "valid": False, "looks": None, "chip": None, "steps": None, "tiles": None}
        return {"s_suppkey": x["s_suppkey"], "valid": True, "looks": c["ifglksx"], "chip": c["refchipsize"], "steps": len(c.steps), "tiles": c.tiles[0] * 100 + c.tiles[1]}

    return _parsed(read(spark, sf, "supplier").select("s_suppkey", text.alias("text")), parse, "s_suppkey long, valid boolean, looks int, chip int, steps int, tiles int")


@query('SELECT ifg_id, round(regr_intercept(phase, x), 5) AS intercept, round(regr_slope(phase, x), 5) AS slope FROM (SELECT ifg_id, phase, col::DOUBLE AS x, unnest(range(1 + "row" % 3)) AS again FROM phase WHERE phase IS NOT NULL) GROUP BY ifg_id')
def weighted_least_squares(spark, sf):
    """A line along the columns of each image, rows with variances of 1, 1/2
    and 1/3 (as if they were there once, twice and three times)."""

    def fit(key, pdf):
        import numpy as np
        import pandas as pd

        a = np.column_stack([np.ones(len(pdf)), pdf["col"]])
        x = kernels.weighted_least_squares(a, pdf["phase"].to_numpy(), 1 / (1 + pdf["row"].to_numpy() % 3))
        return pd.DataFrame({"ifg_id": [key[0]], "intercept": [x[0]], "slope": [x[1]]})

    phase, _ = stack(spark, sf)
    rows = phase.filter(F.col("phase").isNotNull()).select("ifg_id", "row", "col", "phase")
    found = rows.groupBy("ifg_id").applyInPandas(fit, "ifg_id int, intercept double, slope double")
    return found.select("ifg_id", r("intercept", 5).alias("intercept"), r("slope", 5).alias("slope"))


@query(
    """WITH p AS (SELECT "row", col, max(round(phase, 3)) FILTER (ifg_id % 2 = 0) AS a, max(round(phase, 3)) FILTER (ifg_id % 2 = 1) AS b FROM phase GROUP BY "row", col),
g AS (SELECT r::INT AS "row", c::INT AS col FROM (SELECT unnest(range(12)) AS r), (SELECT unnest(range(16)) AS c))
SELECT (("row" - 1) // 3)::INT AS "row", ((col - 1) // 2)::INT AS col, nullif(coalesce(a, 0), 0) AS range_px, nullif(coalesce(b, 0), 0) AS azimuth_px FROM g LEFT JOIN p USING ("row", col) WHERE "row" % 3 = 1 AND col BETWEEN 1 AND 14 AND col % 2 = 1"""
)
def radar_lookup(spark, sf):
    """A lookup table of pairs written and read back, at the middle of each
    look window of a crop; 0 is no data. Its bands are the greatest phases of
    the interferograms with even and with odd ids."""
    phase, _ = stack(spark, sf)
    bands = phase.groupBy("row", (2 * F.col("col") + F.col("ifg_id") % 2).alias("col")).agg(F.max("phase").alias("value")).filter("value IS NOT NULL")
    folder = shared_folder(spark, "lookup")
    files.save(files.images(bands.withColumn("name", F.lit("table")), ROWS, 2 * COLS, lambda _, image: files.gamma_bytes(image)), folder)
    table = files.read_lookup(spark, f"{folder}/table", ROWS, COLS)
    found = geometry.sampled_lookup(table, 2, 3, 1, 15, 0, ROWS)
    return found.select("row", "col", r("range_px", 3).alias("range_px"), r("azimuth_px", 3).alias("azimuth_px"))
