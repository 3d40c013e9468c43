"""The processing chain: tables in, tables out, a folder of Parquet between.

conv2tif reads raw rasters; prepifg masks, crops and multi-looks them; correct
finds the reference and applies the corrections in order; timeseries and stack
invert; merge masks, projects and writes the products. A step reads what the
one before wrote, so each can be run again by itself.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.config import Config
from phasegrid.functions import geometry
from phasegrid.functions.kernels import cell_size
from phasegrid.model import Grid, Network
from phasegrid.operators import aps, closure, dem, inversion, network, orbital, rasters, reference, units
from phasegrid.sources import headers
from phasegrid.sources import rasters as files

log = logging.getLogger("phasegrid")
DEGREES = {1: "planar", 2: "quadratic", 3: "part_cubic"}
DIRECTIONS = {0: "los", 1: "vertical", 2: "horizontal"}
PROJECTED = ("tsincr", "tscuml", "linear_rate", "stack_rate")


@dataclass(frozen=True)
class State:
    """What a correction step takes and returns."""

    phase: DataFrame
    ifgs: DataFrame
    net: Network
    grid: Grid
    config: Config
    folder: str
    reference: tuple[int, int] | None = None
    vcm: list[list[float]] | None = None


def save(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table of the chain and return it as read again."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables that an earlier run of the chain left, lest they be taken
    for this run's."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def grid_of(header: dict) -> Grid:
    """The grid of a header, with the size of its centre cell in metres."""
    out = Grid(header["NROWS"], header["NCOLS"], header["LONG"], header["LAT"], header["X_STEP"], header["Y_STEP"])
    return replace(out, **dict(zip(("x_size", "y_size"), cell_size(*out.centre(), out.x_step, out.y_step))))


def _headers(spark: SparkSession, config: Config, paths: list[str]) -> dict[str, dict]:
    """The combined header of every raster."""
    listed = headers.file_list(spark, config["hdrfilelist"])
    bases = headers.file_list(spark, config["basefilelist"]) if config["basefilelist"] else []
    texts = headers.read_texts(spark, [*listed, *bases, config["demHeaderFile"]])
    dem_text = texts[config["demHeaderFile"]]
    if config["processor"] == 0:
        named = {}
        for p in paths:
            own = next((h for h in listed if headers.dates_in(h) == headers.dates_in(p)), None)
            if own is None:
                raise headers.HeaderError(f"{p} has no header")
            named[p] = headers.roipac(texts[own], own)
        return named
    out = {}
    for p in paths:
        base = headers.baseline_path(p, bases)
        out[p] = headers.gamma(dem_text, [texts[h] for h in headers.header_paths(p, listed)], texts[base] if base else None)
    return out


def conv2tif(spark: SparkSession, config: Config) -> DataFrame:
    """Raw rasters as tables: raw_phase, ifgs, raw_dem and, where there is
    any, raw_coherence."""
    out, paths = config["outdir"], sorted(headers.file_list(spark, config["ifgfilelist"]))
    if few := [p for p in paths if len(headers.dates_in(p)) < 2]:
        raise headers.HeaderError(f"fewer than two dates in the names of {few}")
    found = _headers(spark, config, paths)
    dem_text = headers.read_texts(spark, [config["demHeaderFile"]])[config["demHeaderFile"]]
    dem_head = headers.roipac(dem_text, config["demHeaderFile"]) if config["processor"] == 0 else headers.gamma_dem(dem_text)
    read = files.read_roipac if config["processor"] == 0 else files.read_gamma

    def stack(names: list[str], value: str) -> DataFrame:
        rows = None
        for i, p in enumerate(names):
            own = read(spark, p, found[p]).select(F.lit(i).alias("ifg_id"), "row", "col", F.col("value").alias(value))
            rows = own if rows is None else rows.unionByName(own)
        return rows

    phase = save(stack(paths, "phase"), out, "raw_phase")
    keys = ("WAVELENGTH_METRES", "TIME_SPAN_YEAR")
    rows = [(i, p, h["FIRST_DATE"], h["SECOND_DATE"], float(h[keys[1]]), float(h[keys[0]]), {k: str(v) for k, v in h.items()}) for i, (p, h) in enumerate(found.items())]
    save(spark.createDataFrame(rows, "ifg_id int, path string, first_date date, second_date date, time_span double, wavelength double, metadata map<string,string>"), out, "ifgs")
    save(read(spark, config["demfile"], dem_head).withColumnRenamed("value", "height"), out, "raw_dem")
    save(spark.createDataFrame([tuple(map(float, (dem_head["NROWS"], dem_head["NCOLS"], dem_head["LONG"], dem_head["LAT"], dem_head["X_STEP"], dem_head["Y_STEP"])))], "nrows double, ncols double, x_first double, y_first double, x_step double, y_step double"), out, "raw_grid")
    if config["cohfilelist"]:
        names = sorted(headers.file_list(spark, config["cohfilelist"]))
        by_dates = {tuple(headers.dates_in(p)[:2]): p for p in names}
        if len(by_dates) < len(names):
            raise headers.HeaderError("more than one coherence file for a pair of dates")
        rows = None
        for i, p in enumerate(paths):
            if (c := by_dates.get(tuple(headers.dates_in(p)[:2]))) is not None:
                own = files.read_gamma(spark, c, dem_head).select(F.lit(i).alias("ifg_id"), "row", "col", F.col("value").alias("coh"))
                rows = own if rows is None else rows.unionByName(own)
        if rows is not None:
            save(rows, out, "raw_coherence")
    return phase


def _grid(spark, folder: str, name: str) -> Grid:
    r = load(spark, folder, name).first()
    out = Grid(int(r["nrows"]), int(r["ncols"]), r["x_first"], r["y_first"], r["x_step"], r["y_step"])
    return replace(out, **dict(zip(("x_size", "y_size"), cell_size(*out.centre(), out.x_step, out.y_step))))


def _window(config: Config, grid: Grid) -> tuple[int, int, int, int]:
    """Rows and columns of the crop: all rasters share a grid, so only a
    custom crop leaves anything out; its edges go to the nearest cells."""
    if config["ifgcropopt"] != 3:
        return 0, 0, grid.nrows, grid.ncols

    def at(value, first, step, size):
        n = round((value - first) / step)
        if not 0 <= n <= size:
            raise ValueError("the crop is outside the rasters")
        return n

    left, right = sorted(at(config[k], grid.x_first, grid.x_step, grid.ncols) for k in ("ifgxfirst", "ifgxlast"))
    top, bottom = sorted(at(config[k], grid.y_first, grid.y_step, grid.nrows) for k in ("ifgyfirst", "ifgylast"))
    return top, left, bottom, right


def prepifg(spark: SparkSession, config: Config) -> DataFrame:
    """Masked, cropped and multi-looked phase, DEM, coherence and geometry."""
    out, x, y = config["outdir"], config["ifglksx"], config["ifglksy"]
    rasters.check_looks(x, y)
    grid = _grid(spark, out, "raw_grid")
    top, left, bottom, right = _window(config, grid)
    cropped = replace(grid, nrows=bottom - top, ncols=right - left, x_first=grid.x_first + left * grid.x_step, y_first=grid.y_first + top * grid.y_step)
    new = rasters.looked(cropped, x, y)
    # A threshold of 0 would empty every cell; it stands for any valid cell.
    share = config["noDataAveragingThreshold"] or 1.0
    phase = load(spark, out, "raw_phase").withColumn("phase", units.null_nodata(F.col("phase"), config["noDataValue"]))
    has_coherence = bool(config["cohfilelist"])
    if config["cohmask"]:
        phase = units.mask_coherence(phase, load(spark, out, "raw_coherence"), config["cohthresh"])
    phase = save(rasters.multilook(rasters.crop(phase, top, left, bottom, right), cropped, x, y, share), out, "phase")
    save(rasters.nan_fraction(phase), out, "nan_fraction")
    height = rasters.crop(load(spark, out, "raw_dem"), top, left, bottom, right)
    heights = save(rasters.multilook(height, cropped, x, y, 1.0, by=(), value="height"), out, "dem")
    if has_coherence:
        coh = rasters.multilook(rasters.crop(load(spark, out, "raw_coherence"), top, left, bottom, right), cropped, x, y, 1.0, value="coh")
        save(rasters.coherence_stats(save(coh, out, "coherence")), out, "coherence_statistics")
    save(spark.createDataFrame([(float(new.nrows), float(new.ncols), new.x_first, new.y_first, new.x_step, new.y_step)], "nrows double, ncols double, x_first double, y_first double, x_step double, y_step double"), out, "grid")
    if config["ltfile"]:
        table = files.read_lookup(spark, config["ltfile"], grid.nrows, grid.ncols)
        radar = geometry.sampled_lookup(table, x, y, left, right, top, bottom)
        lon, lat = geometry.lonlat(new)
        pixels = radar.join(heights, ["row", "col"]).withColumn("lon", lon).withColumn("lat", lat)
        meta = load(spark, out, "ifgs").orderBy("ifg_id").first()["metadata"]
        save(geometry.pixel_geometry(pixels, angle_meta(meta)), out, "geometry")
    else:
        log.info("no lookup table: no geometry")
        discard(spark, out, "geometry")
    return phase


def angle_meta(meta: dict) -> dict:
    return {"semi_major": float(meta["SEMI_MAJOR_AXIS_METRES"]), "semi_minor": float(meta["SEMI_MINOR_AXIS_METRES"]), "sar_to_earth": float(meta["SAR_EARTH_METRES"]), "near_range": float(meta["NEAR_RANGE_METRES"]), "range_pixel": float(meta["RANGE_PIX_METRES"]), "heading": float(meta["HEADING_DEGREES"]), "look_direction": float(meta["AZIMUTH_DEGREES"])}


def _net(ifgs: DataFrame, fractions: DataFrame) -> Network:
    return Network.of(ifgs.select("ifg_id", "first_date", "second_date").join(fractions, "ifg_id").collect())


def orbfit(state: State) -> State:
    c = state.config
    if not c["orbfit"]:
        return state
    looks = c["orbfitlksx"], c["orbfitlksy"]
    coarse = coarse_grid = None
    if max(looks) > 1:
        coarse, coarse_grid = rasters.multilook(state.phase, state.grid, *looks, 1.0), rasters.looked(state.grid, *looks)
    settings = {"intercept": bool(c["orbfitintercept"]), "offset": bool(c["orbfitoffset"]), "coarse": coarse, "coarse_grid": coarse_grid}
    degree = DEGREES[c["orbfitdegrees"]]
    fitted = orbital.independent(state.phase, state.grid, degree, **settings) if c["orbfitmethod"] == 1 else orbital.by_network(state.phase, state.grid, state.net, degree, scale=float(c["orbfitscale"]), **settings)
    return replace(state, phase=orbital.corrected(fitted))


def refphase(state: State) -> State:
    c = state.config
    ref = reference.phase_by_image(state.phase) if c["refest"] == 1 else reference.phase_by_chip(state.phase, *state.reference, c["refchipsize"], c["refminfrac"])
    return replace(state, phase=reference.subtract(state.phase, ref))


def demerror(state: State) -> State:
    c = state.config
    if not c["demerror"]:
        return state
    spark = state.phase.sparkSession
    geo = load(spark, state.folder, "geometry")
    number = lambda k: F.col("metadata")[k].cast("double")
    meta = F.struct(*[number(k).alias(n) for n, k in (("azimuth_n", "AZIMUTH_N"), ("azimuth_looks", "AZIMUTH_LOOKS"), ("prf", "PRF_HERTZ"), ("base_c", "BASELINE_C"), ("base_n", "BASELINE_N"), ("rate_c", "BASELINE_RATE_C"), ("rate_n", "BASELINE_RATE_N"))])
    ifgs = state.ifgs.select("ifg_id", meta.alias("meta"))
    bperp = geo.join(F.broadcast(ifgs)).select("ifg_id", "row", "col", geometry.perpendicular_baseline(F.col("azimuth_px"), F.col("look_angle"), F.col("meta")).alias("bperp"))
    fitted = save(dem.fit(state.phase, bperp, state.ifgs, c["de_pthr"]), state.folder, "dem_fit")
    save(dem.errors(fitted, geo), state.folder, "dem_error")
    cut = rasters.tiles(state.grid.nrows, state.grid.ncols, *c.tiles)
    save(dem.mean_baseline(rasters.with_tiles(bperp, cut)), state.folder, "mean_baseline")
    return replace(state, phase=dem.correct(state.phase, bperp, fitted))


def phase_closure(state: State) -> State:
    c = state.config
    if not c["phase_closure"]:
        return state
    near = state.phase.join(F.broadcast(state.ifgs.select("ifg_id", "wavelength")), "ifg_id")
    radians = near.select("ifg_id", "row", "col", units.mm_to_radians(F.col("phase"), F.col("wavelength")).alias("phase"))
    found = closure.iterate(radians, state.net, longest=c["max_loop_length"], redundancy=c["max_loop_redundancy"], threshold=c["closure_thr"], drop_threshold=c["ifg_drop_thr"], min_loops=c["min_loops_per_ifg"], subtract_median=bool(c["subtract_median"]))
    for name, table in (("loops", found.loops), ("closure", found.closure), ("breaches", found.breaches), ("occurrences", closure.occurrences(found.loops))):
        save(table, state.folder, name)
    kept = [i.ifg_id for i in found.network.ifgs]
    masked = closure.mask(state.phase.filter(F.col("ifg_id").isin(kept)), found.breaches, closure.occurrences(found.loops))
    # Interferograms are numbered anew, as kernels index them by position.
    new = {old: i for i, old in enumerate(kept)}
    ids = F.broadcast(state.phase.sparkSession.createDataFrame(list(new.items()), "ifg_id int, new_id int"))
    renamed = lambda df: df.join(ids, "ifg_id").drop("ifg_id").withColumnRenamed("new_id", "ifg_id")
    net = Network(tuple(replace(i, ifg_id=new[i.ifg_id]) for i in found.network.ifgs), found.network.dates)
    return replace(state, phase=renamed(masked).select("ifg_id", "row", "col", "phase"), ifgs=renamed(state.ifgs), net=net)


def mst(state: State) -> State:
    trees = network.pixel_trees(network.pixel_stack(state.phase, len(state.net.ifgs)), state.net)
    save(trees.select("row", "col", "mst"), state.folder, "mst")
    return state


def _stacked(state: State) -> DataFrame:
    """Pixels with their observations and spanning trees, of the phase as it
    is when the trees are needed."""
    stack = network.pixel_stack(state.phase, len(state.net.ifgs))
    spark = state.phase.sparkSession
    try:
        trees = load(spark, state.folder, "mst")
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return network.pixel_trees(stack, state.net)
    return stack.join(trees, ["row", "col"], "left")


def apscorrect(state: State) -> State:
    c = state.config
    if not c["apsest"]:
        return state
    series = inversion.increments(inversion.velocities(_stacked(state), state.net, least=c["ts_pthr"]), state.net).select("row", "col", "epoch_idx", "tsincr")
    high = save(aps.temporal_highpass(series, state.net, c["tlpfcutoff"], c["tlpfpthr"]), state.folder, "ts_highpass")
    low = aps.spatial_lowpass(high, state.grid, c["slpfcutoff"], fill=c["slpnanfill_method"] if c["slpnanfill"] else None)
    spans = network.members(state.ifgs, network.epochs(state.ifgs)).select("ifg_id", (F.col("epoch_idx") + 1).alias("epoch_idx"))
    return replace(state, phase=aps.correct(state.phase, aps.correction(low, spans)))


def maxvar(state: State) -> State:
    found = save(aps.distance_covariance(state.phase, state.grid), state.folder, "covariance")
    by_id = {r["ifg_id"]: r["maxvar"] for r in found.collect()}
    vcm = network.covariance_matrix(state.net, [by_id[i.ifg_id] for i in state.net.ifgs]).tolist()
    save(state.phase.sparkSession.createDataFrame([(i, row) for i, row in enumerate(vcm)], "i int, row array<double>"), state.folder, "vcm")
    return replace(state, vcm=vcm)


CORRECTIONS = {"orbfit": orbfit, "refphase": refphase, "demerror": demerror, "phase_closure": phase_closure, "mst": mst, "apscorrect": apscorrect, "maxvar": maxvar}


def correct(spark: SparkSession, config: Config) -> DataFrame:
    """Millimetres, the reference pixel, then the steps in order; the result
    of each is a table, so a step's plan starts from a scan."""
    out = config["outdir"]
    discard(spark, out, "mst", "vcm")
    ifgs, grid = load(spark, out, "ifgs"), _grid(spark, out, "grid")
    phase = units.convert(load(spark, out, "phase"), ifgs.withColumn("units", F.lit("RADIANS")), nan_conversion=bool(config["nan_conversion"]), nodata=config["noDataValue"])
    phase = save(phase, out, "correct_0")
    chip, fraction = config["refchipsize"], config["refminfrac"]
    row, col = reference.reference_pixel(phase, grid, **_pinned(config, grid), nx=config["refnx"], ny=config["refny"], chip=chip, min_fraction=fraction)
    save(reference.area_stats(phase, row, col, chip).withColumn("row", F.lit(row)).withColumn("col", F.lit(col)), out, "reference")
    state = State(phase, ifgs, _net(ifgs, load(spark, out, "nan_fraction")), grid, config, out, (row, col))
    for i, step in enumerate(config.steps, 1):
        log.info("correct: %s", step)
        before = state.phase
        state = CORRECTIONS[step](state)
        if state.phase is not before:
            state = replace(state, phase=save(state.phase, out, f"correct_{i}"))
    save(state.phase, out, "corrected")
    save(state.ifgs, out, "corrected_ifgs")
    return load(spark, out, "corrected")


def _pinned(config: Config, grid: Grid) -> dict:
    """The reference pixel that the configuration gives (degrees), or -1."""
    if config["refx"] == -1 or config["refy"] == -1:
        return {"refx": -1, "refy": -1}
    return {"refx": round((config["refx"] - grid.x_first) / grid.x_step), "refy": round((config["refy"] - grid.y_first) / grid.y_step)}


def _corrected(spark: SparkSession, config: Config) -> State:
    out = config["outdir"]
    phase, ifgs = load(spark, out, "corrected"), load(spark, out, "corrected_ifgs")
    vcm = [r["row"] for r in load(spark, out, "vcm").orderBy("i").collect()]
    return State(phase, ifgs, _net(ifgs, rasters.nan_fraction(phase)), _grid(spark, out, "grid"), config, out, None, vcm)


def timeseries(spark: SparkSession, config: Config) -> DataFrame:
    """tsincr and tscuml of each epoch, and the linear rate through them."""
    state, c = _corrected(spark, config), config
    found = inversion.velocities(_stacked(state), state.net, method=c["tsmethod"], least=c["ts_pthr"], vcm=state.vcm, smooth_order=c["smorder"] or 1, smooth_factor=c["smfactor"])
    series = save(inversion.increments(found, state.net), state.folder, "series")
    rate = inversion.linear_rate(inversion.with_zero_epoch(series), network.epochs(state.ifgs), nsig=float(c["velerror_nsig"]))
    return save(rate, state.folder, "linear_rate")


def stack(spark: SparkSession, config: Config) -> DataFrame:
    state, c = _corrected(spark, config), config
    out = inversion.stacked_rate(_stacked(state), state.net, state.vcm, nsig=c["nsig"], least=c["pthr"], error_nsig=float(c["velerror_nsig"]))
    return save(out, state.folder, "stack_rate")


def merge(spark: SparkSession, config: Config, export: bool = False) -> DataFrame:
    """products (product, epoch_idx, row, col, value): rates masked by their
    errors, displacements along the wanted direction. export: also GeoTIFFs,
    and quick looks of the rates."""
    c, out = config, config["outdir"]
    one = lambda df, name, value: df.select(F.lit(name).alias("product"), F.lit(None).cast("int").alias("epoch_idx"), "row", "col", F.col(value).cast("double").alias("value"))
    parts = []
    for name, extra in (("stack", ()), ("linear", ("intercept", "r2"))):
        rates = units.mask_rate(load(spark, out, f"{name}_rate"), float(c["maxsig"]))
        parts += [one(rates, f"{name}_{v}", v) for v in ("rate", "error", "samples", *extra)]
    series = load(spark, out, "series")
    for v in ("tscuml", *(("tsincr",) if c["savetsincr"] else ())):
        parts.append(series.select(F.lit(v).alias("product"), "epoch_idx", "row", "col", F.col(v).alias("value")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    angle = None
    try:
        angle = load(spark, out, "geometry").select("row", "col", F.col("incidence_angle").alias("incidence"))
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        log.info("no geometry: products stay along the line of sight")
    chosen = F.col("product").isin(*PROJECTED)
    moved = units.project(rows.filter(chosen), angle, DIRECTIONS[c["los_projection"]], c["signal_polarity"])
    rows = moved.unionByName(rows.filter(~chosen))
    rows.write.mode("overwrite").partitionBy("product").parquet(f"{out}/products")
    products = load(spark, out, "products")
    if export:
        _export(products, _grid(spark, out, "grid"), out)
    return products


def _export(products: DataFrame, grid: Grid, folder: str) -> None:
    name = F.concat_ws("_", "product", "epoch_idx")
    named = products.withColumn("name", name)
    tifs = files.geotiffs(named, grid.nrows, grid.ncols, grid.x_first, grid.y_first, grid.x_step, grid.y_step)
    files.save(tifs.withColumn("name", F.concat("name", F.lit(".tif"))), f"{folder}/export")
    shown = named.filter(F.col("product").isin("stack_rate", "stack_error", "linear_rate", "linear_error", "linear_r2"))

    def look(key: str, image) -> bytes:
        import numpy as np

        known = image[~np.isnan(image)]
        diverging = key.endswith("rate")
        top = float(np.abs(known).max()) if diverging and len(known) else float(known.max()) if len(known) else 1.0
        return files.png(image, -top if diverging else (float(known.min()) if len(known) else 0.0), top, diverging)

    files.save(files.images(shown, grid.nrows, grid.ncols, look).withColumn("name", F.concat("name", F.lit(".png"))), f"{folder}/export")
    box = files.kml("product", grid.y_first, grid.y_last, grid.x_last, grid.x_first)
    marks = shown.select("name").distinct().select(F.concat("name", F.lit(".kml")).alias("name"), F.replace(F.lit(box.decode()), F.lit("product"), F.col("name")).cast("binary").alias("content"))
    files.save(marks, f"{folder}/export")


COMMANDS = {"conv2tif": conv2tif, "prepifg": prepifg, "correct": correct, "timeseries": timeseries, "stack": stack, "merge": merge}


def workflow(spark: SparkSession, config: Config) -> DataFrame:
    """All of it, in order."""
    out = None
    for name, command in COMMANDS.items():
        log.info("%s", name)
        out = command(spark, config)
    return out

