"""Headers, rasters, the configuration and the whole chain on files."""

import math
import struct
import zlib
from datetime import date, timedelta

import numpy as np
import pytest

from phasegrid.__main__ import main
from phasegrid.config import Config, ConfigError, coerce
from phasegrid.sources import headers, rasters

EPOCH = """title: x
date:      {y} {m} {d} 12 30 15.25
center_time: 45015.25 s
radar_frequency: 5.334e+09 Hz
incidence_angle: {inc} degrees
heading: -166.1 degrees
azimuth_angle: 90.0 degrees
range_pixel_spacing: 7.8 m
azimuth_pixel_spacing: 4.0 m
prf: 1652.4 Hz
near_range_slc: 828000.5 m
sar_to_earth_center: 7157000.1 m
earth_semi_major_axis: 6378137.0 m
earth_semi_minor_axis: 6356752.3141 m
range_samples: 5000
range_looks: 1
azimuth_lines: 3000
azimuth_looks: 5
"""
DEM = "width: {w}\nnlines: {h}\ncorner_lat: -34.17 decimal degrees\ncorner_lon: 150.91 decimal degrees\npost_lat: -0.000833333 decimal degrees\npost_lon: 0.000833333 decimal degrees\nellipsoid_name: WGS 84\n"
BASE = "initial_baseline(TCN): 1.0 2.0 3.0 m m m\ninitial_baseline_rate: 0.1 0.2 0.3 m/s m/s m/s\nprecision_baseline(TCN): {p} m m m\nprecision_baseline_rate: 0.4 0.5 0.6 m/s m/s m/s\n"


def test_gamma_headers():
    a, b = EPOCH.format(y=2006, m=6, d=19, inc=22.9), EPOCH.format(y=2006, m=10, d=2, inc=22.95)
    both = headers.gamma(DEM.format(w=47, h=72), [a, b], BASE.format(p="0.0 0.0 0.0"))
    assert both["FIRST_DATE"] == date(2006, 6, 19) and both["NCOLS"] == 47 and both["DATUM"] == "WGS84"
    assert math.isclose(both["INCIDENCE_DEGREES"], 22.925) and math.isclose(both["WAVELENGTH_METRES"], 3e8 / 5.334e9)
    assert math.isclose(both["TIME_SPAN_YEAR"], 105 / 365.25) and both["BASELINE_C"] == 2.0
    assert headers.gamma(DEM.format(w=47, h=72), [a, b], BASE.format(p="7 8 9"))["BASELINE_RATE_N"] == 0.6
    assert headers.gamma(DEM.format(w=4, h=7), [])["DATA_TYPE"] == "ORIGINAL_DEM"
    for bad in ([b, a], [a, a], [a, b, b], [a, EPOCH.format(y=2007, m=1, d=1, inc=25.0)], [a.replace("Hz", "kHz"), b]):
        with pytest.raises(headers.HeaderError):
            headers.gamma(DEM.format(w=47, h=72), bad)


def test_roipac_headers():
    text = "WIDTH 47\nFILE_LENGTH 72\nX_FIRST 150.91\nX_STEP 0.000833333\nY_FIRST -34.17\nY_STEP -0.000833333\nWAVELENGTH 0.0562356424\n"
    own = headers.roipac(text + "DATE 060619\nDATE12 991231-061002\n", "x.rsc")
    assert (own["FIRST_DATE"], own["SECOND_DATE"]) == (date(1999, 12, 31), date(2006, 10, 2))
    assert headers.roipac(text, "geo_060619-061002.unw.rsc")["SECOND_DATE"] == date(2006, 10, 2)
    assert math.isclose(own["X_LAST"], 150.91 + 47 * 0.000833333)
    assert headers.roipac(text + "DATUM WGS84\n", "dem.rsc")["DATUM"] == "WGS84"
    for bad in (text + "Z_SCALE 1\n", "one two three\n"):
        with pytest.raises(headers.HeaderError):
            headers.roipac(bad, "dem.rsc")


def test_matching_of_names():
    assert headers.header_paths("geo_20060619-20061002.unw", ["a/20061002_slc.par", "a/20060619_slc.par", "a/20070101_slc.par"]) == ["a/20060619_slc.par", "a/20061002_slc.par"]
    with pytest.raises(headers.HeaderError):
        headers.baseline_path("20060619-20061002", ["20060619-20061002_base.par", "x/20060619-20061002_base.par"])


@pytest.mark.parametrize("packed", [True, False])
def test_geotiff_round_trip(spark, tmp_path, packed):
    rng = np.random.default_rng(0)
    image = np.where(rng.random((700, 90)) < 0.3, 0, rng.standard_normal((700, 90))).astype("f4")
    (tmp_path / "a.tif").write_bytes(rasters.encode_tiff(image, 150.9, -34.2, 0.5, -0.25, nodata=0.0, metadata={"FIRST_DATE": "2006-06-19", "x": "<&>"}, packed=packed))
    df = rasters.read_geotiffs(spark, str(tmp_path / "a.tif"))
    found = np.zeros_like(image)
    for r in df.filter("value IS NOT NULL").collect():
        found[r["row"], r["col"]] = r["value"]
    assert df.count() == image.size and np.array_equal(found, image)
    spark.dataSource.register(rasters.GeoTiffSource)
    blocks = spark.read.format("geotiff").option("rows", 1).load(str(tmp_path / "a.tif"))
    assert blocks.rdd.getNumPartitions() > 1 and blocks.selectExpr("sum(value)", "count(*)").first() == df.selectExpr("sum(value)", "count(*)").first()
    head = rasters.geotiff_headers(spark, str(tmp_path / "a.tif")).first()
    assert (head["nrows"], head["ncols"], head["x_last"], head["y_step"], head["metadata"]["x"]) == (700, 90, 150.9 + 45, -0.25, "<&>")


def test_packbits():
    rng = np.random.default_rng(1)
    for _ in range(50):
        raw = bytes(np.repeat(rng.integers(0, 4, 40), rng.integers(1, 300, 40)).astype("u1"))
        assert rasters.unpack(rasters.pack(raw)) == raw


def test_raw_rasters(spark, tmp_path):
    image = np.arange(35, dtype=float).reshape(5, 7)
    (tmp_path / "g").write_bytes(rasters.gamma_bytes(image))
    (tmp_path / "r").write_bytes(rasters.roipac_bytes(image))
    head = {"NROWS": 5, "NCOLS": 7}
    for df in (rasters.read_gamma(spark, str(tmp_path / "g"), head), rasters.read_roipac(spark, str(tmp_path / "r"), head)):
        assert all(r["value"] == image[r["row"], r["col"]] for r in df.collect()) and df.count() == 35
    with pytest.raises(ValueError, match="bytes"):
        rasters.read_gamma(spark, str(tmp_path / "g"), {"NROWS": 6, "NCOLS": 7})
    pairs = np.stack([image, -image], 2).reshape(5, 14)
    (tmp_path / "lt").write_bytes(rasters.gamma_bytes(pairs))
    assert all((r["range_px"], r["azimuth_px"]) == (image[r["row"], r["col"]], -image[r["row"], r["col"]]) for r in rasters.read_lookup(spark, str(tmp_path / "lt"), 5, 7).collect())


def test_png():
    raw = rasters.png(np.array([[-1.0, 0.0, np.nan], [1.0, 0.5, -0.5]]), -1, 1)
    width, height = struct.unpack(">II", raw[16:24])
    pixels = zlib.decompress(raw[raw.index(b"IDAT") + 4 : raw.index(b"IEND") - 8])
    assert (width, height) == (3, 2) and pixels[1:5] == bytes([0, 0, 255, 255]) and pixels[12] == 0


def test_config():
    text = "ifgfilelist: a\ndemfile: b\ndemHeaderFile: c\nhdrfilelist: d\noutdir: e\nifglksx: 2 # looks\n\n[correct]\nsteps =\n    orbfit\n    refphase\n"
    config = Config.parse(text)
    assert config["ifglksx"] == 2 and config.steps == ("orbfit", "refphase") and config["refchipsize"] == 21
    assert Config.parse(config.text()).values == config.values
    for bad in (text.replace("outdir: e\n", ""), text.replace("refphase", "nothing"), text.replace("ifglksx: 2", "ifglksx: 0"), text.replace("ifglksx: 2", "orbfitdegrees: 4"), text.replace("ifglksx: 2", "cohmask: 1"), text.replace("ifglksx: 2", "nsig: x")):
        with pytest.raises(ConfigError):
            Config.parse(bad)
    assert coerce("nsig", "") == 2


PAIRS = [(0, 1), (1, 2), (0, 2), (2, 3), (1, 3), (3, 4), (2, 4), (0, 4)]


def stack_on_disk(folder, processor, rate):
    """A stack of the given rates (mm/year) in raw files, and its
    configuration."""
    nrows, ncols = rate.shape
    days = [date(2010, 1, 1) + timedelta(60 * i) for i in range(5)]
    day = lambda d: d.strftime("%Y%m%d" if processor else "%y%m%d")
    wavelength = 3e8 / 5.334e9 if processor else 0.0562356424
    rng, names, heads = np.random.default_rng(0), [], []
    orbit = rng.standard_normal((5, 2)) * 0.01
    row, col = np.mgrid[:nrows, :ncols]
    for a, b in PAIRS:
        mm = rate * (days[b] - days[a]).days / 365.25
        phase = mm * 4 * math.pi / (1000 * wavelength) + (col + 1) * (orbit[b] - orbit[a])[0] + (row + 1) * (orbit[b] - orbit[a])[1] + 0.3
        phase[2, 3] = 0
        name = folder / f"geo_{day(days[a])}-{day(days[b])}.unw"
        name.write_bytes((rasters.gamma_bytes if processor else rasters.roipac_bytes)(phase))
        names.append(str(name))
        if not processor:
            head = folder / f"geo_{day(days[a])}-{day(days[b])}.unw.rsc"
            head.write_text(f"WIDTH {ncols}\nFILE_LENGTH {nrows}\nX_FIRST 150.91\nX_STEP 0.000833333\nY_FIRST -34.17\nY_STEP -0.000833333\nWAVELENGTH {wavelength}\nDATE {day(days[a])}\nDATE12 {day(days[a])}-{day(days[b])}\n")
            heads.append(str(head))
    extra = ""
    if processor:
        for d in days:
            head = folder / f"{day(d)}_slc.par"
            head.write_text(EPOCH.format(y=d.year, m=d.month, d=d.day, inc=22.9))
            heads.append(str(head))
        bases = []
        for i, (a, b) in enumerate(PAIRS):
            base = folder / f"{day(days[a])}-{day(days[b])}_base.par"
            base.write_text(BASE.format(p=f"1.0 {50 * math.sin(i)} {30 * math.cos(3 * i)}"))
            bases.append(str(base))
            coh = folder / f"{day(days[a])}-{day(days[b])}.cc"
            coh.write_bytes(rasters.gamma_bytes(np.where((row == 5) & (col == 5), 0.1, 0.9)))
            extra += str(coh) + "\n"
        (folder / "bases").write_text("\n".join(bases))
        (folder / "cohs").write_text(extra)
        lookup = np.stack([1000 + 10 * col, 500 + 5 * row], 2).reshape(nrows, 2 * ncols).astype(float)
        (folder / "lt").write_bytes(rasters.gamma_bytes(lookup))
        (folder / "dem.par").write_text(DEM.format(w=ncols, h=nrows))
        (folder / "dem").write_bytes(rasters.gamma_bytes(np.full(rate.shape, 25.0)))
        extra = f"basefilelist: {folder}/bases\ncohfilelist: {folder}/cohs\ncohmask: 1\nltfile: {folder}/lt\nlos_projection: 1\ndemerror: 1\nde_pthr: 6\n"
    else:
        (folder / "dem.par").write_text(f"WIDTH {ncols}\nFILE_LENGTH {nrows}\nX_FIRST 150.91\nX_STEP 0.000833333\nY_FIRST -34.17\nY_STEP -0.000833333\nDATUM WGS84\nZ_SCALE 1\n")
        (folder / "dem").write_bytes(np.full(rate.shape, 25, "<i2").tobytes())
    (folder / "ifgs").write_text("\n".join(names) + "\n\n")
    (folder / "hdrs").write_text("\n".join(heads))
    settings = "noDataAveragingThreshold: 0.5\nnan_conversion: 1\nrefchipsize: 3\nrefnx: 3\nrefny: 3\norbfit: 1\norbfitlksx: 1\norbfitlksy: 1\nphase_closure: 1\nmax_loop_redundancy: 9\nts_pthr: 2\npthr: 2\nvelerror_nsig: 1\n"
    (folder / "conf").write_text(f"ifgfilelist: {folder}/ifgs\nhdrfilelist: {folder}/hdrs\ndemfile: {folder}/dem\ndemHeaderFile: {folder}/dem.par\noutdir: {folder}/out\nprocessor: {processor}\n{settings}{extra}")


@pytest.mark.parametrize("processor", [0, 1])
def test_chain(spark, tmp_path, processor):
    """From raw files to products; the rates come back but for a plane, which
    the orbital correction takes."""
    row, col = np.mgrid[:12, :10]
    rate = 30 * np.exp(-((row - 6) ** 2 + (col - 5) ** 2) / 8.0)
    stack_on_disk(tmp_path, processor, rate)
    main(["workflow", "-f", str(tmp_path / "conf")])
    out = f"{tmp_path}/out"
    found = np.full(rate.shape, np.nan)
    for r in spark.read.parquet(f"{out}/linear_rate").collect():
        if r["rate"] is not None:
            found[r["row"], r["col"]] = r["rate"]
    ok = np.isfinite(found)
    assert not ok[2, 3] and ok.sum() >= 110 and (processor == 0 or not ok[5, 5])
    a = np.stack([np.ones(ok.sum()), row[ok], col[ok]], 1)
    flat = lambda v: v - a @ np.linalg.lstsq(a, v, rcond=None)[0]
    assert np.allclose(flat(found[ok]), flat(rate[ok]), atol=1e-3)
    products = spark.read.parquet(f"{out}/products")
    names = {r[0] for r in products.select("product").distinct().collect()}
    assert names == {"stack_rate", "stack_error", "stack_samples", "linear_rate", "linear_error", "linear_samples", "linear_intercept", "linear_r2", "tscuml", "tsincr"}
    stacked = {(r["row"], r["col"]): r["rate"] for r in spark.read.parquet(f"{out}/stack_rate").collect()}
    assert all(math.isclose(stacked[int(i), int(j)], found[i, j], abs_tol=1e-3) for i, j in zip(*np.nonzero(ok)) if stacked[int(i), int(j)] is not None)


def test_export(spark, tmp_path):
    from phasegrid.plans import workflow

    rows = [("stack_rate", None, r, c, float(r - c)) for r in range(4) for c in range(3)] + [("tscuml", e, r, c, 1.0 * e) for e in (1, 2) for r in range(4) for c in range(3)]
    products = spark.createDataFrame(rows, "product string, epoch_idx int, row int, col int, value double")
    workflow._export(products, workflow.Grid(4, 3, 150.0, -34.0, 0.1, -0.1), f"file://{tmp_path}")
    made = {p.name for p in (tmp_path / "export").iterdir() if not p.name.startswith(".")}
    assert made == {"stack_rate.tif", "tscuml_1.tif", "tscuml_2.tif", "stack_rate.png", "stack_rate.kml"}
    back = rasters.read_geotiffs(spark, f"{tmp_path}/export/stack_rate.tif").collect()
    assert all(r["value"] == r["row"] - r["col"] for r in back)
