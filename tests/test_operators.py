"""Operators on small stacks with known answers."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.model import Grid, Network
from phasegrid.operators import aps, closure, dem, inversion, metadata, network, orbital, rasters, reference, units
from phasegrid.streaming import arrivals

GRID = Grid(12, 10, 150.0, -34.0, 0.001, -0.001, 80.0, 90.0)
PAIRS = [(0, 1), (1, 2), (0, 2), (2, 3), (1, 3), (3, 4), (2, 4), (0, 4)]


def make_net(pairs=PAIRS, days=60):
    start = date(2010, 1, 1)
    return Network.of({"ifg_id": i, "first_date": start + timedelta(days * a), "second_date": start + timedelta(days * b), "nan_fraction": i / 100} for i, (a, b) in enumerate(pairs))


def ifg_table(spark, net):
    return spark.createDataFrame([(i.ifg_id, i.first, i.second, i.years, 0.056) for i in net.ifgs], "ifg_id int, first_date date, second_date date, time_span double, wavelength double")


def cube(spark, values):
    """phase of an array (ifg, row, col), NaN as null, over several tasks."""
    rows = [(int(i), int(r), int(c), None if math.isnan(v) else float(v)) for (i, r, c), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "ifg_id int, row int, col int, phase double").repartition(5)


def back(df, shape, value="phase", key="ifg_id"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[value] is not None:
            out[(r[key], r["row"], r["col"]) if key else (r["row"], r["col"])] = r[value]
    return out


@pytest.fixture(scope="module")
def linear(spark):
    """A stack whose pixels move at constant rates, with holes."""
    net, rng = make_net(), np.random.default_rng(0)
    rate = rng.standard_normal((12, 10)) * 20
    values = np.array([rate * i.years for i in net.ifgs])
    values[rng.random(values.shape) < 0.15] = np.nan
    return net, rate, cube(spark, values).cache(), values


def test_nodata_and_units(spark):
    df = spark.createDataFrame([(0.0,), (1e-7,), (float("nan"),), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(units.null_nodata(F.col("v"))).collect()] == [None, None, None, 2.0, None]
    mm = df.filter("v = 2").select(units.radians_to_mm(F.col("v"), F.lit(0.0562356424)).alias("mm")).first()["mm"]
    assert math.isclose(mm, 2 * 1000 * 0.0562356424 / (4 * math.pi))


def test_rates_beyond_their_error_go(spark):
    df = spark.createDataFrame([(5.0, 1.1), (4.5, 2.1)], "rate double, error double")
    nulls = lambda s: sum(r["rate"] is None for r in units.mask_rate(df, s).collect())
    assert [nulls(s) for s in (1, 2, 3, 0)] == [2, 1, 0, 0]
    assert units.masked_share(units.mask_rate(df, 2)).first()[0] == 50


def test_projection(spark):
    values = spark.createDataFrame([(0, 0, 2.0)], "row int, col int, value double")
    at = lambda deg: spark.createDataFrame([(0, 0, math.radians(deg))], "row int, col int, incidence double")
    assert math.isclose(units.project(values, at(60), "vertical", -1).first()["value"], -4)
    assert math.isclose(units.project(values, at(30), "horizontal", 1).first()["value"], 4)
    assert units.project(values, None, "vertical", -1).first()["value"] == 2.0


def test_names(spark):
    df = spark.createDataFrame([("/a/geo_060619-061002.unw",), ("x/20150101-20160203_ifg.tif",), ("none",)], "path string")
    assert [list(r[0]) for r in df.select(metadata.epochs_in(F.col("path"))).collect()] == [["060619", "061002"], ["20150101", "20160203"], []]
    assert [r[0] for r in metadata.manifest(df, "/out").select("converted").collect()] == ["/out/geo_060619-061002_unw.tif", "/out/20150101-20160203_ifg_tif.tif", "/out/none.tif"]
    assert metadata.few_epochs(df, 2).count() == 1
    days = spark.createDataFrame([("991231",), ("060619",), ("20300101",)], "d string").select(metadata.to_date(F.col("d"))).collect()
    assert [r[0] for r in days] == [date(1999, 12, 31), date(2006, 6, 19), date(2030, 1, 1)]
    tags = spark.createDataFrame([({"PHASE_UNITS": "x", "ORB": "REMOVED"},), ({"DEM": "1"},)], "metadata map<string,string>")
    assert [r[0] for r in tags.select(metadata.kind_of(F.col("metadata"))).collect()] == ["interferogram", "dem"]
    assert list(tags.select(metadata.prune(F.col("metadata"), ["ORB"])).first()[0]) == ["ORB"]
    with pytest.raises(ValueError):
        metadata.correction_status(tags, "ORB")
    assert metadata.correction_status(tags, "NONE") is False


def test_multilook(spark, linear):
    _, _, phase, values = linear
    found = back(rasters.multilook(phase, GRID, 5, 4, 0.4), (8, 3, 2))
    blocks = values.reshape(8, 3, 4, 2, 5).swapaxes(2, 3).reshape(8, 3, 2, 20)
    expected = np.where(np.isnan(blocks).mean(3) < 0.4, np.nanmean(blocks, 3), np.nan)
    assert np.allclose(found, expected, equal_nan=True)
    assert rasters.looked(GRID, 5, 4).nrows == 3
    with pytest.raises(ValueError):
        rasters.check_looks(0, 1)


def test_extents(spark):
    boxes = spark.createDataFrame([(0.0, 5.0, 9.0, 1.0), (1.0, 6.0, 8.0, 0.0)], "x_first double, x_last double, y_first double, y_last double")
    assert tuple(rasters.extents(boxes, "intersection").first()) == (1, 5, 8, 1)
    assert tuple(rasters.extents(boxes, "union").first()) == (0, 6, 9, 0)
    with pytest.raises(Exception, match="different areas"):
        rasters.extents(boxes, "same").collect()
    assert tuple(rasters.extents(boxes.limit(1), "same").first()) == (0, 5, 9, 1)


def test_tiles(spark, linear):
    cut = rasters.tiles(12, 10, 5, 3)
    cells = np.zeros((12, 10), int)
    for _, a, b, c, d in cut:
        cells[a:c, b:d] += 1
    assert (cells == 1).all() and rasters.two_factors(12) == (3, 4) and rasters.two_factors(7) == (1, 7)
    assert rasters.with_tiles(linear[2], cut).count() == 8 * 120


def test_epochs(spark):
    net = make_net()
    own = network.epochs(ifg_table(spark, net)).orderBy("epoch_idx").collect()
    assert [r["date"] for r in own] == list(net.dates) and [r["repeat"] for r in own] == [3, 3, 4, 3, 3]
    assert np.allclose([r["span"] for r in own], net.spans())
    member = network.members(ifg_table(spark, net), network.epochs(ifg_table(spark, net))).collect()
    assert sorted((r["ifg_id"], r["epoch_idx"]) for r in member) == sorted((i, e) for i, (a, b) in enumerate(PAIRS) for e in range(a, b))


def test_pixel_trees(spark, linear):
    net, _, phase, values = linear
    trees = network.pixel_trees(network.pixel_stack(phase, 8), net).collect()
    index = net.index()
    for r in trees:
        own = [i for i in net.ifgs if not np.isnan(values[i.ifg_id, r["row"], r["col"]])]
        sets, expected = network.Union(), [False] * 8
        for i in own:
            expected[i.ifg_id] = sets.join(index[i.first], index[i.second])
        assert r["mst"] == expected


def test_series_recovers_constant_rates(spark, linear):
    net, rate, phase, _ = linear
    found = inversion.increments(inversion.velocities(network.pixel_trees(network.pixel_stack(phase, 8), net), net, least=1), net)
    velocity = found.filter("velocity IS NOT NULL").collect()
    assert len(velocity) > 300
    assert all(math.isclose(r["velocity"], rate[r["row"], r["col"]], rel_tol=1e-6) for r in velocity)
    epoch = network.epochs(ifg_table(spark, net))
    fitted = inversion.linear_rate(inversion.with_zero_epoch(found), epoch).filter("samples = 5").collect()
    assert fitted and all(math.isclose(r["rate"], rate[r["row"], r["col"]], rel_tol=1e-6) and r["error"] < 1e-6 for r in fitted)
    few = inversion.velocities(network.pixel_stack(phase, 8), net, least=9)
    assert few.filter(F.exists("velocity", lambda x: x.isNotNull())).count() == 0


def test_partitions_dont_matter(spark, linear):
    net, _, phase, _ = linear
    made = []
    for n in (1, 7, 40):
        stack = network.pixel_trees(network.pixel_stack(phase.repartition(n), 8), net)
        out = inversion.increments(inversion.velocities(stack, net), net)
        made.append(sorted((r["row"], r["col"], r["epoch_idx"], r["tscuml"]) for r in out.collect()))
    assert made[0] == made[1] == made[2]


def test_linear_rate_fixtures(spark):
    epoch = spark.createDataFrame([(i, float(i)) for i in range(6)], "epoch_idx int, span double")
    ys = {0: [0, 2, 4, 6, 8, 10], 1: [0, 2, 4, 6, 8, 20], 2: [0, None, None, None, None, None], 3: [0, 3, None, None, None, None]}
    rows = [(r, 0, i, None if y is None else float(y)) for r, v in ys.items() for i, y in enumerate(v)]
    out = {r["row"]: r for r in inversion.linear_rate(spark.createDataFrame(rows, "row int, col int, epoch_idx int, tscuml double"), epoch).collect()}
    get = lambda r: tuple(out[r][c] if out[r][c] is None else round(out[r][c], 6) for c in ("rate", "intercept", "r2", "error", "samples"))
    assert get(0) == (2, 0, 1, 0, 6)
    assert np.allclose(get(1), (3.428571, -1.904761, 0.812030, 0.824786, 6), atol=1e-5)
    assert get(2) == (None,) * 5 and get(3) == (3, 0, 1, 0, 2)


def test_missing_increments_poison_the_sum(spark):
    rows = [(0, 0, 1, 1.0), (0, 0, 2, None), (0, 0, 3, 2.0)]
    df = spark.createDataFrame(rows, "row int, col int, epoch_idx int, tsincr double")
    assert [r[0] for r in df.orderBy("epoch_idx").select(inversion.cumulated("tsincr")).collect()] == [1.0, None, None]


def test_stacked_rate(spark, linear):
    net, rate, phase, _ = linear
    vcm = network.covariance_matrix(net, [1.0] * 8) + np.eye(8)
    trees = network.pixel_trees(network.pixel_stack(phase, 8), net)
    out = inversion.stacked_rate(trees, net, vcm, nsig=3, least=2).filter("rate IS NOT NULL").collect()
    assert len(out) > 100 and all(math.isclose(r["rate"], rate[r["row"], r["col"]], rel_tol=1e-6) for r in out)


def test_trend(spark):
    t = np.linspace(0, 3, 30)
    epoch = spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "epoch_idx int, span double")
    y = 1 + 2 * t - 0.5 * t**2 + 3 * np.sin(2 * np.pi * t) - np.cos(2 * np.pi * t)
    rows = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(y)] + [(1, 1, 0, 1.0)], "row int, col int, epoch_idx int, tscuml double")
    out = {r["row"]: r["coefficients"] for r in inversion.trend(rows, epoch, "annual_quadratic").collect()}
    assert np.allclose(out[0], [1, 2, -0.5, 3, -1], atol=1e-6) and out[1] is None


@pytest.mark.parametrize("degree", ["planar", "quadratic", "part_cubic"])
def test_independent_orbits(spark, degree):
    rng = np.random.default_rng(2)
    row, col = np.mgrid[:12, :10]
    x, y = (col + 1) * GRID.x_size, (row + 1) * GRID.y_size
    terms = {"x": x, "y": y, "xx": x**2, "yy": y**2, "xy": x * y, "xyy": x * y**2}
    values = np.array([sum(rng.standard_normal() * terms[n] / terms[n].max() for n in orbital.DEGREES[degree]) + k for k in range(3)])
    values[rng.random(values.shape) < 0.1] = np.nan
    left = orbital.corrected(orbital.independent(cube(spark, values), GRID, degree))
    assert left.filter("abs(phase) > 1e-6").count() == 0 and left.filter("phase IS NOT NULL").count() == np.isfinite(values).sum()


def test_network_orbits(spark):
    net, rng = make_net(), np.random.default_rng(4)
    row, col = np.mgrid[:12, :10]
    ramp = [rng.standard_normal(2) for _ in net.dates]
    index = net.index()
    values = np.array([(col + 1) * (ramp[index[i.second]] - ramp[index[i.first]])[0] + (row + 1) * (ramp[index[i.second]] - ramp[index[i.first]])[1] for i in net.ifgs]).astype(float)
    left = orbital.corrected(orbital.by_network(cube(spark, values), GRID, net))
    assert left.filter("abs(phase) > 1e-5").count() == 0
    for looks in (2,):
        coarse = rasters.multilook(cube(spark, values), GRID, looks, looks, 1.0)
        spread = orbital.corrected(orbital.by_network(cube(spark, values), GRID, net, offset=True, coarse=coarse, coarse_grid=rasters.looked(GRID, looks, looks)))
        assert spread.count() == 8 * 120


def test_reference(spark, linear):
    _, _, phase, values = linear
    places = reference.candidates(GRID, 3, 3, 3)
    best, score = None, {}
    for y, x in places:
        chip = values[:, y - 1 : y + 2, x - 1 : x + 2].reshape(8, -1)
        if (np.isfinite(chip).sum(1) > 4.5).all():
            score[y, x] = np.nanstd(chip, 1).mean()
    best = min(score, key=lambda k: (score[k], k))
    assert reference.reference_pixel(phase, GRID, nx=3, ny=3, chip=3, min_fraction=0.5) == best
    assert reference.reference_pixel(phase, GRID, refx=2, refy=5) == (5, 2)
    whole = np.isfinite(values).all(0)
    ref = {r["ifg_id"]: r["ref"] for r in reference.phase_by_image(phase).collect()}
    assert all(math.isclose(ref[i], np.median(values[i][whole])) for i in range(8))
    with pytest.raises(Exception, match="too few"):
        reference.phase_by_chip(phase, 5, 5, 3, 1.0).collect()
    with pytest.raises(ValueError):
        reference.check(GRID, 4, 0.5, 3, 3)


def test_closure(spark):
    net, rng = make_net(), np.random.default_rng(6)
    index, epochs = net.index(), rng.standard_normal((5, 12, 10))
    values = np.array([epochs[index[i.second]] - epochs[index[i.first]] for i in net.ifgs])
    values[2, 3, 4] += 4 * math.pi
    values[1, 0, 0] = np.nan
    phase = cube(spark, values)
    loops = network.signed_loops(net, 4)
    table = network.loop_table(spark, loops)
    found = closure.closures(phase, table, subtract_median=False)
    breach, uses = closure.breaches(found, table), closure.occurrences(table)
    assert {(r["row"], r["col"]) for r in found.filter("abs(closure) > 1").collect()} == {(3, 4)}
    masked = closure.mask(phase, breach, uses).filter("phase IS NULL").collect()
    assert {(r["ifg_id"], r["row"], r["col"]) for r in masked} == {(1, 0, 0), (2, 3, 4)}
    out = closure.iterate(phase, net, redundancy=9)
    assert len(out.network.ifgs) == 8 and out.phase.filter("phase IS NULL").count() == 2
    values[4] += np.where(rng.random((12, 10)) < 0.9, 7 * rng.standard_normal((12, 10)) + 10, -10)
    few = closure.iterate(cube(spark, values), net, redundancy=9, min_loops=1)
    assert 4 not in [i.ifg_id for i in few.network.ifgs]


def test_dem_error(spark):
    net, rng = make_net(), np.random.default_rng(8)
    slope, rate = rng.standard_normal((12, 10)), rng.standard_normal((12, 10))
    b = rng.standard_normal((8, 12, 10)) * 100
    values = np.array([5 + slope * b[i.ifg_id] + rate * i.years for i in net.ifgs])
    values[:5, 0, 0] = np.nan
    base = cube(spark, b).withColumnRenamed("phase", "bperp")
    fitted = dem.fit(cube(spark, values), base, ifg_table(spark, net), 4)
    found = back(fitted, (12, 10), "slope", None)
    expected = slope.copy()
    expected[0, 0] = np.nan
    assert np.allclose(found, expected, equal_nan=True) and np.allclose(back(fitted, (12, 10), "velocity", None)[1:], rate[1:])
    with pytest.raises(ValueError):
        dem.fit(cube(spark, values), base, ifg_table(spark, net), 3)


def test_temporal_filter(spark):
    net = make_net([(i, i + 1) for i in range(10)], 12)
    y = np.random.default_rng(9).standard_normal(10)
    y[4] = np.nan
    rows = spark.createDataFrame([(0, 0, i + 1, None if math.isnan(v) else float(v)) for i, v in enumerate(y)], "row int, col int, epoch_idx int, tsincr double")
    high = {r["epoch_idx"]: r["high"] for r in aps.temporal_highpass(rows, net, 12).collect()}
    t, ok = (np.arange(10) + 0.5) * 12, ~np.isnan(y)
    for k in range(10):
        w = np.exp(-0.5 * ((t[ok] - t[k]) / 12) ** 2)
        assert high[k + 1] is None if not ok[k] else math.isclose(high[k + 1], y[k] - (w * y[ok]).sum() / w.sum(), rel_tol=1e-6)
    assert aps.temporal_lowpass(rows, aps.midpoints(net, spark), 0.1, 10).filter("low IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        aps.temporal_highpass(rows, net, 0)


def test_spatial_filter_and_covariance(spark):
    image = np.random.default_rng(1).standard_normal((2, 12, 10))
    image[1] = np.nan
    df = cube(spark, image).withColumnRenamed("ifg_id", "epoch_idx").withColumnRenamed("phase", "high")
    low = back(aps.spatial_lowpass(df, GRID, 0.5, pad=64), (2, 12, 10), "low", "epoch_idx")
    assert np.isnan(low[1]).all() and np.nanstd(low[0]) < image[0].std()
    own = back(aps.spatial_lowpass(df.filter("epoch_idx = 0"), GRID, 0.0, pad=64), (1, 12, 10), "low", "epoch_idx")
    assert np.isfinite(own).all()
    lag = {(r["dx"], r["dy"]): r["covariance"] for r in aps.lag_covariance(cube(spark, image[:1]), 1).collect()}
    assert math.isclose(lag[0, 0], (image[0] ** 2).mean()) and math.isclose(lag[1, 0], (image[0][:, 1:] * image[0][:, :-1]).sum() / 120)


def test_arrivals(spark, tmp_path):
    folder, rng = tmp_path / "in", np.random.default_rng(3)
    rows = [(int(r), 0, float(v), float(s), 2.0) for r in range(3) for v, s in rng.random((5, 2))]
    kind = "row int, col int, phase double, time_span double, variance double"
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, kind).write.mode("append").parquet(str(folder))
        arrivals.follow(spark, str(folder), "running", str(tmp_path / "state")).awaitTermination()
    live = sorted(map(tuple, arrivals.rates(spark.table("running")).collect()))
    whole = sorted(map(tuple, arrivals.rates(arrivals.sums(spark.createDataFrame(rows, kind))).collect()))
    assert np.allclose(live, whole)
