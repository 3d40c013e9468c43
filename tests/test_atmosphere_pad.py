"""The query's spatial filter is that of the operator."""

import os

import pytest
from pyspark.sql import functions as F

from phasegrid.functions import kernels
from phasegrid.operators import aps, network
from phasegrid.plans import queries, registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_atmosphere_with_the_full_transform(spark):
    series, ifgs, net = queries._series(spark, DIR)
    high = aps.temporal_highpass(series.select("row", "col", "epoch_idx", "tsincr"), net, 600).toPandas()
    grid, low = queries.GRID, {}
    for epoch, own in high.groupby("epoch_idx"):
        image = own.pivot(index="row", columns="col", values="high").reindex(index=range(grid.nrows), columns=range(grid.ncols)).to_numpy(float)
        low[epoch] = kernels.gaussian_lowpass(image, 1.0, grid.x_size, grid.y_size, "nearest", 4096)
    spans = {}
    for r in network.members(ifgs, network.epochs(ifgs)).select("ifg_id", (F.col("epoch_idx") + 1).alias("epoch_idx")).collect():
        spans.setdefault(r.ifg_id, []).append(r.epoch_idx)
    got = registry.QUERIES["atmosphere"](spark, DIR).filter("aps IS NOT NULL").collect()
    assert got
    for r in got:
        assert r.aps == pytest.approx(sum(low[e][r.row, r.col] for e in spans[r.ifg_id]), abs=6e-5)
