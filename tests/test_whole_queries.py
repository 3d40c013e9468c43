"""Queries on rows that the driver's tables don't have."""

import datetime

import numpy as np
import pytest

from phasegrid.plans import registry


def test_event_rates_of_any_day(spark, tmp_path):
    days = {1: [-700, -3, 0, 5, 399, 400, 2000], 2: [-10, -9], 3: [500, 900, 901], 4: [7]}
    rows = [(u, datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(days=d), 0.5 + (i * i + u) % 7) for u, own in days.items() for i, d in enumerate(own)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r for r in registry.QUERIES["event_rates"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3]
    for u, r in got.items():
        rate, intercept = np.polyfit([d / 365.25 for d in days[u]], np.cumsum([v for w, _, v in rows if w == u]), 1)
        assert r.samples == len(days[u])
        assert (r.rate, r.intercept) == (pytest.approx(rate, abs=0.006), pytest.approx(intercept, abs=0.0006))


@pytest.mark.parametrize(
    "keys, expected",
    [
        # A key that stands twice is one row, as in the SQL.
        ([12, 12, 12, 49, 7, 49, 0, None], [(7, 1, 7, False), (12, 3, 4, False), (49, 7, 7, True)]),
        # An array of as many cells as the key doesn't fit in memory.
        ([1_000_002 * 500_000_003], [(500_001_003_000_006, 1_000_002, 500_000_003, False)]),
        # Factors above 999, which the SQL doesn't try.
        ([1_000_000, 1_001_000, 1_002_001], [(1_000_000, 1000, 1000, True), (1_001_000, 1000, 1001, False), (1_002_001, 1001, 1001, True)]),
    ],
    ids=["repeated", "large", "beyond the SQL's range"],
)
def test_near_factors_of_any_key(spark, tmp_path, keys, expected):
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = registry.QUERIES["near_factors"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == expected
