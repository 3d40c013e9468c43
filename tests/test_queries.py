"""Every registered query against its SQL, where DuckDB and the driver's
tables are at hand."""

import math
import os

import pytest

import __spark_entry__ as entry
from phasegrid.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
#: At this scale some pixels' networks fall apart, and the SQL walks one tree.
WHOLE_TREES = {"time_series"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return str(x)[:10] if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert found or name == "closure_drops"
    if name not in registry.ORACLES or name in WHOLE_TREES:
        return
    result = tables.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    rows = [dict(zip(names, r)) for r in result.fetchall()]
    assert found == sorted(repr([plain(r[c]) for c in columns]) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).columns == ["row", "col", "rate", "intercept", "r2", "error", "samples"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
