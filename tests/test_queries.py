"""Every registered query with an oracle agrees with DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from panelforge.plans.oracles import ORACLES
from panelforge.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
DATES = ("dt", "report_date", "last_dt", "first", "last", "filing_date", "observation_date", "updated_at")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    for d in (got, want):
        for c in cols:
            if c in DATES:
                d[c] = pd.to_datetime(d[c]).astype("datetime64[ns]")
    a, b = (d[cols].sort_values(cols, ignore_index=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1.1e-6)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
