"""Every query of the catalogue with oracle SQL gives DuckDB's rows on the tables of the correctness gate."""

import math
from pathlib import Path

import duckdb
import pytest

from pixelloom.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) and v else "0" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_oracle(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(catalogue.SQL[name])
    at = [list(want.columns).index(c) for c in cols]
    assert sorted(want.columns) == cols
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
