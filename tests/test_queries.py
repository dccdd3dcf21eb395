"""Every core query equals its SQL on the smallest tables, where these exist."""

import os

import numpy as np
import pytest

from engramlake.plans import registry

D = "/root/testdata/sf0.001"
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(D):
        pytest.skip("no tables")
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return c


def norm(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        df[k] = df[k].map(lambda v: "-" if v is None or (isinstance(v, float) and np.isnan(v)) else f"{float(v):.5g}" if isinstance(v, (int, float, np.integer, np.floating)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = Q[name](spark, D).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got).equals(norm(want))
