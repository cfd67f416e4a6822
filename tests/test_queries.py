"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from marlstone import registry

from .conftest import SF

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 5) + 0.0)
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


#: One of each kind of factor; all 29 run at sf0.01 in the correctness gate.
FACTORS = {"factor_macd_diff", "factor_realized_kurt", "factor_price_volume_corr", "factor_panel"}


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("factor_") or n in FACTORS))
def test_same_as_sql(spark, duck, name):
    got, want = plain(QUERIES[name](spark, SF).toPandas()), plain(duck.execute(SQL[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if x != y:
                assert math.isclose(float(x), float(y), rel_tol=1e-4, abs_tol=2e-5)
