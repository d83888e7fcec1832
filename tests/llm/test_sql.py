"""Queries of this subpackage that have SQL give the rows of that SQL."""

import duckdb
import pandas as pd
import pytest

from plumbline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows(name, spark, data):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    plain = lambda x: "null" if x is None or pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x)
    rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    a, b = queries.QUERIES[name](spark, data).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)
