"""Every query of the engine that has SQL gives the rows of that SQL."""

import math

import duckdb
import pandas as pd
import pytest

from plumbline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, str):
        return x
    return repr(round(float(x), 6) + 0.0)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows(name, spark, data, sql):
    a, b = rows(catalog.QUERIES[name](spark, data).toPandas()), rows(sql.sql(catalog.ORACLES[name]).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]


def test_flagship(spark, data):
    r = catalog.flagship(spark, data).first()
    assert r["n"] > 0 and r["ce90"] <= r["ce95"]


def test_invariants(spark, data):
    q = catalog.QUERIES
    kp = q["kp_enrich"](spark, data).count()
    assert q["profile_dx_by_col"](spark, data).agg({"n": "sum"}).first()[0] == kp
    m = q["mask_and"](spark, data).first()
    assert m["both_valid"] <= min(m["raster_valid"], m["vector_valid"])
    s = q["nmi_studholme"](spark, data).agg({"nmi_studholme": "max"}).first()[0]
    assert 1 <= s <= 2
    assert q["chip_select"](spark, data).count() <= 125


def test_known_shift_is_found(spark, data):
    kp = catalog.QUERIES["klt_match"](spark, data).toPandas()
    good = kp[kp["score"] > 0.4]
    assert len(good) > 50
    assert abs(good["dx"].median() - 2) < 0.05 and abs(good["dy"].median() - 3) < 0.05
    o = catalog.QUERIES["phase_offset"](spark, data).first()
    assert (o["row_off"], o["col_off"]) == (3, 2)
    h = catalog.QUERIES["ecc_refine"](spark, data).first()
    assert abs(h["h02"] - 2) < 0.1 and abs(h["h12"] - 3) < 0.1
