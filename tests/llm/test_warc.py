import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc

SCHEMA = "record_id long, url string, ts long, type string, etag string, last_modified string, digest string, headers map<string,string>"


@pytest.mark.parametrize(("url", "key"), [
    ("http://WWW.Example.com:80/a/?b=2&a=1#x", "example.com/a?a=1&b=2"),
    ("https://u:p@example.com:443", "example.com"),
    ("https://example.com/?utm_source=x&ref=y", "example.com"),
    ("HTTP://www2.example.com/A/b//", "example.com/A/b"),
    ("example.com:8080/x?q=1&&utm=2", "example.com:8080/x?q=1&utm=2"),
    ("", ""),
])
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == key


def brute(rows):
    out = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [s for s in rows if s[3] == "response" and s[1] == r[1] and s[1] is not None and None not in (s[2], r[2]) and s[2] < r[2]]
        s = max(before, key=lambda s: (s[2], s[0]), default=None)
        mine, its = next(((a, b) for a, b in zip(r[4:7], s[4:7] if s else (None,) * 3, strict=True) if a is not None), (None, None))
        out[r[0]] = ("missing", None) if s is None else ("unverified", None) if mine is None else ("resolved", s[0]) if mine == its else ("mismatch", None)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_brute_force(spark, parts):
    rng = random.Random(parts)
    pick = lambda *xs: rng.choice(xs)
    rows = [(i, pick("a.com/x", "a.com/y", "b.com", None), pick(None, *range(40)), pick("response", "revisit"), pick(None, "e1", "e2"), pick(None, "m1", "m2"), pick(None, "d1", "d2"), {"ETag": "x"}) for i in range(400)]
    got = {r["record_id"]: (r["outcome"], r["source_id"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA), parts).collect()}
    assert got == brute(rows)


def test_headers(spark):
    rows = [(1, "http://a.com/", 1, "response", "e", None, "d", {"Content-Type": "text/html", "Date": "old", "ETag": "e"}), (2, "https://www.a.com", 5, "revisit", "e", None, None, {"content-type": "none", "date": "new", "Vary": "x"}), (3, "b.com", 5, "revisit", "e", None, "own", None)]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2]["headers"] == {"Content-Type": "text/html", "ETag": "e", "date": "new", "Vary": "x"} and got[2]["digest"] == "d"
    assert got[3]["outcome"] == "missing" and got[3]["digest"] == "own" and got[3]["headers"] is None


def test_odd_tables(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a.com", 1, "response", "e", None, "d", {}), (2, "a.com", 3, "revisit", "e", None, None, {}), (2, "a.com", 3, "revisit", "e", None, None, {})]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("q")).withColumn("near", F.lit(1))
    assert [r["source_id"] for r in warc.resolve_revisits(df).collect()] == [1, 1]
