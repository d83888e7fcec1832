"""Resolution of revisit records of web archives: an as-of join by canonical URL.

A not-modified revisit stands for the latest earlier full response of its URL, if the validators say so; the headers
that a not-modified answer may change are merged into those of the response. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may change (RFC 9110, RFC 9111).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Parts of the time axis; a URL with very many records is split among them.
TIME_PARTS = 64


def canonical_url(url: Column) -> Column:
    """Without scheme, user, www, default port, fragment, tracking parameters and last slash; host in lower case, parameters sorted."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(?:80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(?:utm_[a-z]+|gclid|fbclid|ref)(?:=|$)")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame, parts: int = TIME_PARTS) -> DataFrame:
    """One row for each revisit of records, resolved or not.

    records: record_id, url, ts (long), type ('response' or 'revisit'), etag, last_modified, digest, headers (map).
    Returns record_id, url_key, ts, source_id, outcome, digest, headers. outcome is `resolved`; `missing` if no earlier
    response is there; `mismatch` if a validator that the revisit has (the first of etag, last_modified, digest)
    differs from the response's or is not there; `unverified` if it has none. Only resolved rows have the response's digest and merged headers;
    the others keep their own. Of responses at one time the largest record_id counts; a response at the revisit's own
    time is not earlier. Rows without a URL or time are `missing`; repeated revisits give equal rows; an empty table
    gives an empty one; other columns are not read.

    A URL's records are split by time: the latest response of each part is carried over to later parts, so that no task
    holds all records of a URL.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "type", "etag", "last_modified", "digest", "headers")
    cuts = records.agg(F.percentile_approx("ts", [k / parts for k in range(1, parts)], 10 * parts).alias("c")).first()["c"] or []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + (F.col("ts") > c).cast("int")
    rows = rows.withColumn("part", F.coalesce(part, F.lit(0)))
    full = rows.where("type = 'response' and url_key is not null and ts is not null")
    facts = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    # A map has no order, so the best response of a time is found first, by its id.
    best = full.groupBy("url_key", "part", "ts").agg(F.max_by(facts, "record_id").alias("r"))
    last = best.groupBy("url_key", "part").agg(F.max_by("r", "ts").alias("r"))
    over_parts = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    asked = rows.where("type = 'revisit'")
    # parts in which a URL has revisits, with the latest response of the parts before
    spans = last.unionByName(asked.where("url_key is not null").select("url_key", "part").distinct().withColumn("r", F.lit(None).cast(last.schema["r"].dataType)))
    carried = spans.groupBy("url_key", "part").agg(F.max_by("r", F.col("r.ts")).alias("r")).withColumn("before", F.last("r", ignorenulls=True).over(over_parts)).select("url_key", "part", "before")
    both = best.select("url_key", "part", "ts", F.lit(0).alias("asks"), "r", F.lit(None).cast(asked_type(asked)).alias("q")).unionByName(asked.select("url_key", "part", "ts", F.lit(1).alias("asks"), F.lit(None).cast(best.schema["r"].dataType).alias("r"), F.struct("record_id", "etag", "last_modified", "digest", "headers").alias("q")))
    own = Window.partitionBy("url_key", "part").orderBy("ts", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("r", ignorenulls=True).over(own)).where("asks = 1").join(carried, ["url_key", "part"], "left")
    found = near.select("url_key", "ts", "q", F.when(F.col("url_key").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near", "before")).alias("s"))
    asks = F.when(F.col("q.etag").isNotNull(), F.col("q.etag") == F.col("s.etag")).when(F.col("q.last_modified").isNotNull(), F.col("q.last_modified") == F.col("s.last_modified")).otherwise(F.col("q.digest") == F.col("s.digest"))
    any_validator = F.coalesce("q.etag", "q.last_modified", "q.digest").isNotNull()
    outcome = F.when(F.col("s").isNull(), "missing").when(~any_validator, "unverified").when(F.coalesce(asks, F.lit(False)), "resolved").otherwise("mismatch")
    allowed = F.map_filter(F.coalesce("q.headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: F.lower(k).isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("s.headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: ~F.exists(F.map_keys(allowed), lambda a: F.lower(a) == F.lower(k)))
    ok = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(F.col("q.record_id").alias("record_id"), "url_key", "ts", F.when(ok, F.col("s.record_id")).alias("source_id"), "outcome", F.when(ok, F.col("s.digest")).otherwise(F.col("q.digest")).alias("digest"), F.when(ok, F.map_concat(kept, allowed)).otherwise(F.col("q.headers")).alias("headers"))


def asked_type(asked: DataFrame) -> str:
    return asked.select(F.struct("record_id", "etag", "last_modified", "digest", "headers").alias("q")).schema["q"].dataType.simpleString()


def crawl(pages: DataFrame) -> DataFrame:
    """A crawl log from pages (page_id, url, html): a response for each, and a later revisit by another spelling of its URL.

    Of three revisits one has the response's entity tag, one another tag, one the digest alone; those of every fifth
    page come before the response.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    head = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    response = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("type"), F.substr(digest, F.lit(1), F.lit(16)).alias("etag"), day.alias("last_modified"), digest.alias("digest"), head("Content-Type", "text/html", "Date", day, "ETag", F.substr(digest, F.lit(1), F.lit(16))).alias("headers"))
    kind = F.pmod("page_id", F.lit(3))
    etag = F.when(kind == 0, F.substr(digest, F.lit(1), F.lit(16))).when(kind == 1, F.lit("other"))
    later = F.when(F.pmod("page_id", F.lit(5)) == 0, -5).otherwise(100_000)
    url = F.concat(F.regexp_replace("url", "^https?://", "HTTPS://WWW."), F.when(F.col("url").contains("?"), F.lit("&utm_campaign=again")).otherwise(F.lit("?utm_campaign=again")))
    plain = F.regexp_replace(url, "(#[^?]*)([?].*)$", "$2$1")
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), plain.alias("url"), (F.col("page_id") * 10 + later).alias("ts"), F.lit("revisit").alias("type"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), digest.alias("digest"), head("Content-Type", "text/plain", "date", F.lit("now"), "Cache-Control", "no-cache").alias("headers"))
    return response.unionByName(revisit)
