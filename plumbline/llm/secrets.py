"""Secret scans with multipart credential linking. DataFrame operations only.

Base patterns give spans of their own. Beside them, weak candidates (an access identifier by its name, a 40-character
token, an endpoint) are reported only if complementary parts stand beside them in the same scope: an interval join of the
parts' scopes, done as one sweep over the sorted ends of a document's parts, so that no pair is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

#: Code points around a part in which its complements may stand.
SCOPE = 200

#: The base kinds and their patterns, as Java reads them.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Patterns of the weak candidates.
WEAK_ACCESS = r"""(?i:client_?id|access_?key(?:_?id)?|user_?name|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{6,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""https?://[^\s"'<>]+"""
KINDS = ("assign", "access", "hex", "link_access", "link_secret", "link_endpoint")


def _found(text: Column, pattern: str, group: int, guard: Column) -> Column:
    """All matches of a pattern where guard holds, else none; guard is cheap and true of every text with a match."""
    none = F.array().cast("array<string>")
    return F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)


def _gaps(text: Column, pattern: str, found: Column) -> Column:
    """Lengths of the texts before each match and after the last."""
    return F.when(F.size(found) > 0, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>"))


def _parts(kind: int, role: str, strong: bool, pattern_matches: Column, gaps: Column, keep: Column | None = None) -> Column:
    """Structs of one kind: k-th match, its length, the gap before it, whether it counts."""
    sizes = F.transform(pattern_matches, F.length)
    ok = keep if keep is not None else F.transform(sizes, lambda n: n >= 0)
    return F.zip_with(
        F.zip_with(sizes, ok, lambda n, k: F.struct(n.alias("n"), k.alias("ok"))),
        F.slice(gaps, 1, F.size(sizes)),
        lambda a, g: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(strong).alias("strong"), a["n"].alias("n"), a["ok"].alias("ok"), g.alias("gap")),
    )


def parts(docs: DataFrame) -> DataFrame:
    """One row for each part, and one of kind -1 for each document: doc_id, h (of the text), kind, role, strong, start, end."""
    has = lambda *xs: F.expr(" or ".join(f"contains(text, '{x}')" for x in xs))
    t = F.col("text")
    names = {0: (ASSIGN, "secret", True, has("=", ":")), 1: (ACCESS, "access", True, has("AKIA")), 2: (HEX, "secret", True, F.lit(True)), 3: (WEAK_ACCESS, "access", False, has("=", ":")), 4: (WEAK_SECRET, "secret", False, F.lit(True)), 5: (ENDPOINT, "endpoint", False, has("://"))}
    rows = texts(docs, "doc_id").select("doc_id", "text", *[_found(t, p, 0, g).alias(f"m{k}") for k, (p, _, _, g) in names.items()])
    rows = rows.select("*", *[_gaps(t, p, F.col(f"m{k}")).alias(f"g{k}") for k, (p, *_) in names.items()], F.when(F.size("m0") > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("value"))
    each = [_parts(k, role, strong, F.col(f"m{k}"), F.col(f"g{k}"), F.transform("value", lambda v: F.length(v) >= 12) if k == 0 else None) for k, (_, role, strong, _) in names.items()]
    mark = F.array(F.struct(F.lit(-1).alias("kind"), F.lit("").alias("role"), F.lit(False).alias("strong"), F.lit(0).alias("n"), F.lit(False).alias("ok"), F.lit(0).alias("gap")))
    dealt = rows.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.concat(mark, *each)).alias("pos", "p")).select("doc_id", "h", "pos", "p.*")
    # Repeated rows share a key: they are counted before they meet.
    once = dealt.groupBy("doc_id", "h", "kind", "pos", "role", "strong", "n", "ok", "gap").agg(F.count("*").alias("copies")).repartition("doc_id", "h")
    run = Window.partitionBy("doc_id", "h", "kind").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(run)
    return once.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).where("kind = -1 or ok").drop("gap", "ok", "pos", "n")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong parts, and the weak ones with complements in their scope.

    An access identifier needs a secret, a secret an access identifier, an endpoint both. Two parts are in one scope if
    at most scope code points lie between them; parts that overlap are one value and no complements.

    The sweep meets both ends of each part: at a start it knows the last end of each role, at an end the next start.
    """
    begin, finish = F.struct(F.col("start").alias("at"), F.lit(1).alias("begins")), F.struct(F.col("end").alias("at"), F.lit(0).alias("begins"))
    ends = F.explode(F.when(F.col("kind") == -1, F.array(finish)).otherwise(F.array(begin, finish))).alias("e")
    swept = found.select("*", ends).select("*", "e.at", "e.begins").drop("e")
    order = Window.partitionBy("doc_id", "h").orderBy("at", "begins", "kind", "start")  # where one part ends and one begins, the end comes first
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for role in ("access", "secret"):
        is_role = F.col("role") == role
        last = F.max(F.when(is_role & (F.col("begins") == 0), F.col("at"))).over(before)
        first = F.min(F.when(is_role & (F.col("begins") == 1), F.col("at"))).over(after)
        near[role] = F.coalesce(F.when(F.col("begins") == 1, last >= F.col("at") - scope).otherwise(first <= F.col("at") + scope), F.lit(False))
    sides = swept.select(*found.columns, *[c.alias(f"_{role}") for role, c in near.items()]).groupBy("doc_id", "h", "kind", "role", "strong", "copies", "start", "end")
    judged = sides.agg(F.max("_access").alias("_access"), F.max("_secret").alias("_secret"))
    ok = F.when(F.col("role") == "access", F.col("_secret")).when(F.col("role") == "secret", F.col("_access")).when(F.col("role") == "endpoint", F.col("_access") & F.col("_secret"))
    return judged.where((F.col("kind") == -1) | F.col("strong") | ok).select(*found.columns)


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, spans_found.

    spans is kind:start:end by start, then kind; spans_found the same as an array of structs. A null text is empty and
    has no span; repeated rows give equal rows; an empty table gives an empty one; other columns are not read.
    """
    hit = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    rows = linked(parts(docs), scope).groupBy("doc_id", "h").agg(F.max(F.when(F.col("kind") == -1, F.col("copies"))).alias("copies"), F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, hit))).alias("found"))
    names = F.array(*[F.lit(k) for k in KINDS])
    show = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    full = rows.select("doc_id", "copies", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(show(base), 256).alias("base_sha256"), show(F.col("found")).alias("spans"), F.transform("found", lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans_found"))
    return full.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "_copy")
