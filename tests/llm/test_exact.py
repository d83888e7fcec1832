import hashlib
import re

import pytest

from plumbline.llm import exact


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)


ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \r\x0b\x0c"), (7, "é é"), (8, "éé"), (9, "x" * 200_000), (10, "y z"), (11, "yz"), (2, "ab")]


def test_brute_force(spark):
    got = exact.exact_dedup(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(ROWS)


def test_empty_table_and_clashing_columns(spark):
    assert exact.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a", 5, "q"), (2, "a ", 5, "q")], "doc_id long, text string, digest long, part string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact.exact_dedup(df).collect()} == {(1, 2), (2, 2)}


def test_rows_without_an_id(spark):
    got = exact.exact_dedup(spark.createDataFrame([(None, "a b"), (1, "ab"), (2, "a b"), (3, "c")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {(None, None, True), (1, None, False), (2, None, False), (3, 3, True)}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_verification_by_broadcast_and_by_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(exact, "BROADCAST_HITS", limit)
    monkeypatch.setattr(exact, "VERIFY_ROWS", 3)
    rows = [(i, "same text" + " " * (i % 5)) for i in range(40)] + [(100 + i, f"other {i}") for i in range(10)]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_a_digest_of_two_texts_is_split(spark):
    rows = [(1, "aa"), (2, "a a"), (3, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact.digests(docs).selectExpr("doc_id", "digest", "0L as keep_id", "9L as group_size")
    d = found.where("doc_id = 1").first()["digest"]
    again = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.regrouped(docs, found, [bytes(d)]).collect()}
    assert again == {1: (2, 2), 2: (2, 2), 3: (0, 9)}


def entries(df):
    return {bytes(r["digest"]): (r["keep_id"], r["n"], r["copies"]) for r in df.collect()}


def test_bytes_that_differ_are_found(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (None, "ab "), (3, "c")], "doc_id long, text string")
    d = exact.digests(docs).where("doc_id = 1").select("digest")
    hits = d.selectExpr("digest", "1L as keep_id", "3L as copies")
    assert exact.differing(docs, hits, 1).count() == 0
    wrong = exact.digests(docs).where("doc_id = 3").selectExpr("digest", "1L as keep_id", "2L as copies")
    assert exact.differing(docs, hits.unionByName(wrong), 2).count() == 0  # the row that stays has no such text: nothing to compare with


def test_batches_give_the_index_of_one_batch(spark, monkeypatch):
    monkeypatch.setattr(exact, "FANOUT", 3)
    docs = spark.createDataFrame([(i, f"text {i % 17}" + " " * (i % 3)) for i in range(120)] + [(None, "text 5")], "doc_id long, text string")
    rows = exact.digests(docs)
    whole, parts = exact.Index(spark), exact.Index(spark)
    whole.add(rows)
    sizes = []
    for k in range(7):
        parts = exact.Index.open(spark, parts.path)  # another session goes on with it
        parts.add(rows.where(f"coalesce(doc_id, 0) % 7 = {k}"))
        sizes.append(sorted(r.level for r in parts.runs))
    assert sizes == [[0], [0, 0], [1], [0, 1], [0, 0, 1], [1, 1], [0, 1, 1]]
    want = entries(whole.runs[0].entries())
    assert entries(parts.lookup(rows)) == want
    some = rows.where("doc_id < 3")
    assert set(entries(parts.lookup(some))) == {bytes(r["digest"]) for r in some.collect()}
    assert parts.lookup(exact.digests(spark.createDataFrame([(1, "unseen")], "doc_id long, text string"))).count() == 0
    assert entries(parts.compact().entries()) == want


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_filters_hold_every_digest_and_few_others(spark, monkeypatch, limit):
    monkeypatch.setattr(exact, "BROADCAST_WORDS", limit)
    rows = exact.digests(spark.createDataFrame([(i, f"t{i}") for i in range(4000)], "doc_id long, text string"))
    own, other = rows.where("doc_id < 2000"), rows.where("doc_id >= 2000")
    made = exact.filter_of(own, 500)
    assert exact.passing(own, made, 500).where("_maybe").count() == 2000
    assert exact.passing(other, made, 500).where("_maybe").count() <= (100 if limit else 2000)


def test_hot_digests_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_HITS", 0)
    monkeypatch.setattr(exact, "HOT_ROWS", 10)
    rows = [(i, "hot") for i in range(30)] + [(100 + i, f"twice {i // 2}") for i in range(12)] + [(200, "alone")]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
