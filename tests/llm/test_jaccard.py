import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.llm import jaccard
from plumbline.llm.components import components, spread_join


def brute(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[ \t-\r]+", t or "") if x]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    root, links = list(range(n)), Counter()

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 5 * i >= 4 * (len(sets[a]) + len(sets[b]) - i):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(lambda: 1 << 60)
    for a in range(n):
        least[find(a)] = min(least[find(a)], rows[a][0])
    return {rows[a][0]: (least[find(a)], links[a]) for a in range(n)}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 6, 30, 120, 300]))]
        if rng.random() < 0.3:
            base += passage
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            out.append("  ".join(copy) if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


def join(spark, rows, schema="doc_id long, text string"):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, schema)).collect()}


@pytest.mark.parametrize("blocks", [(256, 1024), (8, 8)])
def test_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "BLOCK", blocks[0])
    monkeypatch.setattr(jaccard, "LEAF_BLOCK", blocks[1])
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    hot = [(5000 + i, " ".join(w if rng.random() > 0.004 else f"v{rng.random()}" for w in base)) for i in range(50)]
    rows = corpus(3) + hot + [(9000, None), (9001, ""), (9002, "a b"), (9003, "a  b"), (9004, "a b c"), (9005, "z " * 40_000)]
    assert join(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_sets_come_by_broadcast_or_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", limit)
    rows = corpus(11, 25)
    assert join(spark, rows) == brute(rows)


def test_recall_of_one_run():
    """Pairs just similar enough share a leaf as often as the bound says."""
    rng = np.random.default_rng(0)
    hit = 0
    runs = jaccard.runs_for(0.8)
    seeds = np.arange(1, runs + 1, dtype=np.uint64)
    for k in range(150):
        shared = jaccard.mix(rng.integers(0, 1 << 62, 160).astype(np.uint64))
        a, b = (np.unique(np.concatenate([shared, jaccard.mix(rng.integers(0, 1 << 62, 20).astype(np.uint64))])) for _ in range(2))
        hit += len(np.intersect1d(jaccard.leaves(a, jaccard.mix(seeds + np.uint64(1000 * k))), jaccard.leaves(b, jaccard.mix(seeds + np.uint64(1000 * k))))) > 0
    assert hit >= 146


def test_recall_of_a_set_within_another():
    """Of all pairs just similar enough, sets of unequal size share leaves least often."""
    rng = np.random.default_rng(5)
    hit, n = 0, 3000
    for k in range(n):
        b = np.unique(jaccard.mix(rng.integers(0, 1 << 62, 200).astype(np.uint64)))
        a = np.sort(rng.permutation(b)[:160])
        seed = jaccard.mix(np.array([k + 1], np.uint64))
        hit += len(np.intersect1d(jaccard.leaves(a, seed), jaccard.leaves(b, seed))) > 0
    assert 1 - (1 - hit / n) ** jaccard.runs_for(0.8) > 0.995


def test_overlaps_by_brute_force():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 6000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(12)]
    got = jaccard.overlaps(sets)
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(12) for b in range(12))


def test_odd_tables(spark):
    assert join(spark, []) == {}
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = jaccard.jaccard_join(spark.createDataFrame([(*r, 5, b"x") for r in rows], "doc_id long, text string, rep long, sketch binary")).collect()
    assert [(r["class_id"], r["n_links"]) for r in got] == [(1, 2)] * 3
    got = jaccard.jaccard_join(spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "q r s t u v")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_links"]) for r in got) == [(-1, 0), (-1, 0), (3, 0)]


def test_missing_and_repeated_ids(spark):
    near = [f"w{k}" for k in range(100)]
    a, b = " ".join(near), " ".join([*near[:50], "x", *near[51:]])
    rows = [(None, a), (None, b), (None, "one two three four five six"), (None, b), (-1, "m n o p q r"), (-1, "m n o p q r s t u v"), (7, b), (7, "other words of the same id here"), (8, a), (8, a)]
    got = sorted(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    want = [(None, 7, 5), (None, 7, 5), (None, 7, 5), (None, None, 0), (-1, -1, 0), (-1, -1, 0), (7, 7, 5), (7, 7, 0), (8, 7, 5), (8, 7, 5)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    alone = jaccard.jaccard_join(spark.createDataFrame([(None, a), (None, b), (-1, None)], "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, alone))) == sorted(map(str, [(None, None, 1), (None, None, 1), (-1, -1, 0)]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)] + [(300, k) for k in range(301, 330)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and {got[100], got[150], got[200]} == {100} and all(got[k] == 300 for k in range(300, 330))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_join_takes_frequent_keys_apart(spark):
    keys = [7] * 5000 + [8] * 300 + list(range(100, 400)) + [None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    by = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first")).where("k <> 399")
    got = sorted((r["k"], r["i"], r["first"]) for r in spread_join(rows, by, "k", len(keys)).collect())
    assert got == sorted((k, i, keys.index(k)) for i, k in enumerate(keys) if k is not None and k != 399)


def test_components_of_a_star_and_a_path(spark):
    """A hub with far more edges than FREQUENT_ROWS, one that is not the smallest of its component, and a long path."""
    edges = [(5, k) for k in range(10, 1500)] + [(5, 1)] + [(k, 2000) for k in range(2001, 2600)] + [(k, k + 1) for k in range(3000, 3060)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 1, 1: 1, **{k: 1 for k in range(10, 1500)}, 2000: 2000, **{k: 2000 for k in range(2001, 2600)}, **{k: 3000 for k in range(3000, 3061)}}
