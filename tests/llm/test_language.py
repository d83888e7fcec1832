import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import language


def brute(e, t):
    """Marginals by summing over all paths."""
    n, k = e.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        # before the first word, a uniform label
        s = sum(e[i, p] for i, p in enumerate(path)) + sum(t[a, b] for a, b in zip(path[:-1], path[1:], strict=True)) + np.log(np.exp(t[:, path[0]]).sum())
        for i, p in enumerate(path):
            out[i, p] += np.exp(s)
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("segment", [2, 3, 32])
def test_forward_backward_by_brute_force(monkeypatch, segment):
    monkeypatch.setattr(language, "SEGMENT", segment)
    rng = np.random.default_rng(1)
    sizes = [1, 5, 0, 7, 2]
    e, t = rng.normal(size=(sum(sizes), 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    text = np.repeat(np.arange(len(sizes)), sizes)
    got = language.posteriors(e, text, len(sizes), t)
    for k in range(len(sizes)):
        own = text == k
        if own.any():
            assert np.allclose(got[own], brute(e[own], t), atol=1e-4)


def test_transition_gradient_by_differences():
    """Pairwise marginals are the derivative of the log partition by each transition."""
    rng = np.random.default_rng(8)
    sizes = [6, 1, 3]
    e, t = rng.normal(size=(sum(sizes), 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    text = np.repeat(np.arange(3), sizes)
    forward = np.empty_like(e)
    p = language.posteriors(e, text, 3, t, forward)
    inner = text[1:] == text[:-1]
    got = language.pairs(forward[:-1][inner], p[1:][inner], t).sum(0)

    def log_partition(t):
        total = 0.0
        for k in range(3):
            own = e[text == k].astype(float)
            v = np.exp(own[0]) * np.exp(T0).sum(0)  # a uniform label before the first word, at fixed transitions
            for x in own[1:]:
                v = (v @ np.exp(t)) * np.exp(x)
            total += np.log(v.sum())
        return total

    T0 = t.astype(float)
    for a in range(3):
        for b in range(3):
            d = np.zeros((3, 3))
            d[a, b] = 1e-5
            assert got[a, b] == pytest.approx((log_partition(T0 + d) - log_partition(T0 - d)) / 2e-5, abs=1e-3)


def test_features_of_words_by_brute_force():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 60).astype(np.uint8)
    start, end = np.array([0, 1, 3, 6, 10, 30]), np.array([1, 3, 6, 10, 30, 60])
    row, code = language.word_matrix(data, start, end)
    assert len(row) == sum(2 * sum(n >= k for k in (1, 2, 3)) + sum(max(0, n - k + 1) for k in (2, 3, 4)) for n in end - start)
    for k in range(len(start)):  # a word alone has the same features
        _, own = language.word_matrix(data[start[k] : end[k]], np.array([0]), np.array([end[k] - start[k]]))
        assert sorted(own) == sorted(code[row == k])


def test_very_long_words_take_linear_time():
    m = language.train([("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de")])
    assert language.score_texts(m, pa.array(["q" * 3_000_000]))[0][0] in ("en", "de")


def test_short_texts_are_learned_from(spark):
    docs = spark.createDataFrame([(i, f"{w} {i}", lang, "x") for i in range(40) for w, lang in (("the cat", "en"), ("der hund", "de"))] + [(99, "  ", "fr", "x"), (100, "der hund", None, None)], "doc_id long, text string, lang string, score string")
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(docs).collect()}
    assert (100, "de") in got and (99, "und") in got


def test_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_code_switched_words(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    m = language.fit(docs, language.LEARN_FROM)
    part = lambda lang: " ".join(docs.where(f"lang = '{lang}' and length(text) > 400").orderBy("doc_id").first()["text"].split()[:12])
    text = f"{part('en')} {part('de')}"
    _, _, raw, o = next(language.slices(pa.array([text])))
    d = language.lowered(raw)
    t, s, e = language.words(d, o, language.LETTER)
    p = language.posteriors(m.emissions(d, s, e, language.span_hashes(d, s, e)), t, 1, m.transitions).argmax(1)
    assert (p[: len(p) // 3] == m.labels.index("en")).mean() > 0.8
    assert (p[-len(p) // 3 :] == m.labels.index("de")).mean() > 0.8


def test_odd_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    rows = [(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "12 34 !", "en"), (None, "the of and", None), (10**6 + 3, "— “”", None), (10**6 + 4, "the and of " * 20_000, None), (10**6 + 4, "the and of " * 20_000, None)]
    got = language.identify(docs.unionByName(spark.createDataFrame(rows, docs.schema))).where("doc_id >= 1000000 or doc_id is null").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7
    assert [by[10**6 + k]["lang_pred"] for k in range(4)] == ["und", "und", "und", "und"]
    assert by[None]["lang_pred"] == "en" and by[None]["held_out"] and by[10**6 + 4]["lang_pred"] == "en"
    nothing = spark.createDataFrame([(1, "words here", None)], docs.schema)
    assert language.identify(nothing).first()["lang_pred"] == "und"
    assert language.identify(docs.limit(0)).count() == 0


def test_filter_keeps_a_text_of_three_languages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    langs = [r["lang"] for r in docs.where("lang is not null and length(text) > 400").select("lang").distinct().orderBy("lang").limit(3).collect()]
    part = lambda lang: " ".join(docs.where(f"lang = '{lang}' and length(text) > 400").orderBy("doc_id").first()["text"].split()[:30])
    own = spark.createDataFrame([(10**7, " ".join(map(part, langs)))], "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) as lang", "'s' as source", "cast(0 as bigint) as n_chars")
    more = docs.unionByName(own.selectExpr(*[f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" for f in docs.schema]))
    assert len(langs) == 3 and language.identify(more).where("doc_id = 10000000").first()["score"] < 0.5
    assert language.with_language(more).where("doc_id = 10000000").count() == 1


def test_filter_keeps_whole_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    more = docs.unionByName(docs.limit(1).selectExpr("cast(10000000 as bigint) as doc_id", "'12 !' as text", "lang", "source", "n_chars"))
    got = language.with_language(more)
    assert got.schema == docs.schema and got.count() == docs.count()


def test_memory_of_scoring_does_not_follow_the_batch():
    import tracemalloc

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)) for _ in range(600)]
    m = language.train([(t, lang) for t, lang in zip(texts[:20], ["aa", "bb"] * 10, strict=True)], epochs=1)
    tracemalloc.start()
    names, scores = language.score_texts(m, pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak
    alone = [language.score_texts(m, pa.array([t])) for t in texts[::20]]
    assert names[::20] == [n[0] for n, _ in alone]
    assert abs(scores[::20] - [s[0] for _, s in alone]).max() < 1e-5
