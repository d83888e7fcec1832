import os
import random

import numpy as np
import pytest

from plumbline.llm import toxicity

LARGER = "/root/testdata/sf0.1"


def texts(n, toxic, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    bad = ["zzgrim", "qqfoul", "Xxvile"]
    out = []
    for _ in range(n):
        w = [word() for _ in range(60)]
        for _ in range(rng.randint(1, 4) if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad) + ("" if rng.random() < 0.7 else word())
        out.append(" ".join(w))
    return out


def test_learns_from_positives_and_unlabelled():
    m = toxicity.train(texts(200, True, 1), texts(630, False, 2) + texts(70, True, 3), 0.1)
    import pyarrow as pa

    bad, good = m.scores(pa.array(texts(100, True, 5))), m.scores(pa.array(texts(300, False, 6)))
    assert (bad >= 0.5).mean() > 0.9 and (good >= 0.5).mean() < 0.03
    assert m.scores(pa.array(["", None, "zzgrim " * 3]))[0] < 0.5
    same = m.scores(pa.array(["zzgrim and more", "ZZGRIM and more"]))
    assert same[0] == same[1]


def test_scores_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    m = toxicity.train(texts(60, True, 1), texts(200, False, 2) + texts(20, True, 3), 0.1)
    column = pa.array(texts(40, True, 4) + ["", None])
    whole = m.scores(column)
    assert np.allclose(whole, np.concatenate([m.scores(column.slice(k, 7)) for k in range(0, 42, 7)]))


def test_held_out_documents(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the larger tables are not here")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).where("held_out").join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").toPandas()
    bad = got["toxic"] == 1
    auc = (got["score"].rank()[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.93
    assert got["predicted"][bad].mean() > 0.85 and got["predicted"][~bad].mean() < 0.02


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts(60, True, 1) + texts(300, False, 2))]
    labels = [(i, 1 if i < 60 else 0) for i in range(0, 200)] + [(None, 1), (3, None), (3, 1), (99_999, 1)]
    odd = [(None, "zzgrim qqfoul"), (1000, None), (1001, ""), (1002, "word " * 50_000), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1.0, "q") for r in rows + odd], "doc_id long, text string, score double, held_out string")
    made = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, made).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["held_out"] and by[None]["predicted"] == 1 and by[1000]["predicted"] == 0 == by[1001]["predicted"]
    assert not any(r["predicted"] for r in toxicity.score_toxicity(docs, made.limit(0)).collect())
    assert toxicity.score_toxicity(docs.limit(0), made).count() == 0


@pytest.mark.parametrize("negative", [True, False])
def test_empty_training(negative):
    m = toxicity.train([] if negative else ["a"], ["b"], 0.1)
    assert m.bias < 0 and not m.weights.any()


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_risk_gradient_by_differences(prior):
    """The step is the gradient of the risk; where the negative part is below zero it is the rise of that part, turned round."""
    rng = np.random.default_rng(3)
    f, p = rng.normal(0, 1, 40) + 2 * (prior > 0.5), np.arange(40) < 12
    share_p, share_u = p / p.sum(), ~p / (~p).sum()
    value, step = toxicity.risk(f, share_p, share_u, prior)
    loss = lambda z, y: np.log1p(np.exp(-y * z))
    negative = lambda z: share_u @ loss(z, -1) - prior * (share_p @ loss(z, -1))
    assert value == pytest.approx(prior * (share_p @ loss(f, 1)) + max(0, negative(f)))
    whole = (lambda z: toxicity.risk(z, share_p, share_u, prior)[0]) if negative(f) > 0 else (lambda z: -negative(z))
    for k in range(40):
        d = np.eye(40)[k] * 1e-5
        assert step[k] == pytest.approx((whole(f + d) - whole(f - d)) / 2e-5, abs=1e-6)


def test_weights_at_zero_have_a_slope_below_the_cost():
    """No feature is left out of the risk: at the end of the lasso those without a weight have too small a slope to get one."""
    confirmed, unlabelled = texts(150, True, 1), texts(450, False, 2) + texts(50, True, 3)
    sample = toxicity.Sample([*confirmed, *unlabelled])
    is_p = np.arange(sample.n) < len(confirmed)
    w, b = toxicity.descend(sample, is_p, ~is_p, 0.1)
    assert 0 < (w != 0).sum() < len(w)
    every = toxicity.Sample([*confirmed, *unlabelled])
    row, k, value = every.columns(np.arange(len(every.features)))
    dense = np.zeros((sample.n, len(every.features)))
    dense[row, k] = value
    assert np.allclose(dense.std(0), 1, atol=1e-3)  # scaled columns
    g = np.random.default_rng(0).normal(size=sample.n)
    assert np.allclose(sample.slopes(g), g @ dense)


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(5)
    p, u = rng.normal(3, 1, 1000), np.concatenate([rng.normal(3, 1, 600), rng.normal(0, 1, 3400)])
    assert toxicity.estimated_prior(p, u) == pytest.approx(0.15, abs=0.03)
    assert 0 < toxicity.estimated_prior(np.zeros(3), np.zeros(3)) <= 0.95
