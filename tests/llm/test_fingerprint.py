import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import fingerprint as fp


def points(t):
    return fp.code_points(t)


def test_spans_and_extensions_by_brute_force():
    rng = random.Random(6)
    a = "".join(rng.choice("abé𝒳") for _ in range(200))
    b = a[50:120] + "".join(rng.choice("ab") for _ in range(60)) + a[:40]
    x, y = fp.PrefixHash(points(a)), fp.PrefixHash(points(b))
    for _ in range(400):
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = rng.randrange(0, min(len(a) - i, len(b) - j) + 1)
        assert x.same(i, i + n, y, j) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k
    assert x.extension(50, y, 0) >= 70
    w = x.windows(9)
    assert len(w) == len(a) - 8 and int(w[17]) == x.span(17, 26)


def test_least_is_exact():
    rng = np.random.default_rng(1)
    for n in (1, 10, 64, 65, 5000):
        v = rng.integers(0, 1 << 63, n).astype(np.uint64)
        v = np.concatenate([v, v[: n // 2]])
        assert (fp.least(v, 64) == np.unique(v)[:64]).all()
    assert (fp.least(np.full(9000, 7, np.uint64), 64) == [7]).all()


def test_likeness_follows_the_shared_part():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    a = " ".join(word() for _ in range(800))
    for share in (0, 0.3, 2 / 3, 0.9):
        k = int(len(a) * share)
        b = a[:k] + "".join(rng.choice("ijklmnop") for _ in range(len(a) - k))
        assert fp.likeness(fp.fingerprint(points(a)), fp.fingerprint(points(b))) == pytest.approx(share, abs=0.12)
    f = fp.fingerprint(points(a))
    back = fp.parse(fp.text_form(f))
    assert back[:2] == f[:2] and (back[2] == f[2]).all() and fp.likeness(f, back) == 1.0
    assert fp.likeness(fp.fingerprint(points("")), fp.fingerprint(points(""))) == 1.0
    assert fp.likeness(fp.fingerprint(points("")), f) == 0.0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edited_texts_by_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 3, "".join(rng.choice("abcé𝒳 ") for _ in range(rng.choice([0, 1, 2, 5, 40, 400])))) for i in range(60)]
    rows[7] = (rows[7][0], None)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, part string, halo int")
    got = {r["doc_id"]: r for r in fp.fingerprints(df, parts).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + follow[:cut]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["edited_fingerprint"] == fp.text_form(fp.fingerprint(points(edited)))
        assert got[i]["near_next"] == fp.likeness(fp.fingerprint(points(t)), fp.fingerprint(points(follow)))


def dice(a, b, width):
    x, y = ({t[k : k + width] for k in range(len(t) - width + 1)} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def test_overlaps_of_long_and_of_short_texts(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(300)
    rows = [(100 - k, text(5000) + passage + text(700)) for k in range(8)] + [(k, text(n)) for k, n in enumerate([47, 34, 30, 24, 23, 12, 4, 3])]
    got = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    rows.sort(reverse=True)
    for k, (i, t) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + follow[: len(t) // 3]
        width = min(24, len(t) // 2, len(edited) // 2)
        assert got[i]["near_edited"] == pytest.approx(dice(t, edited, width)) and got[i]["near_edited"] > 0
        if len(t) >= 24 and len(follow) >= 24:
            assert got[i]["near_next"] == pytest.approx(dice(t, follow, 24))
    assert all(got[k]["near_next"] > 0.04 for k in range(94, 101))


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fp.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = fp.fingerprints(spark.createDataFrame([(5, "abcdef")], schema)).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    same = fp.fingerprints(spark.createDataFrame([(1, "x" * 50), (1, "x" * 50), (1, "y"), (None, "z" * 9), (None, "z" * 9)], schema), 4).collect()
    assert len(same) == 5 and len({r["fingerprint"] for r in same}) == 3
    assert fp.fingerprints(spark.createDataFrame([(1, "ab " * 60_000), (2, "q")], schema)).count() == 2
