import hashlib
import os
import random
import re

import numpy as np
import pytest

from plumbline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
SCHEMA = "doc_id long, text string"
LARGER = "/root/testdata/sf0.1"


def brute(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in pii.IP_RAW.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_by_brute_force():
    rng = random.Random(4)
    bits = ["a", ".", "@", "x.y", "1", "12", "255", "256", " ", "-", "+", "4539578763621486", "(", ")", "é", "1.2.3.4", "a@b.c", "+1 (222) 333-4444", "%", "0"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute(t), t


def test_long_texts_take_linear_time():
    assert pii.base_spans("1" * 300_000) == []
    assert pii.base_spans("a" * 300_000 + "@") == []
    assert pii.base_spans("@" * 100_000) == []


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = pii.new_net(rng)
    for p in net.all():
        p += rng.normal(0, 0.1, p.shape).astype(p.dtype)
    x, y = rng.integers(0, pii.CLASSES, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    _, grads = pii.crf_step(net, x, y)
    for p, g in zip(net.all(), grads, strict=True):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        keep, h = p[at].copy(), 1e-2
        p[at] = keep + h
        up = pii.crf_step(net, x, y)[0]
        p[at] = keep - h
        down = pii.crf_step(net, x, y)[0]
        p[at] = keep
        assert (up - down) / (2 * h) == pytest.approx(float(g[at]), rel=0.05, abs=1e-3)


def corpus(n=240, seed=8):
    rng = random.Random(seed)
    card = "4539578763621486"
    forms = [lambda: f"{rng.choice('abc')}x{rng.randint(0, 99)}@mail{rng.randint(0, 9)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: card, lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"]
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7)))
    return [" ".join(rng.choice(forms)() if rng.random() < 0.1 else str(rng.randint(0, 9999)) if rng.random() < 0.05 else word() for _ in range(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def net():
    return pii.Reader(pii.train(corpus(), steps=250))


def decoded(reader, texts):
    """What the network says of each text by itself, without the exact check."""
    out = [set() for _ in texts]
    for k, a, e in pii.open_chains(reader, [pii.classes(t) for t in texts]):
        out[k] |= {(s + a, kind, u + a) for s, kind, u in pii.decode(reader.net, e)}
    return out


def test_network_finds_held_out_spans(net):
    some = corpus(40, seed=99)
    base = [pii.base_spans(t) for t in some]
    found = sum(s in got for b, got in zip(base, decoded(net, some), strict=True) for s in b)
    assert found / sum(map(len, base)) > 0.8


def brute_chains(reader, text):
    """All windows of the text by the training code's scores, blended, and the whole chain decoded at once."""
    c = pii.classes(text)
    total, weight = np.zeros((len(c), pii.TAGS)), np.zeros((len(c), 1))
    for lo in pii.starts(len(c)):
        x = np.full((1, pii.WIDTH), pii.PAD)
        own = c[lo : lo + pii.WIDTH]
        x[0, : len(own)] = own
        e, _ = pii.scores(reader.net, x)
        total[lo : lo + len(own)] += e[: len(own), 0] * pii._ramp[: len(own)]
        weight[lo : lo + len(own)] += pii._ramp[: len(own)]
    return set(pii.decode(reader.net, total / weight))


def test_stretches_give_the_decoding_of_the_whole_chain(net, monkeypatch):
    some = [t for t in corpus(12, seed=31)] + ["ax12 (at) mail3 (dot) example (dot) com", "x", "", " " * 500 + "+1 (222) 555-1234"]
    want = [brute_chains(net, t) if t else set() for t in some]
    for batch in (1, 3, 512):  # windows of one text in several batches
        monkeypatch.setattr(pii, "BATCH", batch)
        assert decoded(net, some) == want


def test_other_spellings_are_added_and_checked(net):
    rng = random.Random(6)
    n = lambda form: "".join(str(rng.randint(0, 9)) if c == "0" else c for c in form)
    forms = [lambda: n("bx00 (at) mail0 (dot) example (dot) com"), lambda: n("cx0[at]mail0.example.com"), lambda: n("10[.]0[.]00[.]1"), lambda: n("001 (000) 555-0000"), lambda: "4539.5787.6362.1486"]
    hits = total = 0
    for k, t in enumerate(corpus(60, seed=77)):
        body, at = forms[k % len(forms)](), t.index(" ")
        ((base, spans),) = pii.find_spans(net, [t[:at] + " " + body + t[at:]])
        assert set(base) <= set(spans)
        total += 1
        hits += any(a <= at + 2 and at + len(body) <= b for a, _, b in spans)
    assert hits / total > 0.7
    plain = ["plain words without anything", "", "version 3.14 of 2024", n("on 0000-00-00 at 00:00:00 for $0,000.00")]
    assert pii.find_spans(net, plain) == [([], [])] * len(plain)


def test_texts_without_a_mark_have_no_span():
    """Nothing that the exact check accepts is lost by not reading texts without a digit or an at-sign in some spelling."""
    rng = random.Random(12)
    bits = ["a", "x.y", "@", "at", "(at)", "[at]", "(", "[", "]", ")", " ", "dot", "(dot)", "[.]", ".", "com", "+", "-", "/", "1", "12", "255", "2222", "5555", "\u0663"]
    accepted = 0
    for _ in range(60_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        for kind in range(4):
            if pii.plausible(t, 0, kind, len(t)):
                accepted += 1
                assert pii.MARK.search(t), t
    assert accepted > 100


@pytest.mark.parametrize("text", ["1.2.3." + "0" * 5000, "0" * 10_000 + "1.2.3.4", "1" * 2_000_000, "0" * 2_000_000, " " * 2_000_000, "\n" * 1_000_000 + "@", "1 " * 500_000, "+1" + "(" * 500_000, "a@" * 200_000, "1." * 500_000], ids=range(10))
def test_odd_texts_do_not_stop_a_job(net, text):
    ((base, spans),) = pii.find_spans(net, [text])
    assert set(base) <= set(spans)


def test_zero_padded_parts():
    assert pii.octets("1.2.3." + "0" * 5000) and pii.octets("0" * 5000 + "1.2.3.4") and not pii.octets("1.2.3." + "0" * 5000 + "256") and not pii.octets("1.2.3." + "9" * 5000)


def test_scan(spark, net):
    rows = [(i, t) for i, t in enumerate(corpus(30))] + [(100, None), (101, ""), (None, "a@b.cd"), (102, "x" * 120_000 + " a@b.cd"), (103, "a@b.cd"), (103, "a@b.cd")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA + ", spans string, n_ip int")
    got = pii.scan(df, net.net).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        want = brute(text[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.show(want).encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == j for _, k, _ in want) for j in range(4))
    assert pii.scan(spark.createDataFrame([], SCHEMA)).count() == 0  # nothing to train from


def test_redact(spark, net):
    df = spark.createDataFrame([(1, "to a@b.cd and 1.2.3.4", 21), (2, None, None), (3, "clean", 5), (4, "1.2.3." + "0" * 5000, 5006)], SCHEMA + ", n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(df, net.net).collect()}
    assert got == {1: ("to [EMAIL] and [IP]", 19), 2: (None, None), 3: ("clean", 5), 4: ("[IP]", 4)}


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the larger tables are not here")
def test_spans_are_added_to_the_test_documents(spark):
    """Rewritten forms planted in every second document are found; other documents have their base spans and cards with a slip."""
    whole = spark.read.parquet(f"{LARGER}/documents.parquet").where("text is not null").select("doc_id", "text")
    docs = whole.where("doc_id % 20 < 2")
    planted = docs.selectExpr("doc_id", "case when doc_id % 2 = 0 then concat('write to bob7 (at) mail3 (dot) example (dot) com or 10[.]20[.]30[.]40 now. ', text) else text end as text")
    got = pii.scan(planted, pii.fit(whole)).collect()
    marked = [r for r in got if r["doc_id"] % 2 == 0]
    assert sum("email:9:48" in r["spans"] and "ip:52:69" in r["spans"] for r in marked) / len(marked) > 0.8
    assert all(":" not in r["spans"] or set(k.split(":")[0] for k in r["spans"].split(",")) <= set(pii.KINDS) for r in got)
