import hashlib
import random

import pytest

from plumbline.llm import wordbpe

vocabularies = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
ODD = ["", "  a b ", "Σας ΑΣ İx ǅ", "it's I'LL we'd don't 'S", "<|endoftext|>x <|startoftext|>", "<|startoftext|>", "éé é é", "a\x1cb\x1dc \x85x\xa0y", "123 4567 !!! ...", "日本語 ß ﬁ 𝒳 😀👍🏽", "x" * 300, "aaaaaaaaaaaaaaaaaaaaaaaa", "x​y 　z", "<|endoftext|", "\x00\x01", "''''s's"]


@pytest.fixture(scope="module")
def both():
    path = vocabularies.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return wordbpe.Encoder(wordbpe.Vocabulary(path)), t


def check(both, some):
    e, t = both
    for text, (n, ids, decoded) in zip(some, e.encode(some), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids == b"".join(i.to_bytes(4, "little") for i in want), repr(text)
        assert n == len(want)
        assert decoded.decode() == t.decode(want, skip_special_tokens=False)


def test_odd_texts(both):
    check(both, ODD)
    check(both, ODD)


def test_random_texts(both):
    rng = random.Random(3)
    letters = "etaoinshrdlu'.,!?0123ÉéñçÄß \n\tABC日-_"
    check(both, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)])


def test_documents(spark, data, both):
    check(both, [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()])


def test_merges_come_after_their_parts():
    v = wordbpe.Vocabulary(vocabularies.path("word_bpe_49k.json"))
    made = {int(c): r for r, (_, _, c) in enumerate(v.merges)}
    assert len(made) == len(v.merges)
    assert all(made.get(int(a), -1) < r and made.get(int(b), -1) < r for r, (a, b, _) in enumerate(v.merges))


def test_table(spark, both):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 30_000)]
    df = spark.createDataFrame([(*r, 7, "q") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    got = wordbpe.encode_documents(df, vocabularies.path("word_bpe_49k.json")).collect()
    assert sorted((r["n_tokens"] for r in got)) == [0, 0, 0, 2, 30_000]
    empty = hashlib.sha256(b"").hexdigest()
    assert sum(r["ids_sha256"] == empty == r["decoded_sha256"] for r in got) == 3
    assert wordbpe.encode_documents(df.limit(0), vocabularies.path("word_bpe_49k.json")).count() == 0
