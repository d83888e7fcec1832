import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import packing, queries

vocabularies = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return packing.encoder(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, queries.PACK_SPECIAL)


ODD = ["", " ", "  ", "\n", "a", " a", "a ", "  a  b ", "a\n b", "a \n b", "a\t\tb  c\n\n d", "don't we'll", "x<|endoftext|> y", "<|endoftext|>", "é ü", "a  b", "a   b", "1234 56 !? ...", "a\x1c b", "日本 語", "a\r\n b", "é a\x00 b"]


def test_ids_are_those_of_the_library(encoder, reference):
    rng = random.Random(1)
    some = ODD + ["".join(rng.choice([" ", "  ", "\n", "a", "the", "1", "!", "é", "'s", "\t"]) for _ in range(40)) for _ in range(300)]
    for t in some * 2:
        want = b"".join(i.to_bytes(4, "little") for i in reference.encode(t, add_special_tokens=False).ids)
        assert encoder.ids(t) == want, repr(t)


def test_ids_of_documents(spark, data, encoder, reference):
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        assert encoder.ids(r["text"]) == b"".join(i.to_bytes(4, "little") for i in reference.encode(r["text"], add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000, "a" + " " * 1_500_000 + "b c", "\t " * 600_000, "x  y" * 10 + "\r\n" * 500_000 + " z", "0" * 1_000_000, "!" * 1_000_000], ids=range(7))
def test_long_runs_do_not_stop_a_job(encoder, reference, text):
    assert encoder.ids(text) == b"".join(i.to_bytes(4, "little") for i in reference.encode(text, add_special_tokens=False).ids)


def by_document(lengths, capacity):
    """Best fit, piece by piece: into the fullest sequence that has room."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        k = min(fit, key=rooms.__getitem__) if fit else None
        if k is None:
            rooms.append(capacity - n)
        else:
            rooms[k] -= n
    return len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_as_many_sequences_as_best_fit_by_document(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(0, 30))}
    assert packing.best_fit(counts, 64)[1] == by_document([n for n, c in counts.items() for _ in range(c)], 64)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(0, 30))}
    slots, made = packing.best_fit(counts, 64)
    cells = set()
    for length, n in counts.items():
        ranks = []
        for size, lo, hi, base, at, each in slots:
            if size == length:
                for r in range(lo, hi):
                    ranks.append(r)
                    s, o = base + (r - lo) // each, at + (r - lo) % each * length
                    assert 0 <= s < made and o + length <= 64
                    new = {(s, p) for p in range(o, o + length)}
                    assert not cells & new
                    cells |= new
        assert sorted(ranks) == list(range(n))
    by = {}
    for s, p in cells:
        by.setdefault(s, []).append(p)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    total = sum(k * n for k, n in counts.items())
    assert made <= 11 / 9 * -(-total // 64) + 2


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def pack(spark, rows, capacity=16, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return packing.pack_documents(df, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, queries.PACK_SPECIAL, capacity).collect()


def test_packed_rows(spark, encoder):
    rows = [(i, " ".join(["word"] * (i % 23))) for i in range(120)] + [(7, None), (None, "no id"), (5, " ".join(["word"] * 5)), (200, "x " * 500)]
    got = pack(spark, rows, schema="doc_id long, text string")
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 16
    total = sum(len(encoder.ids(t or "")) // 4 + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == total
    assert len(seqs) <= -(-total // 16) + 2


def test_empty_table_and_clashing_columns(spark):
    assert pack(spark, []) == []
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, length string, rank string")
    got = packing.pack_documents(df, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, queries.PACK_SPECIAL).collect()
    assert [(r["doc_id"], r["length"], r["offset"]) for r in got] == [(1, 3, 0)]


def test_a_frequent_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    df = spark.range(95).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(3).alias("length"), F.lit(0).alias("ids_crc32"))
    assert sorted(r["rank"] for r in packing.ranked(df, 95).collect()) == list(range(95))
