import random
import re

import corpus_pipeline
import pytest

from plumbline.llm import pii, queries

pytest.importorskip("public_tokenizers")


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.5 else "".join(rng.choice("aeinorst") for _ in range(6))
    base = [word() for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    own = [(10**6, " ".join(base)), (10**6 + 1, "  ".join(base)), (10**6 + 2, " ".join(near)), (10**6 + 3, "12 34 !"), (10**6 + 4, None), (10**6 + 5, "the of and write to a.b@mail.example.com now")]
    more = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in own], docs.schema))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    at, seen = more, [ids(more)]
    for name, f in corpus_pipeline.STAGES[:-1]:
        at = f(spark, at, data).cache()
        assert at.schema.names == docs.schema.names, name
        seen.append(ids(at))
    assert seen[0] - seen[1] == {10**6 + 3, 10**6 + 4}
    assert 10**6 in seen[1] - seen[2] and 10**6 + 1 in seen[2]  # the longer text stays
    assert 10**6 + 2 in seen[2] - seen[3]
    assert seen[4] == seen[3]
    masked = {r["doc_id"]: r["text"] for r in at.collect()}
    assert masked[10**6 + 5] == "the of and write to [EMAIL] now"
    assert not any(pii.base_spans(t) for t in masked.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, at, data).collect()
    assert {r["doc_id"] for r in packed} == seen[4]
    # by brute force: of equal normal forms one document stays
    text = {r["doc_id"]: r["text"] for r in more.collect()}
    forms = [re.sub("[\x20\x09-\x0d]", "", text[i]) for i in seen[2]]
    assert len(forms) == len(set(forms)) == len({re.sub("[\x20\x09-\x0d]", "", text[i]) for i in seen[1]})


def test_run(spark, data):
    import glob
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, data)
    assert got.count() > 100 and "sequence_id" in got.columns
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left <= {"mask_pii", "pieces"}, left  # the rest is deleted
    assert glob.glob(f"{folder}/pieces-*")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, t int, sketch binary"


def rows(*some):
    return [(i, t, "en", "s", len(t or ""), "k", 1, b"") for i, t in some]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, data, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], SCHEMA), data)
    assert out.count() == 0


def test_repeated_rows_and_ids_and_nulls(spark, data):
    stage = dict(corpus_pipeline.STAGES)
    a, b = "one two three four five six seven", "quite another text of some words"
    some = [(1, a), (1, a), (1, a), (1, "one  two three four five six  seven"), (2, b), (1, b), (None, a), (None, "alone with no id here at all"), (None, "alone with no id here at all"), (3, None), (4, ""), (3, None)]
    docs = spark.createDataFrame(rows(*some), SCHEMA)
    got = stage["exact_dedup"](spark, docs, data)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, "one  two three four five six  seven"), (1, b), (None, "alone with no id here at all"), (3, None)], key=str)
    near = stage["near_dedup"](spark, docs, data)
    assert near.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=str)
    assert [k for k in kept if k[0] is None] == [(None, "alone with no id here at all")] and len([k for k in kept if k[0] == 1]) == 2
    assert len(kept) == 5  # one of each text, and of the null and empty ones, which have no near copies, one for each id
    masked = stage["mask_pii"](spark, spark.createDataFrame(rows((1, "to a@b.cd"), (1, "to a@b.cd"), (None, None)), SCHEMA), data).collect()
    assert sorted((r["text"] for r in masked), key=str) == [None, "to [EMAIL]", "to [EMAIL]"]
    packed = stage["pack"](spark, spark.createDataFrame(rows((1, "x y"), (1, "x y"), (None, None)), SCHEMA), data).collect()
    assert sorted(r["length"] for r in packed) == [1, 3, 3]


def test_copies_are_dropped_by_broadcast_or_shuffle(spark, data, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(rows((1, "a b"), (2, "ab"), (1, "a b"), (3, "c")), SCHEMA)
    got = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, data).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, "a b"), (3, "c")]


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


def test_workers_forget_what_other_operators_kept():
    """A worker that had packed held its encoder, with 400,000 chunks, through the language stage of the next run."""
    import gc
    import weakref

    import public_tokenizers as vocabularies

    from plumbline.llm import common, packing

    def encoder():
        return packing.encoder(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, queries.PACK_SPECIAL)

    def body(it):
        yield from it

    seen = weakref.ref(encoder())
    body.__module__ = packing.__name__
    assert list(common.task(body)(iter([]))) == []
    gc.collect()
    assert seen() is not None and seen() is encoder()  # kept from one task of the operator to the next
    body.__module__ = "plumbline.llm.language"
    assert list(common.task(body)(iter([]))) == []
    gc.collect()
    assert seen() is None
