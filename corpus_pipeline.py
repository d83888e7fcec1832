"""A training corpus from documents: language, exact copies, near copies, personal data, packing.

Stages name a row by its id and its text, not by its id alone: rows of one id with different texts are different documents,
and of rows that repeat both one stays. A missing id is an id like others. Columns that are not named here pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common, exact, jaccard, language, packing, pii
from plumbline.llm.queries import PACK_SPECIAL

#: So many rows to drop are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _kept(docs: DataFrame, key: Column, found: DataFrame) -> DataFrame:
    """The rows of docs that found (doc_id, key, kept: a stored table with a row for each of docs) keeps, each but once."""
    name = "key"
    while name in docs.columns:
        name = f"_{name}"
    rows, names = docs.withColumn(name, key), docs.columns

    def met(some: DataFrame, how: str, these: DataFrame) -> DataFrame:
        if these.count() <= BROADCAST_ROWS:
            these = F.broadcast(these)
        other = these.select(F.col("doc_id").alias("_other_id"), F.col("key").alias("_other_key"))
        return some.join(other, F.col("doc_id").eqNullSafe(F.col("_other_id")) & (F.col(name) == F.col("_other_key")), how)

    stays = met(rows, "left_anti", found.where("not kept").select("doc_id", "key").distinct())
    twice = found.where("kept").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key")
    if twice.isEmpty():
        return stays.select(*names)
    again = met(stays, "left_semi", twice)
    longest = Window.partitionBy("doc_id", name).orderBy(F.desc(F.length("text")), "text")
    one = again.withColumn(f"{name}_place", F.row_number().over(longest)).where(F.col(f"{name}_place") == 1)
    return met(stays, "left_anti", twice).select(*names).unionByName(one.select(*names))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the field knows; those without one, without a letter or without a text go.

    Repeated rows stay as they are; an empty table gives an empty one.
    """
    return language.with_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one that exact_dedup keeps, once if its row is repeated.

    Null, empty and blank texts are one group, of which one document stays; an empty table gives an empty one.
    """
    found = common.written(exact.exact_dedup(docs).select(F.col("doc_id"), F.col("text_sha256").alias("key"), "kept"), "copies")
    return _kept(docs, F.sha2(exact.normal(F.coalesce("text", F.lit(""))), 256), found)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id, once if its row is repeated.

    Texts without words and null texts have no near copies, so only rows that repeat one of them go; an empty table gives an empty one.
    """
    found = jaccard.classes(docs).select("doc_id", F.col("t").alias("key"), (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("t") == F.col("class_t"))).alias("kept"))
    return _kept(docs, F.xxhash64(F.coalesce("text", F.lit(""))), common.written(found, "near"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and n_chars following the text. Null texts and those without any stay as they are."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences. A null or empty text is one piece, the separator alone."""
    import public_tokenizers as vocabularies

    return packing.pack_documents(docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, PACK_SPECIAL)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mask_pii", mask_pii), ("pack", pack)]

#: SQL has no network and no tokenizer; the rows are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result but the last written and read again.

    What a stage wrote on its way, and the result before it, go once its own result is written.
    """
    docs, before = common.documents(spark, sf_dir), None
    with common.small_batches(spark):
        for name, stage in STAGES[:-1]:
            path = common.scratch(spark, name)
            with common.temporary(spark):
                docs = common.written(stage(spark, docs, sf_dir), name, path)
            if before:
                common.delete(spark, before)
            before = path
        return STAGES[-1][1](spark, docs, sf_dir)
