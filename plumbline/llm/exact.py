"""Exact deduplication over a log-structured merge index of digests. DataFrame operations only.

A batch of digests is flushed as a sorted run: one row for each digest with the row that stays and the number of rows. Each
run has a filter, a blocked Bloom filter held as a table of words, which says for most digests that the run does not hold
them. Compaction merges the runs of a full level into one of the next; of each digest the smallest entry stays. The index
lives in a folder of the shared storage, with a manifest for each state, so another session can open it and add to it.

Rows that share a digest are hits, and their bytes are compared with those of the row that stays; a digest for which bytes
differ is grouped anew by its texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, texts, written

#: What the normal form leaves out.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Runs that a level holds before they are merged; batches that a table is flushed in.
FANOUT, BATCHES = 4, 4
#: Bits of a filter for each digest, and how many of them a digest sets, within one word of 64.
FILTER_BITS, FILTER_SET = 16, 4
#: Hits of one digest that one task compares; a larger group is dealt over more.
VERIFY_ROWS = 1024
#: So many entries are broadcast, at 60 bytes each, and so many words of a filter, at 16; more are joined by a shuffle.
BROADCAST_HITS, BROADCAST_WORDS = 200_000, 1 << 20
#: Digests of so many rows are joined apart from the rest: a table has few of them, whatever its size.
HOT_ROWS = 1 << 16
RUN = "digest binary, keep_id long, n long, copies long"
MANIFEST = "level int, path string, rows long, words long"


def normal(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as doc_id, digest, n (code points). A null text is empty."""
    return texts(docs, "doc_id").select("doc_id", F.unhex(F.sha2(normal(F.col("text")), 256)).alias("digest"), F.length("text").cast("long").alias("n"))


def merged(entries: DataFrame) -> DataFrame:
    """One entry for each digest: most characters stay, then the smallest id (a missing one before all); copies add up."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("keep_id").alias("id")))
    found = entries.groupBy("digest").agg(best.alias("best"), F.sum("copies").alias("copies"))
    return found.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("n"), "copies")


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(words)).alias("word")


def _bits() -> Column:
    """The bits that a digest sets in its word, from other bytes of it than the word."""
    out = F.lit(0).cast("long")
    for k in range(FILTER_SET):
        place = F.conv(F.hex(F.substring("digest", 1 + 2 * k, 1)), 16, 10).cast("int") % 64
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out.alias("bits")


@dataclass
class Run:
    level: int
    path: str
    rows: int
    words: int
    spark: SparkSession = field(repr=False, compare=False)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.path}/run")

    def filter(self) -> DataFrame:
        return self.spark.read.schema("word long, bits long").parquet(f"{self.path}/filter")


def filter_of(entries: DataFrame, words: int) -> DataFrame:
    """A filter of the digests of entries: the words that hold a bit."""
    return entries.select(_word(words), _bits()).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def passing(rows: DataFrame, made: DataFrame, words: int) -> DataFrame:
    """rows with _maybe: false where a filter says that it does not hold the digest. A large filter is not asked."""
    if words > BROADCAST_WORDS:
        return rows.withColumn("_maybe", F.lit(True))
    asked = rows.withColumn("_word", _word(words)).join(F.broadcast(made.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))), "_word", "left")
    return asked.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(_bits()) == _bits(), F.lit(False))).drop("_word", "_bits")


class Index:
    """A log-structured merge index in a folder of the shared storage."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "index")
        self.runs: list[Run] = []
        self.states = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The last state that was written whole."""
        it = cls(spark, path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*/_SUCCESS")
        found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)
        names = sorted(s.getPath().getParent().getName() for s in found)
        if names:
            it.states = int(names[-1].rsplit("-", 1)[1]) + 1
            it.runs = [Run(r["level"], r["path"], r["rows"], r["words"], spark) for r in spark.read.schema(MANIFEST).parquet(f"{path}/{names[-1]}").orderBy("path").collect()]
        return it

    def _flush(self, level: int, entries: DataFrame) -> Run:
        path = scratch(self.spark, f"run-{level}")
        entries.sortWithinPartitions("digest").write.parquet(f"{path}/run")
        run = Run(level, path, 0, 1, self.spark)
        run.rows = run.entries().count()
        run.words = max(1, -(-run.rows * FILTER_BITS // 64))
        filter_of(run.entries(), run.words).write.parquet(f"{path}/filter")
        return run

    def _state(self, runs: list[Run]) -> None:
        rows = [(r.level, r.path, r.rows, r.words) for r in runs]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest-{self.states:06d}")
        self.runs, self.states = runs, self.states + 1

    def add(self, batch: DataFrame) -> None:
        """Flushes a batch (doc_id, digest, n), then merges levels that are full. Rows that are added again count again."""
        own = merged(batch.select("digest", F.col("doc_id").cast("long").alias("keep_id"), "n", F.lit(1).cast("long").alias("copies")))
        runs, level = [*self.runs, self._flush(0, own)], 0
        while len(full := [r for r in runs if r.level == level]) >= FANOUT:
            runs = [r for r in runs if r.level != level] + [self._merge(full, level + 1)]
            level += 1
        self._state(runs)

    def _merge(self, runs: list[Run], level: int) -> Run:
        every = runs[0].entries()
        for r in runs[1:]:
            every = every.unionByName(r.entries())
        return self._flush(level, merged(every))

    def compact(self) -> Run | None:
        """Merges all runs into one; None of an empty index."""
        if len(self.runs) > 1:
            self._state([self._merge(self.runs, max(r.level for r in self.runs) + 1)])
        return self.runs[0] if self.runs else None

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The entries of the digests in wanted (digest) that the index holds. A run is read for those that pass its filter."""
        asked, found = wanted.select("digest").distinct(), self.spark.createDataFrame([], RUN)
        for r in self.runs:
            some = passing(asked, r.filter(), r.words).where("_maybe").select("digest")
            found = found.unionByName(r.entries().join(some, "digest", "left_semi"))
        return merged(found)


def with_entries(rows: DataFrame, hits: DataFrame, many: int) -> DataFrame:
    """rows with the columns of hits (digest, keep_id, copies), null where there is none. Few hits are broadcast, hot ones always."""
    if many <= BROADCAST_HITS:
        return rows.join(F.broadcast(hits), "digest", "left")
    hot, rest = F.broadcast(hits.where(F.col("copies") >= HOT_ROWS)), hits.where(F.col("copies") < HOT_ROWS)
    return rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(rest, "digest", "left"))


def differing(docs: DataFrame, hits: DataFrame, many: int) -> DataFrame:
    """The digests of hits (digest, keep_id, copies) under which bytes differ from those of the row that stays."""
    body = texts(docs, "doc_id").select("doc_id", normal(F.col("text")).alias("body"))
    full = with_entries(body.withColumn("digest", F.unhex(F.sha2("body", 256))), hits, many).where("copies is not null")
    parts = F.ceil(F.col("copies") / VERIFY_ROWS)
    salted = full.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts))
    stays = full.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "copies").agg(F.min("body").alias("kept_body"))
    kept = stays.select("digest", "kept_body", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return salted.join(kept, ["digest", "part"]).where("body <> kept_body").select("digest").distinct()


def exact_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without white space; a null text is empty, so empty, null and blank texts are one
    group. Equal texts of one length tie by the smallest doc_id; rows that repeat the id of the row that stays are all
    marked kept, and each counts in group_size. A row without an id ties before all others. An empty table gives an empty one; other columns are not read.

    The table is flushed in batches of memtables, one for each task. A filter of the hits then tells which rows have a text of
    their own; only the others are joined with the index.
    """
    spark = docs.sparkSession
    rows = written(digests(docs).withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(batches))), "digests")
    index = Index(spark)
    for k in range(batches):
        index.add(rows.where(F.col("batch") == k).drop("batch"))
    hits = index.compact().entries().where("copies > 1").select("digest", "keep_id", "copies")
    many = hits.count()
    words = max(1, -(-many * FILTER_BITS // 64))
    asked = passing(rows.drop("batch"), filter_of(hits, words), words)
    own = asked.where("not _maybe").select("doc_id", "digest", F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    held = with_entries(asked.where("_maybe").drop("_maybe", "n"), hits, many)
    alone = F.col("copies").isNull()
    held = held.select("doc_id", "digest", F.when(alone, F.col("doc_id").cast("long")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    found = own.unionByName(held).withColumnRenamed("copies", "group_size")
    if many and (bad := differing(docs, hits, many).collect()):  # as good as never: two texts with one digest
        found = regrouped(docs, found, [bytes(r["digest"]) for r in bad])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def regrouped(docs: DataFrame, found: DataFrame, bad_digests: list[bytes]) -> DataFrame:
    """found (doc_id, digest, keep_id, group_size) with the rows of these digests grouped by their texts."""
    spark = docs.sparkSession
    bad = F.broadcast(spark.createDataFrame([(d,) for d in bad_digests], "digest binary"))
    rows = texts(docs, "doc_id").select("doc_id", normal(F.col("text")).alias("body"), F.length("text").cast("long").alias("n")).withColumn("digest", F.unhex(F.sha2("body", 256))).join(bad, "digest")
    groups = rows.groupBy("digest", "body").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").alias("id"))).alias("best"), F.count("*").alias("group_size"))
    again = rows.join(groups, ["digest", "body"]).select("digest", "doc_id", F.col("best.id").alias("keep_id"), "group_size")
    return found.join(bad, "digest", "left_anti").select(*again.columns).unionByName(again)
