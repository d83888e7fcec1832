"""Best-fit packing planned on a histogram of lengths.

The plan is made over counts of lengths, never over documents: its size depends on the capacity alone. Documents then
take the planned slots by their rank within their length.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, strings, task, texts, written

CAPACITY = 2048
SEPARATOR = 0
#: Rows of one length that one task ranks; more are dealt over more groups.
RANK_ROWS = 4096
#: White space of this length is left to the library: the pattern of the other one needs stack for each character of it.
LONG_BLANK = re.compile(r"\s{20000}")
#: Chunks of text whose ids a worker remembers.
CACHE_CHUNKS = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary, as the tokenizers library gives them. Texts with very long blanks go to it.

    The pre-tokenizer never joins what stands before a space with the space if the character before it is no white
    space, so a text splits there into chunks that encode by themselves, and common chunks are encoded once.
    """

    def __init__(self, ranks_path: str, library_path: str, pattern: str, special: dict[str, int], cache: int = CACHE_CHUNKS):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.limit, self.library_path = tuple(special), cache, library_path
        self.known: dict[str, bytes] = {}
        self.library = None

    def slowly(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.library_path)
            self.library.no_truncation()
            self.library.no_padding()
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.bpe.encode(text, allowed_special="all", disallowed_special=())
        else:
            ids = self.bpe.encode_ordinary(text)
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(text) >= 20000 and LONG_BLANK.search(text):
            return self.slowly(text)
        parts = text.split(" ")
        found = list(map(self.known.get, parts))
        found[0] = b""
        if None in found:
            for i, b in enumerate(found):
                if b is None:
                    if not (p := parts[i]) or p[-1].isspace() or p[-1] < " ":
                        return self.whole(text)  # a run of white space: its parts depend on each other
                    b = found[i] = self.known.get(p) or self.whole(f" {p}")
                    if len(self.known) < self.limit:
                        self.known[p] = b
        if len(parts) > 1 and parts[0] and (parts[0][-1].isspace() or parts[0][-1] < " "):
            return self.whole(text)
        if len(parts) > 1 and not parts[0]:  # the first space belongs to the second part already
            return b"".join(found)
        found[0] = self.whole(parts[0])
        return b"".join(found)


def encoder(ranks_path: str, library_path: str, pattern: str, special: dict[str, int]) -> Encoder:
    """One for each worker process, as long as it packs; its memory is bounded."""
    key, encoders = (ranks_path, library_path, pattern, tuple(special.items())), kept(__name__)
    if key not in encoders:
        encoders[key] = Encoder(ranks_path, library_path, pattern, special)
    e = encoders[key]
    if len(e.known) >= e.limit:
        e.known.clear()
    return e


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full pieces, after a shorter first one if need be."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, ranks_path: str, library_path: str, pattern: str, special: dict[str, int], capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids, then the separator, in pieces of at most capacity ids.

    A null text is empty and gives one piece with the separator alone. Repeated rows give their pieces as often.
    with_ids adds the ids (binary, little-endian unsigned 32-bit).
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(ranks_path, library_path, pattern, special), separator.to_bytes(4, "little")
        for b in it:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                ids = memoryview(e.ids(text) + end)
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * s : 4 * (s + n)]
                    rows.append((doc_id, k, s, n, zlib.crc32(own)) + ((bytes(own),) if with_ids else ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(task(run), PIECES + ", ids binary" * with_ids)


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts. Returns the slots and the number of sequences.

    A slot (length, lo, hi, base, offset, each) takes the ranks lo to hi - 1 of its length: rank r goes to sequence
    base + (r - lo) // each, at offset + ((r - lo) % each) * length. Sequences with as much room left are one group,
    so that work and plan follow the number of distinct lengths.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    order: list[int] = []
    slots, made = [], 0

    def add(left: int, base: int, many: int) -> None:
        if many and left:
            if left not in room:
                room[left] = []
                bisect.insort(order, left)
            room[left].append((base, many))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} in sequences of {capacity}")
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                left = order[at]
                base, many = room[left].pop()
                if not room[left]:
                    del room[left]
                    order.pop(at)
            else:
                left, base, many = capacity, made, -(-todo // (capacity // length))
                made += many
            each = min(left // length, todo)
            used = min(many, todo // each)
            slots.append((length, rank, rank + used * each, base, capacity - left, each))
            rank, todo = rank + used * each, todo - used * each
            add(left - each * length, base, used)
            add(left, base + used, many - used)
    return slots, made


def ranked(pieces: DataFrame, most: int) -> DataFrame:
    """Adds rank: 0, 1, ... within each length. most: the count of the most frequent length.

    A frequent length is dealt over groups by a hash, ranked in each, and shifted by the sizes of the groups before.
    """
    groups = max(1, -(-most // RANK_ROWS))
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "start", "ids_crc32")
    return dealt.withColumn("_r", F.row_number().over(own) - 1).join(shifts, ["length", "_g"]).withColumn("rank", F.col("_r") + F.col("_shift")).drop("_g", "_r", "_shift")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, which must be a stored table).

    An empty table gives an empty one; equal rows take different slots. The plan is broadcast: it holds at most a
    few slots for each pair of a length and a room, whatever the number of rows.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots, _ = best_fit(counts, capacity)
    plan = spark.createDataFrame(slots, "length long, _lo long, _hi long, _base long, _at long, _each long")
    rows = ranked(pieces, max(counts.values(), default=0)).join(F.broadcast(plan), "length").where("rank >= _lo and rank < _hi")
    placed = rows.withColumn("sequence_id", F.expr("_base + (rank - _lo) div _each")).withColumn("offset", F.expr("_at + ((rank - _lo) % _each) * length"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, ranks_path: str, library_path: str, pattern: str, special: dict[str, int], capacity: int = CAPACITY) -> DataFrame:
    """Pieces of docs (doc_id, text) with their places. Texts are encoded once, into a table in the shared folder."""
    return pack(written(token_pieces(docs, ranks_path, library_path, pattern, special, capacity), "pieces"), capacity)
