"""Similarity join of texts on the Jaccard similarity of their word 5-grams, by chosen paths.

Each set of shingles walks down a tree of its own: at a node it picks shingles by a hash of node and shingle, in
proportion to one over its size, and goes on with each of them; similar sets pick shared shingles and reach shared leaves.
Runs with other seeds are repeated until the target recall. Leaves are compared by brute force on small sketches, in
blocks where they are large; that gives candidate groups, within which every pair of sets is verified exactly.

Equal sets are one class from the start, so that copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, task, texts, written
from .components import components, spread_join
from .textbytes import WHITE, mix, shingles, span_hashes, words

WIDTH, SIMILARITY = 5, 0.8
#: Depth of the tree, picks for each node, target recall for a pair just similar enough.
DEPTH, PICKS, RECALL = 3, 1.4, 0.997
#: Minimal hashes in a sketch, and how much below the threshold an estimate may be: four deviations.
SKETCH = 64
#: Members of a candidate group (by their sets) and of a leaf (by their sketches) that one task compares; more are dealt over pairs of blocks.
BLOCK, LEAF_BLOCK = 256, 1024
#: So many candidates are broadcast, at 16 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Pairs of sketches that one task compares, about.
TASK_PAIRS = 1 << 24

MEMBERS = "doc_id long, t long, d1 long, d2 long, size int, sketch binary, paths array<long>"


def runs_for(similarity: float, recall: float = RECALL, depth: int = DEPTH, picks: float = PICKS) -> int:
    """Runs after which two sets of that similarity share a leaf with probability recall at least, whatever their sizes.

    Both pick a shared shingle below the limit of the larger set. Least of it is shared where one set holds the other.
    """
    shared = picks * similarity  # shingles both pick at a node, on average
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-shared * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def leaves(u: np.ndarray, seeds: np.ndarray, depth: int = DEPTH, picks: float = PICKS) -> np.ndarray:
    """The leaves that a set of shingles reaches from the roots of all runs."""
    limit = np.uint64(min((1 << 64) - 1, int((1 << 64) * picks / len(u))))
    out = []
    for part in range(0, len(seeds), 8):
        nodes = seeds[part : part + 8]
        for _ in range(depth):
            found = []
            for k in range(0, len(nodes), max(1, (1 << 20) // len(u))):
                v = mix(u[None, :] ^ nodes[k : k + max(1, (1 << 20) // len(u)), None])
                found.append(v[v <= limit])
            nodes = np.unique(np.concatenate(found)) if found else nodes[:0]
        out.append(nodes)
    return np.unique(np.concatenate(out))


_salts = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(u: np.ndarray) -> bytes:
    """The least hash of a set under each of the sketch's hashes, 16 bits of it."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(u), 4096):
        v = u[k : k + 4096, None] * _salts[None, :]
        v ^= v >> np.uint64(32)
        low = np.minimum(low, v.min(0))
    return (mix(low) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def members(docs: DataFrame, similarity: float) -> DataFrame:
    """The sets of docs (doc_id, text), t being a hash of the text: digest, size, sketch and leaves. Words are what stands between ASCII white space."""
    seeds = mix(np.arange(1, runs_for(similarity) + 1, dtype=np.uint64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi, data, offsets in slices(b.column(2)):
                text, start, end = words(data, offsets, ~WHITE)
                rows = []
                for u in shingles(text, span_hashes(data, start, end), hi - lo, WIDTH):
                    if len(u):
                        d = [int(mix(u + np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for k in (1, 2)]
                        rows.append((*d, len(u), sketch(u), leaves(u, seeds).astype(np.int64)))
                    else:
                        rows.append((0, 0, 0, b"", np.zeros(0, np.int64)))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *[pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[f.split(" ")[0] for f in MEMBERS.split(", ")])

    return hashed(docs).mapInArrow(task(run), MEMBERS)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, t, text: what names a row of docs is its id, null or not, and the hash of its text."""
    return texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").select("doc_id", F.xxhash64("text").alias("t"), "text")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index connected with each of n."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            break
    return root


def dealt(rows: DataFrame, count: str, id_column: str, block: int) -> DataFrame:
    """Rows of groups of a count with `part` and `other`: small groups as one part, large ones over all pairs of blocks of about block rows."""
    blocks = F.when(F.col(count) <= 2 * block, F.lit(1)).otherwise(F.ceil(F.col(count) / block)).cast("int")
    own = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64(id_column), F.col("_blocks")).cast("int"))
    return own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(*rows.columns, F.least("_own", "_with").alias("part"), F.greatest("_own", "_with").alias("other"), F.col("_own").alias("own"))


def grouped(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal first columns in sorted batches, each as one table."""
    rest: pa.Table | None = None
    for b in it:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows, bool)
        for k in range(keys):
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        t = t.combine_chunks()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield t.slice(lo, hi - lo)
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between sets whose sketches are alike in a shared leaf, as many as span them."""
    spots = sets.select("rep", F.explode("paths").alias("path"))
    sizes = spots.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(spots.join(sizes, "path").select("path", "n", "rep"), "leaves")  # few leaves are shared: sketches come after
    rows = dealt(shared.join(sets.select("rep", "sketch"), "rep"), "n", "rep", LEAF_BLOCK).select("path", "part", "other", "own", "rep", "sketch")
    # Bytes say little of the cost of a leaf, which goes by its pairs: as many tasks as these ask for.
    pairs = shared.agg(F.sum(F.least("n", F.lit(2 * LEAF_BLOCK)) * F.greatest(F.lit(1), F.ceil(F.col("n") / LEAF_BLOCK))).alias("s")).first()["s"] or 0
    tasks = int(min(100_000, max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))))
    least = SKETCH * similarity - 4 * math.sqrt(SKETCH * similarity * (1 - similarity))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in grouped(it, 3):
            n = t.num_rows
            if n < 2:
                continue
            rep = t.column(4).to_numpy()
            s = np.frombuffer(b"".join(t.column(5).to_pylist()), "<u2").reshape(n, SKETCH)
            same = np.zeros((n, n), np.uint8)
            for k in range(SKETCH):
                same += s[:, k, None] == s[None, :, k]
            x, y = np.nonzero(np.triu(same >= least, 1))
            root = _roots(n, x, y)
            joined = root != np.arange(n)
            a.append(rep[joined])
            b.append(rep[root[joined]])
            if sum(map(len, a)) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    placed = rows.repartition(tasks, "path", "part", "other").sortWithinPartitions("path", "part", "other")
    return placed.mapInArrow(task(run), "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets."""
    n = len(sets)
    token, where = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    count = np.bincount(where, minlength=len(token))
    shared = np.flatnonzero(count > 1)
    new = np.full(len(token), -1)
    new[shared] = np.arange(len(shared))
    out = np.diag([len(s) for s in sets]).astype(np.float32)
    col = new[where]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for lo in range(0, len(shared), 2048):
        a, b = np.searchsorted(col, [lo, lo + 2048])
        x = np.zeros((n, min(2048, len(shared) - lo)), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        part = x @ x.T
        np.fill_diagonal(part, 0)
        out += part
    return out


def verified(docs: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """For the sets of candidate groups (rep, root, n, copies, doc_id, t): (rep, to, links), one row or more for each set.

    doc_id and t name a row with the set's text; of repeated rows one is read. links adds up, over the rows of a set, to the
    documents of other sets that are similar enough; to names a set that it is connected with, itself if there is none in
    the block.
    """
    few = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    named = few.select("rep", "root", "n", "copies", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.isnull("doc_id").alias("_none"), "t")
    body = hashed(docs).select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.isnull("doc_id").alias("_none"), "t", "text")
    once = body.join(named, ["_id", "_none", "t"]).groupBy("rep", "root", "n", "copies").agg(F.min("text").alias("text"))
    placed = dealt(once, "n", "rep", BLOCK).select("root", "part", "other", "rep", "own", "copies", "text").repartition("root", "part", "other").sortWithinPartitions("root", "part", "other", "rep")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(it, 3):
            rep, own, copies = (t.column(k).to_numpy() for k in (3, 4, 5))
            sets = []
            for lo, hi, data, offsets in slices(t.column(6)):
                text, start, end = words(data, offsets, ~WHITE)
                sets += shingles(text, span_hashes(data, start, end), hi - lo, WIDTH)
            size = np.array([len(s) for s in sets])
            inter = overlaps(sets)
            close = inter >= similarity * (size[:, None] + size[None, :] - inter) - 1e-6
            np.fill_diagonal(close, False)
            part, other = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            counted = close if part == other else close & (own[:, None] != own[None, :])
            links = counted @ copies
            x, y = np.nonzero(np.triu(close, 1))
            root = _roots(len(rep), x, y)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(rep[root]), pa.array(links.astype(np.int64))], names=["rep", "to", "links"])

    return placed.mapInArrow(task(run), "rep long, to long, links long")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, t (a hash of the text), class_id, class_t, n_links.

    class_id and class_t name the first row of the class: that with the smallest doc_id, then the smallest t; a row without an
    id comes after all others. Sets have numbers of their own, so repeated and missing ids keep their texts apart.
    """
    table = written(members(docs, similarity), "members")
    full = table.where("size > 0")
    row = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "t")
    grouped_sets = full.groupBy("d1", "d2", "size").agg(F.min(row).alias("row"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    sets = written(grouped_sets.withColumn("rep", F.monotonically_increasing_id()), "sets")
    groups = components(candidates(sets, similarity))
    counts = groups.groupBy("root").agg(F.count("*").alias("n"), F.count("*").alias("many"))
    in_group = spread_join(groups.withColumnRenamed("node", "rep"), counts, "root", groups.count()).withColumnRenamed("many", "n")
    ready = written(in_group.join(sets.select("rep", "copies", "row.doc_id", "row.t"), "rep").select("rep", "root", "n", "copies", "doc_id", "t"), "groups")
    found = written(verified(docs, ready, similarity), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "rep")
    first = roots.join(sets.select("rep", "row"), "rep").groupBy("root").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    firsts = spread_join(roots, first, "root", roots.count()).select("rep", "first")
    named = sets.select("d1", "d2", "size", "rep", "copies", "row").join(links, "rep", "left").join(firsts, "rep", "left")
    named = named.select("d1", "d2", "size", F.coalesce("first", "row").alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = full.select("doc_id", "t", "d1", "d2", "size").join(named, ["d1", "d2", "size"]).select("doc_id", "t", F.col("first.doc_id").alias("class_id"), F.col("first.t").alias("class_t"), "n_links")
    alone = table.where("size = 0").select("doc_id", "t", F.col("doc_id").alias("class_id"), F.col("t").alias("class_t"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id, n_links.

    n_links is the number of other rows whose sets of word 5-grams have a Jaccard similarity of similarity or more;
    class_id the smallest doc_id of the rows that are connected by such links, null if none of them has an id. A text of
    fewer than five words has one shingle, all of it; a text without words, or a null one, has no link and is its own class.
    Rows that repeat an id are rows like others. An empty table gives an empty one; other columns are not read.
    """
    return classes(docs, similarity).select("doc_id", "class_id", "n_links")
