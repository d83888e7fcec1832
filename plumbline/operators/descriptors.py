"""Matching of descriptors by their nearest neighbours, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, BLOCKS, LEAST_PARTS = 1024, 4, 16


def _blocks(df: DataFrame, rows: int, side: str) -> DataFrame:
    """One row for each block of about so many descriptors: ids and their vectors, one after the other. A part has a few blocks."""
    n = max(1, -(-df.count() // rows))
    blocks = df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(f"{side}_block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("v"))
    flat = blocks.select(f"{side}_block", F.col("v.vec_id").alias(f"{side}_ids"), F.flatten("v.embedding").alias(side))
    return flat.repartition(min(n, max(LEAST_PARTS, -(-n // BLOCKS))), f"{side}_block")  # a number that is given stays, however small the parts


def k_nearest(qi: np.ndarray, a: np.ndarray, ti: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of the vectors c of each vector in a, by distance and id: q, t, dist.

    Products of matrices tell who may be among them, with a margin for their rounding, so that equal vectors are all looked
    at; the distances of these are then summed by dimension, in the order of the dimensions.
    """
    k = min(k, len(ti))
    norms = (a * a).sum(1), (c * c).sum(1)
    d2 = a @ c.T
    d2 *= -2
    d2 += norms[0][:, None]
    d2 += norms[1][None, :]
    limit = np.partition(d2, k - 1, 1)[:, k - 1] + 1e-12 * (norms[0] + norms[1].max())
    row, col = np.nonzero(~(d2 > limit[:, None]))
    total = np.zeros(len(row))
    for x, y in zip(a.T, c.T, strict=True):
        total += (x[row] - y[col]) ** 2
    dist = np.sqrt(total)
    order = np.lexsort((ti[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    first = np.searchsorted(row, row)  # where a row's candidates begin
    keep = np.arange(len(row)) - first < k
    return qi[row[keep]], ti[col[keep]], dist[keep]


def nearest(query: DataFrame, others: DataFrame, k: int = 2, block: int = BLOCK) -> DataFrame:
    """The k nearest others of each query by Euclidean distance: q, t, dist, rank; ties by id.

    Every query is compared with all others, block by block: a task holds two blocks at once, and gives k rows for each query.
    Parts of both sides meet in tasks of their own; nothing is broadcast.
    """
    pairs = _blocks(query, block, "q").crossJoin(_blocks(others, block, "t").hint("shuffle_replicate_nl")).select("q_ids", "q", "t_ids", "t")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for qi, q, ti, t in zip(b["q_ids"], b["q"], b["t_ids"], b["t"], strict=True):
                a, c = (np.asarray(v, np.float64).reshape(len(i), -1) for i, v in ((qi, q), (ti, t)))
                yield pd.DataFrame(dict(zip(("q", "t", "dist"), k_nearest(np.asarray(qi), a, np.asarray(ti), c, k), strict=True)))

    w = Window.partitionBy("q").orderBy("dist", "t")
    return pairs.mapInPandas(run, "q long, t long, dist double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ratio_test(top2: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Queries whose nearest is nearer than ratio times the second: q, t, dist."""
    best = top2.groupBy("q").agg(F.min_by("t", "rank").alias("t"), F.min("dist").alias("dist"), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("second"))
    return best.where(F.col("dist") < ratio * F.col("second")).select("q", "t", "dist")


def mutual(matches: DataFrame, back: DataFrame) -> DataFrame:
    """Matches (q, t) that are each other's nearest; back holds the nearest query of each other."""
    return matches.join(back.where("rank = 1").select(F.col("q").alias("t"), F.col("t").alias("q")), ["q", "t"], "left_semi")
