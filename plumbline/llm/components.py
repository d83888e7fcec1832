"""Connected components of a graph by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

ROUNDS = 40
#: A key is frequent with more rows than this, and than the total over FREQUENT: so there are few, however large the table.
FREQUENT_ROWS = 256
FREQUENT = 2000


def spread_join(rows: DataFrame, by: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with by on key. by has one row for each key and, as n, how many rows have it; total is the sum of n.

    No task gets all rows of a frequent key: frequent ones, FREQUENT at most, are broadcast and their rows stay where they are.
    A null key meets nothing.
    """
    most = max(FREQUENT_ROWS, total // FREQUENT)
    if total <= most:
        return rows.join(by.drop("n"), key)
    frequent = by.where(F.col("n") > most).drop("n")
    rest = rows.join(F.broadcast(frequent.select(key)), key, "left_anti")
    return rows.join(F.broadcast(frequent), key).unionByName(rest.join(by.where(F.col("n") <= most).drop("n"), key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component.

    Each round leaves a written table, so lineage stays short. Nothing but two sums for each round comes to the driver. The
    hub of a star is a frequent key; the joins spread its rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    state = _state(now)
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both.where("v > u"), least, "u", 2 * state["n"]).select("v", F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        linked = spread_join(large, small, "v", state["n"]).select(F.col("u").alias("v"), F.col("m").alias("u"))
        step = linked.unionByName(small.select("v", F.col("m").alias("u")))
        now, before = written(step.where("v <> u").distinct(), "edges"), now
        drop_written(before)
        seen, state = state, _state(now)
        if state == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _state(edges: DataFrame):
    """The number of edges and a sum over all of them, the same if no edge changed."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
