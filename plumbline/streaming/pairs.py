"""Image pairs that arrive over time: a stream of pair names, each processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PAIRS = "pair_id string, monitored string, reference string"


def stream_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON files of pairs in a folder, as a stream."""
    return spark.readStream.schema(PAIRS).json(folder)


def process_stream(pairs: DataFrame, process: Callable[[str, str, str], None], checkpoint: str) -> StreamingQuery:
    """Calls process(pair_id, monitored, reference) for each pair of each batch.

    The checkpoint remembers what is done; a batch that was cut off is done again, so processing a pair twice must give
    the same files.
    """

    def batch(df: DataFrame, _: int) -> None:
        for r in df.dropDuplicates(["pair_id"]).toLocalIterator():
            process(r["pair_id"], r["monitored"], r["reference"])

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
