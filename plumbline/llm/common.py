"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text is cut into slices of about so many bytes before numpy works on it, so that memory does not follow the batch.
SLICE_BYTES = 1 << 20
Model = TypeVar("Model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_made: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that operators wrote in between. What is still to be read has to be written outside."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Whole documents go to Python and back in batches of so many rows, so that a task's memory does not follow the texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder named in spark.checkpoint.dir; inside temporary(), it goes at the end.

    Where that is unset: the warehouse on a cluster, and a temporary folder if driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        alone = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        root = os.path.join(tempfile.gettempdir(), "plumbline-scratch") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and no executor holds the only copy."""
    spark = df.sparkSession
    path = path or scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        delete(df.sparkSession, f.rsplit("/", 1)[0])


def texts(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns in keep and the text, a null text as an empty one; other columns go."""
    return df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("text"))


def crc32_text(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; no copy. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o.astype(np.int64)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows that have about size bytes; a longer row comes alone."""
    data, o = utf8(column)
    lo, n = 0, len(o) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(o, o[lo] + size, "right")) - 1)
        yield lo, hi, data[o[lo] : o[hi]], o[lo : hi + 1] - o[lo]
        lo = hi


def picked(hashed: DataFrame, by: str, many: int) -> DataFrame | None:
    """About many distinct rows by the hash in column by, picked in 64 parts; small enough to be broadcast. None without rows."""
    part = Window.partitionBy(F.pmod(by, F.lit(64))).orderBy(by, *hashed.columns)
    rows = hashed.distinct().withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= -(-many // 64)).drop("_r").collect()
    return F.broadcast(hashed.sparkSession.createDataFrame(rows, hashed.schema)) if rows else None


def release() -> None:
    """Gives memory that is free inside this process back to the system: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What this process keeps from task to task, by the module of the operator.
_kept: dict[str, dict] = {}


def kept(module: str) -> dict:
    """What the tasks of a module keep in this process; it goes when a task of another one begins here."""
    return _kept.setdefault(module, {})


def forget(module: str) -> None:
    """Drops what the tasks of other modules keep: workers live on from stage to stage."""
    others = [m for m in _kept if m != module]
    for m in others:
        del _kept[m]
    if others:
        release()


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1024) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task body that gets its input in small batches, finds nothing that other operators kept, and leaves no free memory behind."""
    module = run.__module__

    def small(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, rows):
                yield b.slice(k, rows)

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(module)
        try:
            yield from run(small(it))
        finally:
            release()

    return go


def fitted(rows: DataFrame, train: Callable[[list[tuple]], Model]) -> Model:
    """What train makes of the rows in order, a bounded sample, in one task: the driver gets the model alone."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in it for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(got))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(task(run), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([])
