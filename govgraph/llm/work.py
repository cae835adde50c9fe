"""Shared working storage: cut lineage through tables that every executor can read."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of the rows that Spark sends to a Python worker at once: Spark's own limits allow 64 MB, which the engine and the worker both hold.
BATCH_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a folder of this machine, but only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='govgraph-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stash(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a result to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/govgraph-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts stay small, in this session from now on; a lower limit of its own stands."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit)) > BATCH_BYTES:
        spark.conf.set(limit, BATCH_BYTES)


def spare() -> None:
    """Give memory that is free, but still held by Arrow's pool and the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def steady() -> None:
    """Let the C library keep up to 32 MB that a task frees for its next arrays, instead of asking the system for each; spare() gives it back."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc only
        for what in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            libc.mallopt(what, 32 << 20)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow; workers outlive their tasks, so each task leaves them without the memory that it needed, and begins without what others left."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare()
        try:
            yield from run(batches)
        finally:
            spare()

    return df.mapInArrow(lean, schema)


def packed(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their text as compressed UTF-8 (null stays null): what a shuffle of whole texts moves is less than half."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in df.schema.fields])
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                small = [None if not v.is_valid else pack(v.as_buffer()) for v in part.column(at)]
                yield pa.record_batch([pa.array(small, pa.binary()) if i == at else c for i, c in enumerate(part.columns)], names=names)

    return mapped(df, run, schema)


def unpacked(df: DataFrame, text: str = "text") -> DataFrame:
    """What packed() made, as text again."""
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text else f for f in df.schema.fields])
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                whole = pa.array([unpack(v.as_buffer()) if v.is_valid else None for v in part.column(at)], pa.binary()).cast(pa.string())
                yield pa.record_batch([whole if i == at else c for i, c in enumerate(part.columns)], names=names)

    return mapped(df, run, schema)


def matched(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (doc_id, mark) with right's (d, m), both sides dealt by key at every size: it behaves alike on any input."""
    return left.join(right.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), how).drop("d", "m")


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: its owner cleans the folder
            return
