"""Helpers shared by the operators: tables, written intermediates and packed shuffles."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
_own: list[str] = []


#: Rows and bytes of an Arrow batch, where the session leaves Spark's defaults: a batch is held by the JVM and by Python, twice
#: each, and most of a worker's arrays follow its size.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if the driver started elsewhere; keep Arrow batches small."""
    for name, (default, own) in BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, own)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir; one of our own only where that is unset and all
    executors are threads of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="blobloom-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


_folders: set[str] = set()


def _drop(spark: SparkSession, folder: str) -> None:
    """At the end of the application its tables go; a folder that can't be reached any more stays."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: computed once, and safe when executors are lost. What an
    application has written is deleted when it ends, or by forget()."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/blobloom-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_drop, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files go when the driver collects the plans that made them, which it would do too seldom by itself.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        _drop(t.sparkSession, t.written_to)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory back: workers are reused, and what one task needed at its peak would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(fn: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def u64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def whole(docs: DataFrame) -> DataFrame:
    """docs as one struct column, doc, so that nothing added to it can clash with a column's name."""
    return docs.select(F.struct("*").alias("doc"))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of whole()."""
    x = batch.column(0)
    text = x.field(x.type.get_field_index("text"))
    return text if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else text.cast(pa.string())


def added(docs: DataFrame, ddl: str) -> T.StructType:
    """The schema of whole(docs) with more columns."""
    return T.StructType([T.StructField("doc", docs.schema), *T.StructType.fromDDL(ddl).fields])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_binary(chunks: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([c if isinstance(c, bytes) else c.tobytes() for c in chunks], pa.binary())


def slices(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose rows are values[ends[i-1]:ends[i]]."""
    offs = np.concatenate([np.zeros(1, np.int64), ends]) * values.itemsize
    if offs[-1] > 2**31 - 1:
        return as_binary([values[a // values.itemsize : b // values.itemsize] for a, b in zip(offs[:-1], offs[1:])])
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def list_positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... (count of them) for each of the runs, one after another."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    out = [struct.pack("<B", len(arrays))]
    for x in arrays:
        raw = np.ascontiguousarray(x).tobytes()
        packed = pa.compress(raw, "zstd", asbytes=True) if raw else b""
        out += [struct.pack("<2sQQ", x.dtype.str[1:].encode(), len(raw), len(packed)), packed]
    return b"".join(out)


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    """The arrays of squeeze()."""
    out, at = [], 1
    for _ in range(blob[0]):
        kind, n, packed = struct.unpack_from("<2sQQ", blob, at)
        at += 18
        out.append(np.frombuffer(pa.decompress(memoryview(blob)[at : at + packed], n, "zstd") if n else b"", np.dtype(kind.decode())))
        at += packed
    return out
