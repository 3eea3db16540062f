"""What the operators share: shared scratch space, shipping code to executors, Arrow batches."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tallyfold

# Executors need no copy of this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(tallyfold)


def worker_cache() -> types.ModuleType:
    """A module that lives as long as the Python worker, so that tasks of one worker share what is dear to build."""
    return sys.modules.setdefault("tallyfold_worker_cache", types.ModuleType("tallyfold_worker_cache"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only on one machine (tests), where that is unset, a folder of our own."""
    if at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyfold-"))
    return spark.sparkContext.getCheckpointDir()


_open: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, by any operator, are removed at the end: for callers that have by then used what they were given."""
    _open.append([])
    try:
        yield
    finally:
        for at in _open.pop():
            delete(spark, at)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder: its lineage is cut.

    The table goes when the scope that it was written in ends, or else with the session. Unlike checkpoint() this does not run
    the last stage twice.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/tallyfold-{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(at)
    else:
        atexit.register(_at_exit, spark, at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def path_of(spark: SparkSession, at: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, at: str) -> bool:
    path, fs = path_of(spark, at)
    return fs.exists(path)


def delete(spark: SparkSession, at: str) -> None:
    path, fs = path_of(spark, at)
    fs.delete(path, True)


def _at_exit(spark: SparkSession, at: str) -> None:
    """Runs as the interpreter ends, when the JVM may be gone already: then there is nothing left to do it with."""
    from py4j.protocol import Py4JError, Py4JNetworkError

    try:
        delete(spark, at)
    except (Py4JError, Py4JNetworkError, OSError, TypeError, AttributeError):
        return


def text_of(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its rows, copying nothing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text, and at most so many rows: a longer text has a batch of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        off = flat(b.column(b.schema.get_field_index(column)))[1]
        at = 0
        while at < b.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1))
            yield b.slice(at, end - at)
            at = end


def in_slices(f, column: str = "text", most: int = 4 << 20, rows: int = 1 << 30):
    """A function for mapInArrow that applies f to each slice."""

    def run(batches):
        for b in slices(batches, column, most, rows):
            yield f(b)

    return run
