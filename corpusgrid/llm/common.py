"""What the training-data operators share: the cluster's shared folder, lineage cuts, row keys, batch slicing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that end a word or are stripped from a line: space and 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: Maps A-Z to a-z in UTF-8 and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all runs in one process (tests) a local
    one is made; on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpusgrid-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialises a small relation in the shared folder and forgets its lineage; it outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame, name: str) -> DataFrame:
    """Materialises a larger relation as Parquet in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, with a broadcast hint if it has been counted to have no more than so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def wide_hash(*columns: Column) -> list[Column]:
    """Two differently seeded 64-bit xxhashes: together 128 bits. Nulls hash as absent."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)]


def bounded(df: DataFrame) -> DataFrame:
    """df, for Python operators: its session sends them small Arrow batches, so that neither the executor's buffers nor its
    Python workers hold many long texts at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


#: How each module's caches in a Python worker are emptied.
HELD: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Memory that is free goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def take_turn(module: str) -> None:
    """Called by an operator's tasks as they begin: a worker process serves one operator after another, and keeps the caches of the
    present one alone."""
    others = [empty for name, empty in HELD.items() if name != module]
    for empty in others:
        empty()
    if others:
        gc.collect()
    give_back()


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes of the column, at least a row each, so that memory is bounded by the longest text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of about limit bytes of the column, at least a row each."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column):
            held.append(part)
            size += part.column(column).nbytes
            if size >= limit:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def open_store(uri: str):
    """(filesystem, path) for a file in the shared folder, whatever store that is."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_once(uri: str, data_chunks) -> None:
    """Writes a new file under an attempt's own name; parents are made. A failed attempt leaves a file that no manifest names."""
    fs, path = open_store(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        for chunk in data_chunks:
            out.write(chunk)
