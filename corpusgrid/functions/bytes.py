"""Byte-level column functions: histograms and what follows from them, for a batch of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a sample.
SAMPLE = 16_384
#: Characters that count as structure.
STRUCTURE = '{}[]:,<>/="'
#: Least shares of printable, structure and white space.
PRINTABLE, STRUCTURED, BLANK = 0.85, 0.08, 0.12


def views(data: Iterable[bytes | None] | pa.Array) -> list[np.ndarray]:
    """The bytes of each binary; null as none. Those of an Arrow column aren't copied."""
    if not isinstance(data, pa.Array):
        return [np.frombuffer(b or b"", np.uint8) for b in data]
    data = pc.fill_null(data.cast(pa.large_binary()), b"")
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1].tolist() if len(data) else []
    flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def histograms(data: Iterable[bytes | None] | pa.Array) -> np.ndarray:
    """How often each of the 256 bytes occurs in each binary. One is counted after another: to count all at once takes some twenty bytes
    for each byte of a batch, which may have 64 MB."""
    out = [np.bincount(b, minlength=256) for b in views(data)]
    return np.stack(out) if out else np.zeros((0, 256), np.int64)


def sliced(data: pa.Array, rows: int = 1000) -> Iterator[pa.Array]:
    """A column by so many rows, so that what is made of them stays small whatever the session's batches."""
    return (data.slice(i, rows) for i in range(0, len(data), rows))


@F.arrow_udf(T.DoubleType())
def entropy(data: pa.Array) -> pa.Array:
    """Bits a byte; 0 for no bytes."""
    out = [np.zeros(0)]
    for part in sliced(data):
        hist = histograms(part)
        p = hist / np.maximum(hist.sum(axis=1, keepdims=True), 1)
        out.append(-(p * np.log2(np.where(hist > 0, p, 1.0))).sum(axis=1) + 0.0)
    return pa.array(np.concatenate(out))


PROFILE = T.StructType([T.StructField("class", T.StringType()), T.StructField("signature", T.ArrayType(T.IntegerType()))])


def profiles(data: Iterable[bytes | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """class: Binary, StructuredText or Text; no bytes are Binary. Plain prose is StructuredText, for its share of white space is enough.
    signature: 16 buckets of the high half-byte, scaled to 255 and rounded."""
    hist = histograms(data)
    n = hist.sum(axis=1)
    some = np.maximum(n, 1)
    blank, structure = hist[:, [9, 10, 13, 32]].sum(axis=1), hist[:, [ord(c) for c in STRUCTURE]].sum(axis=1)
    binary = (n == 0) | (hist[:, 0] > 0) | ((blank + hist[:, 33:127].sum(axis=1)) / some < PRINTABLE)
    rich = (structure / some >= STRUCTURED) | (blank / some >= BLANK)
    buckets = hist.reshape(-1, 16, 16).sum(axis=2)
    signature = (buckets * 255 + (some // 2)[:, None]) // some[:, None]
    return np.where(binary, "Binary", np.where(rich, "StructuredText", "Text")), signature.astype(np.int32)


@F.arrow_udf(PROFILE)
def profile(data: pa.Array) -> pa.Array:
    """profiles() of a column."""
    parts = [profiles(part) for part in sliced(data)]
    kinds = pa.array([k for x, _ in parts for k in x.tolist()], pa.string())
    flat = np.concatenate([np.zeros(0, np.int32), *(x.ravel() for _, x in parts)])
    signatures = pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1, dtype=np.int32) * 16), pa.array(flat))
    return pa.StructArray.from_arrays([kinds, signatures], ["class", "signature"])


def sample(text: str, n: int = SAMPLE) -> Column:
    """The first n bytes of a text. Only they leave the JVM."""
    return F.substring(F.encode(text, "UTF-8"), 1, n)


def distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, v: s + v)
