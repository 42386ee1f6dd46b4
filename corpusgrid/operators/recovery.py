"""Recovery: whole files cut into data and parity shards with checksums, and what damage leaves repaired."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.functions.codecs import crc32c, rs_parity, rs_repair
from corpusgrid.operators.coding import content, parts

SHARDS = "size long, data_shards int, shards array<binary>, crcs array<long>"


def checksums(lists: list[list[bytes | None]]) -> list[list[int]]:
    """The CRC-32C of each shard of each list, all computed side by side; of a missing one, as of none."""
    every = iter(crc32c([s or b"" for shards in lists for s in shards]).tolist())
    return [[next(every) for _ in shards] for shards in lists]


def protect(files: DataFrame, percent: int = 20, least: int = 256, most: int = 40) -> DataFrame:
    """files (doc_id, data) as shards: of `least` bytes, longer where a file would have more than `most`, the last padded with zeros;
    then parity shards, percent of the data shards and at least one; a CRC-32C of each. An empty or null file has no shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            sizes, counts, cut = [], [], []
            for data in part.column("data").to_pylist():
                data = data or b""
                width = max(least, -(-len(data) // most))
                n = -(-len(data) // width)
                flat = np.frombuffer(data.ljust(n * width, b"\0"), np.uint8).reshape(n, width)
                cut.append([x.tobytes() for x in (*flat, *rs_parity(flat, max(1, -(-n * percent // 100))))] if n else [])
                sizes.append(len(data))
                counts.append(n)
            columns = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int32()), pa.array(cut, pa.list_(pa.binary())), pa.array(checksums(cut), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "size", "data_shards", "shards", "crcs"])

    return files.select("doc_id", "data").mapInArrow(run, f"doc_id long, {SHARDS}")


def repair(protected: DataFrame) -> DataFrame:
    """doc_id, damaged (shards that are missing or whose checksum doesn't hold), status (ok, repaired, or lost: more are damaged than
    parity covers) and data, null where lost. A file is one row's work: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            rows, columns = [], [part.column(c).to_pylist() for c in names]
            for i, size, n, shards, crcs, sums in zip(*columns, checksums(columns[3])):
                good = {k: np.frombuffer(s, np.uint8) for k, (s, a, b) in enumerate(zip(shards, sums, crcs)) if s is not None and a == b}
                bad, spare = len(shards) - len(good), len(shards) - n
                if bad > spare:
                    rows.append((i, bad, "lost", None))
                    continue
                whole = [good[k] for k in range(n)] if all(k in good for k in range(n)) else rs_repair(good, n, spare)
                rows.append((i, bad, "repaired" if bad else "ok", b"".join(x.tobytes() for x in whole)[:size]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "damaged", "status", "data"])

    names, kinds = ["doc_id", "size", "data_shards", "shards", "crcs"], [pa.int64(), pa.int32(), pa.string(), pa.binary()]
    return protected.select(*names).mapInArrow(run, "doc_id long, damaged int, status string, data binary")


def q_rs_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of every document: how many of data and parity, and their length."""
    p = protect(content(spark, sf_dir))
    return p.select("doc_id", "size", "data_shards", (F.size("shards") - F.col("data_shards")).alias("parity_shards"), F.coalesce(F.length(F.get("shards", F.lit(0))), F.lit(0)).alias("shard_len"))


def q_rs_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after damage: its shards whose number plus document id is a multiple of 11 are altered, of 13 missing."""
    p = protect(content(spark, sf_dir))
    hurt = F.transform("shards", lambda s, k: F.when((F.col("doc_id") + k) % 13 == 0, F.lit(None)).when((F.col("doc_id") + k) % 11 == 0, F.concat(s, F.lit(b"!"))).otherwise(s))
    return repair(p.withColumn("shards", hurt)).select("doc_id", "damaged", "status", F.sha2("data", 256).alias("digest"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
