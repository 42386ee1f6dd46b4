"""Operators on Arrow batches: content-defined chunks, codecs and the encode ladder, clusters, shards, checksums, parity, AES."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.functions.bytes import histograms
from corpusgrid.functions.codecs import cdc_lengths, compressed_size, crc32c, rs_parity
from corpusgrid.operators.content import MAX_SAMPLES, classified
from corpusgrid.operators.dedup import canonical, sized
from corpusgrid.operators.planning import document_files, runs
from corpusgrid.plans.scale import checkpointed, sized_broadcast
from corpusgrid.sources.corpus import read

# Least block of a probe and its windows, members of a cluster, clusters of a class, rounds of refinement.
PROBE_BYTES, PROBE_WINDOW, CLUSTER_MIN, CLUSTERS_MAX, ROUNDS = 32_768, 16_384, 8, 4, 4


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def parts(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows by about so many bytes of data, whatever number of rows the session sends at once: enough of short blocks to work
    on side by side, few of large ones."""
    held, size = [], 0
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column("data")), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lens), 0
        while start < len(lens):
            room = limit - size + (ends[start - 1] if start else 0)
            stop = max(start + 1, int(np.searchsorted(ends, room, "right")))
            held.append(batch.slice(start, stop - start))
            size, start = size + int(lens[start:stop].sum()), stop
            if size >= limit or start < len(lens):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def cdc_chunks(files: DataFrame, least: int, target: int, most: int) -> DataFrame:
    """files(doc_id, data) cut where the content's gear hash says so: doc_id, chunk_no, chunk_offset, chunk_len. Empty files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            lens = cdc_lengths([b or b"" for b in batch.column("data").to_pylist()], least, target, most)
            n = np.array([len(x) for x in lens], np.int64)
            flat = np.concatenate(lens) if lens else np.empty(0, np.int64)
            no = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            at = np.concatenate([np.cumsum(x) - x for x in lens]) if lens else flat
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(no), pa.array(at), pa.array(flat)], ["doc_id", "chunk_no", "chunk_offset", "chunk_len"])

    return files.select("doc_id", "data").mapInArrow(run, "doc_id long, chunk_no long, chunk_offset long, chunk_len long")


def q_cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_chunks(content(spark, sf_dir), 256, 1024, 2048)


def cdc_stream(placed: DataFrame, files: DataFrame, least: int, target: int, most: int) -> DataFrame:
    """The files' content one after another, cut as one stream: run_id, force_raw, chunk_offset (in the stream), chunk_len. A chunk also
    ends where a run does, while superchunks go on at multiples of the stream's offset. placed: doc_id, run_id, force_raw and
    content_offset of the files with content (planning.runs); files: doc_id, data.

    Every superchunk is cut on its own, as no chunk crosses its end; so content moves once, to the superchunk it is in, and no
    task holds more than one superchunk and some MB."""
    span, meta = 8 * most, ["run_id", "force_raw", "content_offset"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for data, run, raw, at in zip(*[batch.column(c).to_pylist() for c in ("data", *meta)]):
                ends = [*range(span - at % span, len(data), span), len(data)]
                rows += [((at + a) // span, run, raw, at + a, data[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None  # [run, raw, start, pieces] of each stretch of a run in a superchunk
        for batch in batches:
            for part, run, raw, at, data in zip(*[batch.column(c).to_pylist() for c in names]):
                if key != (part, run):
                    if size >= 8 << 20:
                        yield lengths(held)
                        held, size = [], 0
                    held.append((run, raw, at, []))
                    key = part, run
                held[-1][3].append(data)
                size += len(data)
        if held:
            yield lengths(held)

    def lengths(held: list[tuple]) -> pa.RecordBatch:
        starts = np.array([at for _, _, at, _ in held], np.int64)
        lens = cdc_lengths([b"".join(x) for *_, x in held], least, target, most, starts % span)
        owner = np.repeat(np.arange(len(held)), [len(x) for x in lens])
        at = np.concatenate([a + np.cumsum(x) - x for a, x in zip(starts, lens)])
        return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held]).take(pa.array(owner)) for i in (0, 1)] + [pa.array(at), pa.array(np.concatenate(lens))], ["run_id", "force_raw", "chunk_offset", "chunk_len"])

    names, kinds = ["part", "run_id", "force_raw", "at", "data"], [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    placed = sized_broadcast(checkpointed(placed.select("doc_id", *meta)), 1_000_000)
    rows = files.select("doc_id", "data").join(placed, "doc_id").select("data", *meta).mapInArrow(pieces, "part long, run_id long, force_raw boolean, at long, data binary")
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "part").sortWithinPartitions("part", "at").mapInArrow(cut, "run_id long, force_raw boolean, chunk_offset long, chunk_len long")


def q_cdc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_stream(runs(document_files(spark, sf_dir), 65_536), content(spark, sf_dir), 256, 1024, 2048)


def q_codec_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and codec: bytes before and after, and the ratio; raw where a codec doesn't help."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, algo, len(b), compressed_size(algo, level, b)) for s, b in zip(batch.column("source").to_pylist(), batch.column("data").to_pylist()) for algo, level in (("lz4", None), ("zstd", 2), ("lzma", 1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["source", "algo", "raw", "encoded"])

    rows = content(spark, sf_dir).select("source", "data").mapInArrow(run, "source string, algo string, raw long, encoded long")
    out = rows.groupBy("source", "algo").agg(F.sum("raw").alias("raw_bytes"), F.sum(F.least("raw", "encoded")).alias("stored_bytes"), F.count_if(F.col("encoded") >= F.col("raw")).alias("kept_raw"))
    return out.withColumn("ratio", F.round(F.col("stored_bytes") / F.greatest("raw_bytes", F.lit(1)), 6))


@F.pandas_udf(T.BooleanType())
def incompressible_window(data: pd.Series) -> pd.Series:
    """Whether zstd doesn't make a window smaller."""
    return data.map(lambda b: b is not None and compressed_size("zstd", 1, bytes(b)) >= len(b))


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size and incompressible: whether all windows (start, and in long blocks middle and end) resist zstd."""
    d = content(spark, sf_dir).withColumn("size", F.length("data").cast("long"))
    last = (F.greatest(F.col("size") - PROBE_WINDOW, F.lit(0))).cast("int")
    at = F.when(F.col("size") >= 2 * PROBE_WINDOW, F.array_distinct(F.array(F.lit(0), F.floor(last / 2).cast("int"), last))).otherwise(F.array(F.lit(0)))
    windows = d.select("doc_id", "size", F.explode(F.transform(at, lambda o: F.substring(F.col("data"), o + 1, F.lit(PROBE_WINDOW)))).alias("w"))
    return windows.select("doc_id", "size", incompressible_window("w").alias("hard")).groupBy("doc_id", "size").agg(F.count("*").alias("windows"), F.bool_and("hard").alias("incompressible"))


def q_probe_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probed(spark, sf_dir)


def q_encode_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each document as an LZMA block: reference, raw by policy, raw by entropy, compressed, or raw for not being
    smaller. Content is read once and never shuffled: the scan tests policy and entropy, compresses what passes (an equal block of the
    batch once), and gives metadata alone, among which equal blocks are then found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            data, raw = batch.column("data").to_pylist(), batch.column("force_raw").to_pylist()
            hist = histograms([b[:PROBE_WINDOW] for b in data])
            p = hist / np.maximum(hist.sum(axis=1, keepdims=True), 1)
            bits = -(p * np.log2(np.where(hist > 0, p, 1.0))).sum(axis=1)
            hard, known, out = [len(b) >= PROBE_BYTES and e > 7.5 for b, e in zip(data, bits)], {}, []
            for b, policy, noise in zip(data, raw, hard):
                if not policy and not noise and b not in known:
                    known[b] = compressed_size("lzma", 1, b)
                out.append(None if policy or noise else known[b])
            digest = [hashlib.sha256(b).hexdigest() for b in data]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(digest), batch.column("force_raw"), pa.array(hard), pa.array(out, pa.int64())], names)

    names = ["doc_id", "size", "digest", "force_raw", "hard", "encoded"]
    d = content(spark, sf_dir).select("doc_id", "data", F.coalesce(F.col("doc_id") % 17 == 0, F.lit(False)).alias("force_raw"))
    d = checkpointed(d.mapInArrow(run, "doc_id long, size long, digest string, force_raw boolean, hard boolean, encoded long"))
    d = canonical(d, ["size", "digest"], "doc_id")
    smaller = F.col("encoded") < F.col("size")
    decision = F.when(F.col("target").isNotNull(), "reference").when(F.col("force_raw"), "raw_policy").when(F.col("hard"), "raw_entropy").when(smaller, "compressed").otherwise("raw_larger")
    stored = F.when(F.col("decision") == "reference", 0).when(F.col("decision") == "compressed", F.col("encoded")).otherwise(F.col("size"))
    return d.withColumn("decision", decision).select("doc_id", "size", "decision", stored.cast("long").alias("stored"))


def cluster(signatures: np.ndarray, wanted: int) -> np.ndarray:
    """The cluster of each signature: centres far from one another, refined a few rounds, clusters of few members merged into the
    nearest. First wins on ties."""
    n = len(signatures)
    wanted = max(1, min(wanted, CLUSTERS_MAX, n // CLUSTER_MIN))
    centres = [signatures[0]]
    far = lambda c: np.abs(signatures[:, None, :] - np.array(c)[None]).sum(axis=2)
    while len(centres) < wanted:
        nearest = far(centres).min(axis=1)
        if nearest.max() == 0:
            break
        centres.append(signatures[int(nearest.argmax())])
    if len(centres) == 1:
        return np.zeros(n, np.int64)
    member = np.zeros(n, np.int64)
    for _ in range(ROUNDS):
        best = far(centres).argmin(axis=1)
        same, member = (best == member).all(), best
        centres = [signatures[member == k].sum(axis=0) // max(1, (member == k).sum()) if (member == k).any() else c for k, c in enumerate(centres)]
        if same:
            break
    mean = lambda k: signatures[member == k].sum(axis=0) // (member == k).sum()
    for k in range(len(centres)):
        if 0 < (member == k).sum() < CLUSTER_MIN:
            others = [j for j in range(len(centres)) if j != k and (member == j).any()]
            if others:
                own = mean(k)
                member[member == k] = min(others, key=lambda j: np.abs(mean(j) - own).sum())
    return member


def q_sig_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the first 512 samples of each class: a group never holds more rows."""
    w = Window.partitionBy("class").orderBy("doc_id")
    docs = classified(spark, sf_dir).select("doc_id", "class", "signature").withColumn("n", F.row_number().over(w)).where(F.col("n") <= MAX_SAMPLES)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        member = cluster(np.array(rows["signature"].tolist(), np.int64), max(1, min(len(rows) // CLUSTER_MIN, CLUSTERS_MAX)))
        return pd.DataFrame({"doc_id": rows["doc_id"], "class": rows["class"], "cluster": member})

    return docs.groupBy("class").applyInPandas(run, "doc_id long, class string, cluster long")


def q_shard_lpt(spark: SparkSession, sf_dir: str, shards: int = 4) -> DataFrame:
    """Files to shards, per source folder: largest first, each to the least loaded shard (bytes, then files, then in rotation). The
    rule is sequential, so a folder's sizes (no content) are one group."""
    files = document_files(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("source"), "path", "size")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "path"], ascending=[False, True])
        load, count, hint, out = [0] * shards, [0] * shards, 0, []
        for size in rows["size"]:
            s = min(range(shards), key=lambda k: (load[k], count[k], (k - hint) % shards))
            load[s] += size
            count[s] += 1
            hint = (s + 1) % shards
            out.append(s)
        return pd.DataFrame({"source": rows["source"], "path": rows["path"], "size": rows["size"], "shard": out})

    return files.groupBy("source").applyInPandas(run, "source string, path string, size long, shard int")


@F.pandas_udf(T.LongType())
def crc32c_of(data: pd.Series) -> pd.Series:
    return pd.Series(crc32c([bytes(b or b"") for b in data]).astype(np.int64))


def q_crc32c_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content(spark, sf_dir).select("doc_id", crc32c_of("data").alias("crc32c"))


def q_corrupt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded checksums against those of blocks some of which were damaged since: every 29th has its first byte replaced, every 37th
    is cut by a byte, every 41st has a byte more. 0 means that none was recorded. All blocks are reported, not the first."""
    i, data = F.col("doc_id"), F.col("data")
    first = F.when(F.substring(data, 1, 1) == F.lit(b"#"), F.lit(b"+")).otherwise(F.lit(b"#"))
    hurt = F.when((i % 29 == 0) & (F.length(data) > 0), F.concat(first, F.substring(data, 2, 1 << 30)))
    hurt = hurt.when((i % 37 == 0) & (F.length(data) > 0), F.expr("substring(data, 1, length(data) - 1)")).when(i % 41 == 0, F.concat(data, F.lit(b"\n"))).otherwise(data)
    d = content(spark, sf_dir).select("doc_id", F.when(i % 31 == 0, 0).otherwise(crc32c_of("data")).alias("stored"), crc32c_of(hurt).alias("found"))
    status = F.when(F.col("stored") == 0, "not recorded").when(F.col("stored") == F.col("found"), "ok").otherwise("corrupt")
    return d.select("doc_id", status.alias("status"))


def q_raw_dedup_window(spark: SparkSession, sf_dir: str, window: int = 16) -> DataFrame:
    """Dedup in each source with a window of so many first insertions, oldest out first; a hit doesn't renew its entry."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", *sized())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, seen, out = rows.sort_values("doc_id"), {}, []
        for i, key in zip(rows["doc_id"], zip(rows["size"], rows["digest"])):
            out.append(seen.get(key))
            if key not in seen:
                seen[key] = i
                if len(seen) > window:
                    del seen[next(iter(seen))]
        return pd.DataFrame({"source": rows["source"], "doc_id": rows["doc_id"], "target": pd.array(out, "Int64")})

    return d.groupBy("source").applyInPandas(run, "source string, doc_id long, target long")


def q_rs_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity of stripes of ten documents, padded to the longest, at 20 percent: digest and length of each parity block."""
    d = content(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).alias("stripe"), "doc_id", "data")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blocks = [bytes(b) for b in rows.sort_values("doc_id")["data"]]
        width = max(map(len, blocks))
        shards = np.array([np.frombuffer(b.ljust(width, b"\0"), np.uint8) for b in blocks]) if width else np.zeros((len(blocks), 0), np.uint8)
        parity = rs_parity(shards, max(1, -(-len(blocks) * 20 // 100)))
        return pd.DataFrame({"stripe": [rows["stripe"].iloc[0]] * len(parity), "parity_no": range(len(parity)), "block_len": [width] * len(parity), "digest": [hashlib.sha256(p.tobytes()).hexdigest() for p in parity]})

    return d.groupBy("stripe").applyInPandas(run, "stripe long, parity_no int, block_len long, digest string")


KEY = "0123456789abcdef0123456789abcdef"


def q_aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AES-256-GCM of every document, random nonce first and tag last, decrypted again."""
    d = content(spark, sf_dir).withColumn("cipher", F.aes_encrypt("data", F.lit(KEY), F.lit("GCM")))
    return d.select("doc_id", F.length("cipher").cast("long").alias("cipher_len"), (F.aes_decrypt("cipher", F.lit(KEY), F.lit("GCM")) == F.col("data")).alias("same"))


def q_aes_wrong_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a key opens the first block of each source: the right one does, another doesn't."""
    d = content(spark, sf_dir).groupBy("source").agg(F.min_by("data", "doc_id").alias("data")).withColumn("cipher", F.aes_encrypt("data", F.lit(KEY), F.lit("GCM")))
    opens = lambda key: F.try_aes_decrypt("cipher", F.lit(key), F.lit("GCM")).isNotNull()
    return d.select("source", opens(KEY).alias("right_key"), opens(KEY[::-1]).alias("wrong_key"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
