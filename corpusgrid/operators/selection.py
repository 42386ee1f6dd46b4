"""Selection: extents of files in blocks, path and regex filters, block pruning and projected ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.operators.planning import BLOCK, block_table, document_files, file_order, n_docs
from corpusgrid.plans.intervals import coalesce_ranges, overlap_join
from corpusgrid.plans.scale import running
from corpusgrid.sources.corpus import read


def normal_prefix(prefix: str) -> str:
    """A path filter: separators as /, without empty and . components. Absolute, empty and .. are errors."""
    text = prefix.strip().replace("\\", "/")
    parts = [p for p in text.split("/") if p not in ("", ".")]
    if text.startswith("/") or not parts or ".." in parts:
        raise ValueError(f"not a path inside the archive: {prefix!r}")
    return "/".join(parts)


def selected(files: DataFrame, prefixes: list[str] = (), regexes: list[str] = (), required: bool = False, is_directory: bool = True) -> DataFrame:
    """Files whose path equals or is below a prefix, or that a regex finds anywhere. required: selecting nothing is an error. Filters on
    an archive of a single file, not is_directory, are an error."""
    if not is_directory and (prefixes or regexes):
        raise ValueError("paths are selected in archives of directories only")
    test = F.lit(False)
    for p in map(normal_prefix, prefixes):
        test = test | (F.col("path") == p) | F.col("path").startswith(p + "/")
    for r in (r.strip() for r in regexes):
        if not r:
            raise ValueError("empty regex")
        test = test | F.col("path").rlike(r)
    out = files.where(test)
    if required and not out.limit(1).count():
        raise ValueError("no path matches")
    return out


def extents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a file in a block."""
    files = document_files(spark, sf_dir)
    rows = n_docs(spark, sf_dir)
    placed = file_order(files, BLOCK, rows).select("path", "size", "content_offset", "end")
    blocks = block_table(files, BLOCK, rows).withColumn("block_end", F.col("raw_offset") + F.col("raw_len"))
    both = overlap_join(placed, blocks, "content_offset", "end", "raw_offset", "block_end", BLOCK)
    start = F.greatest("content_offset", "raw_offset")
    return both.select("block_id", "path", "content_offset", (start - F.col("raw_offset")).alias("block_offset"), (start - F.col("content_offset")).alias("file_offset"), (F.least("end", "block_end") - start).alias("len"))


def q_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extents_of(spark, sf_dir).drop("content_offset")


PREFIXES, REGEXES = ["documents/src1/", "documents\\src3/./de"], [r"src7/.*/\d*5\.txt$", r"\.gz$"]


def q_select_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(document_files(spark, sf_dir), PREFIXES).select("path", "size")


def q_select_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(document_files(spark, sf_dir), (), REGEXES).select("path", "size")


def q_select_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(document_files(spark, sf_dir), PREFIXES, REGEXES, required=True).select("path", "size")


def pruned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(blocks that a selection touches, the selection's ranges)."""
    files, rows = document_files(spark, sf_dir), n_docs(spark, sf_dir)
    want = selected(file_order(files, BLOCK, rows), PREFIXES).select(F.col("content_offset").alias("want_start"), F.col("end").alias("want_end"))
    blocks = block_table(files, BLOCK, rows).withColumn("block_end", F.col("raw_offset") + F.col("raw_len"))
    return overlap_join(blocks, want, "raw_offset", "block_end", "want_start", "want_end", BLOCK, "left_semi"), want


def q_prune_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned(spark, sf_dir)[0].select("block_id", "raw_offset", "raw_len")


def q_project_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection's ranges on the axis of the selected blocks alone, touching ones merged."""
    blocks, want = pruned(spark, sf_dir)
    axis = running(blocks, [F.col("block_id")], {"upto": "raw_len"}).withColumn("axis", F.col("upto") - F.col("raw_len"))
    hit = overlap_join(axis, want, "raw_offset", "block_end", "want_start", "want_end", BLOCK)
    shift = F.col("axis") - F.col("raw_offset")
    pieces = hit.select((F.greatest("raw_offset", "want_start") + shift).alias("range_start"), (F.least("block_end", "want_end") + shift).alias("range_end"))
    return coalesce_ranges(pieces, "range_start", "range_end")


def q_clip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each decoded block is written for the selection."""
    blocks, want = pruned(spark, sf_dir)
    hit = overlap_join(blocks, want, "raw_offset", "block_end", "want_start", "want_end", BLOCK)
    start = F.greatest("raw_offset", "want_start")
    return hit.select("block_id", (start - F.col("raw_offset")).alias("skip"), (F.least("block_end", "want_end") - start).alias("take"))


def encoded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with a made-up but fixed encoding outcome: algorithm, raw pass-through, encoded length, reference."""
    b = block_table(document_files(spark, sf_dir), BLOCK, n_docs(spark, sf_dir))
    i = F.col("block_id")
    algo = F.when(i % 3 == 0, "lz4").when(i % 3 == 1, "zstd").otherwise("lzma")
    ref = F.when(i % 11 == 10, i - 10)
    raw = F.col("force_raw") | (i % 7 == 3)
    enc = F.when(ref.isNotNull(), 0).when(raw, F.col("raw_len")).otherwise(F.expr("raw_len * (40 + block_id % 60) div 100"))
    return b.withColumns({"algo": algo, "reference_target": ref, "raw_passthrough": raw & ref.isNull(), "encoded_len": enc.cast("long"), "block_end": F.col("raw_offset") + F.col("raw_len")})


def costs_of(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each file's share of its blocks' encoded bytes, by overlap; files without content have no row."""
    hit = overlap_join(files, blocks, "content_offset", "end", "raw_offset", "block_end", BLOCK)
    hit = hit.withColumn("overlap", F.least("end", "block_end") - F.greatest("content_offset", "raw_offset"))
    share = F.col("encoded_len") * F.col("overlap") / F.col("raw_len")
    near = ~F.col("raw_passthrough") & F.col("reference_target").isNull() & (F.col("encoded_len") / F.col("raw_len") >= 0.98)
    part = lambda cond, name: F.sum(F.when(cond, F.col("overlap")).otherwise(0)).alias(name)
    out = hit.groupBy("path", "size").agg(F.round(F.sum(share), 4).alias("est_bytes"), part(F.col("raw_passthrough"), "raw_bytes"), part(near, "near_raw_bytes"), part(F.col("reference_target").isNotNull(), "reference_bytes"), *[part(F.col("algo") == a, f"{a}_bytes") for a in ("lz4", "zstd", "lzma")])
    return out.withColumn("est_ratio", F.round(F.col("est_bytes") / F.col("size"), 6))


def file_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_order(document_files(spark, sf_dir), BLOCK, n_docs(spark, sf_dir)).select("path", "size", "content_offset", "end")
    return costs_of(files, encoded_blocks(spark, sf_dir))


def q_file_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_costs(spark, sf_dir)


def q_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists of ten: the largest files, the dearest, the least compressible."""
    costs = file_costs(spark, sf_dir)
    lists = [("size", ["size", "est_bytes"]), ("est_bytes", ["est_bytes", "size"]), ("est_ratio", ["est_ratio", "est_bytes"])]
    tops = [costs.orderBy(F.desc(a), F.desc(b), "path").limit(10).select(F.lit(name).alias("list"), "path", "size", "est_bytes", "est_ratio") for name, (a, b) in lists]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


def q_queue_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue sizes for a decode, from the nearest-rank 95th percentile and the largest block; 8 workers."""
    # Queue multipliers and least sizes, shares of the headroom.
    workers, max_bytes, d_mul, d_min, o_mul, o_min, r_mul, share = 8, 1 << 20, 4, 8, 8, 16, 8, 4
    q = encoded_blocks(spark, sf_dir).withColumn("queue_bytes", F.greatest("raw_len", "encoded_len"))
    a = q.agg(F.count("*").alias("n"), F.max("raw_len").alias("max_raw"), F.max("encoded_len").alias("max_enc"), F.expr("percentile_disc(0.95) within group (order by queue_bytes)").cast("long").alias("p95"))
    a = a.withColumn("lim", F.expr(f"least(greatest(ceil(greatest({max_bytes}, p95) / p95), 1), greatest(n, 1))"))
    a = a.withColumn("decode_q", F.expr(f"greatest(least(greatest({workers * d_mul}, {d_min}), lim, n), 1)"))
    a = a.withColumn("skew", F.expr("ceil(greatest(max_raw, max_enc, 1) / greatest(p95, 1))"))
    a = a.withColumn("adaptive", F.expr(f"decode_q + ceil(greatest(lim - decode_q, 0) * case when skew <= 2 then 3 when skew <= 4 then 2 else 1 end / {share})"))
    a = a.withColumn("write_q", F.expr(f"least(greatest(greatest(least(greatest({workers * o_mul}, {o_min}), lim, n), 1), adaptive, decode_q), lim, n)"))
    return a.select("n", "max_raw", "max_enc", "p95", F.col("lim").cast("long").alias("inflight"), F.col("decode_q").cast("long").alias("decode_q"), F.col("write_q").cast("long").alias("write_q"), F.expr(f"greatest(least(write_q * {r_mul}, lim, n), 1)").cast("long").alias("reorder_limit"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
