"""Planning: extensions, raw policy, file order, manifests, fixed blocks and their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.plans.intervals import explode_range
from corpusgrid.plans.scale import running
from corpusgrid.sources.corpus import corpus_files, document_files, read

# Extensions of files that are stored without compression.
RAW_EXTENSIONS = [
    "7z", "aac", "apk", "avi", "avif", "br", "bz2", "cab", "deb", "dmg", "docx", "epub", "flac", "flv", "gif", "gz", "heic",
    "heif", "jar", "jpeg", "jpg", "jxl", "lz4", "lzma", "m4a", "m4v", "mkv", "mov", "mp3", "mp4", "ogg", "opus", "oxz", "png",
    "pptx", "rar", "rpm", "snap", "sz", "tgz", "webm", "webp", "whl", "wma", "wmv", "xlsx", "xpi", "xz", "zip", "zst", "zstd",
]
# Extensions of pack files, raw where the first .git component is followed by objects/pack.
PACK_EXTENSIONS = ["idx", "pack", "rev"]
# Bounds of the size below which a file is a fragment, and the share of a block.
FRAGMENT_MIN, FRAGMENT_MAX, FRAGMENT_SHARE = 4096, 262_144, 8
BLOCK = 65_536


def extension(path: Column) -> Column:
    """The lower-case extension of the last component; null without one, for a name that only begins with a dot, and for none after the dot."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.nullif(F.lower(F.trim(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))), F.lit(""))


def force_raw(path: Column) -> Column:
    ext = extension(path)
    packed = ext.isin(PACK_EXTENSIONS) & path.rlike(r"^(?:(?!\.git/)[^/]*/)*?\.git/objects/pack/")
    return F.coalesce(ext.isin(RAW_EXTENSIONS) | packed, F.lit(False))


def fragment_limit(block: int) -> int:
    return max(FRAGMENT_MIN, min(FRAGMENT_MAX, block // FRAGMENT_SHARE))


def order_group(block: int) -> Column:
    """0: large files, 1: small ones that are compressed, 2: small raw ones."""
    return F.when(F.col("size") > fragment_limit(block), 0).when(~F.col("force_raw"), 1).otherwise(2)


def file_order(files: DataFrame, block: int, rows: int | None = None) -> DataFrame:
    """files with their place in the archive and the offset of their content."""
    files = files.withColumns({"grp": order_group(block), "one": F.lit(1)})
    out = running(files, [F.col("grp"), F.col("path")], {"place": "one", "end": "size"}, {"raw_before": "force_raw"}, rows)
    return out.withColumn("content_offset", F.col("end") - F.col("size")).drop("one")


def runs(files: DataFrame, block: int, rows: int | None = None) -> DataFrame:
    """Files that have content with the number of their run: consecutive files of one raw policy, which share blocks. Empty files are
    in no block and end no run."""
    placed = file_order(files.where("size > 0"), block, rows).withColumn("flip", F.when(~F.col("force_raw").eqNullSafe(F.col("raw_before")), 1).otherwise(0))
    return running(placed, [F.col("grp"), F.col("path")], {"run_id": "flip"}, None, rows)


def run_blocks(files: DataFrame, block: int, rows: int | None = None) -> DataFrame:
    """One row a run: its raw policy, where it starts, its bytes and how many blocks it fills."""
    out = runs(files, block, rows).groupBy("run_id", "force_raw").agg(F.min("content_offset").alias("run_start"), F.sum("size").alias("run_bytes"))
    return out.withColumn("blocks", F.ceil(F.col("run_bytes") / block).cast("long"))


def block_table(files: DataFrame, block: int, rows: int | None = None) -> DataFrame:
    """The blocks that tile the stream: block_id, run_id, force_raw, raw_offset, raw_len. A run of any length is dealt over all tasks."""
    r = running(run_blocks(files, block, rows), [F.col("run_id")], {"upto": "blocks"}, None, rows)  # no more runs than files
    r = explode_range(r, F.lit(0), F.col("blocks") - 1, "i", spread=True)
    start = F.col("run_start") + F.col("i") * block
    return r.select((F.col("upto") - F.col("blocks") + F.col("i")).alias("block_id"), "run_id", "force_raw", start.alias("raw_offset"), F.least(F.lit(block), F.col("run_start") + F.col("run_bytes") - start).cast("long").alias("raw_len"))


def fixed_chunks(files: DataFrame, target: int) -> DataFrame:
    """Each file cut every target bytes on its own."""
    cut = explode_range(files.where("size > 0"), F.lit(0), F.floor((F.col("size") - 1) / target), "chunk_no")
    at = F.col("chunk_no") * target
    return cut.select("path", "chunk_no", at.alias("chunk_offset"), F.least(F.lit(target), F.col("size") - at).cast("long").alias("chunk_len"))


def n_docs(spark: SparkSession, sf_dir: str) -> int:
    """From the footers alone."""
    return read(spark, sf_dir, "documents").count()


def q_corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_files(spark, sf_dir)


def q_corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.split_part("path", F.lit("/"), F.lit(1)).alias("top")
    return corpus_files(spark, sf_dir).groupBy(top).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


def varied_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids under names with many kinds of extension, some in a .git folder."""
    names = F.array(*[F.lit(x) for x in (".txt", ".JPG", ".tar.gz", ".idx", ".Zst", "", ".pack", ".", ".json")])
    folder = F.when(F.col("doc_id") % 4 == 0, ".git/objects/pack/").when(F.col("doc_id") % 4 == 1, "x/.git/refs/").when(F.col("doc_id") % 4 == 2, "a.b/.git/objects/pack/p").otherwise("docs/.")
    stem = F.concat(folder, F.col("doc_id").cast("string"), F.element_at(names, (F.floor(F.col("doc_id") / 4) % 9 + 1).cast("int")))
    return read(spark, sf_dir, "documents").select(stem.alias("path"))


def q_ext_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_paths(spark, sf_dir).groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"))


def q_raw_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_paths(spark, sf_dir).select("path", extension(F.col("path")).alias("ext"), force_raw(F.col("path")).alias("force_raw"))


def q_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_order(document_files(spark, sf_dir), BLOCK, n_docs(spark, sf_dir)).select("path", "grp", "place", "content_offset")


def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories, then symlinks (one for every 101st document), then files in their order; offsets are prefix sums."""
    files = document_files(spark, sf_dir)
    rows = n_docs(spark, sf_dir)
    parts = F.split("path", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    nothing = F.lit(0).cast("long")
    d = folders.select(F.lit(0).alias("part"), "path", F.lit("directory").alias("kind"), F.lit(None).cast("string").alias("target"), nothing.alias("size"), nothing.alias("place"))
    s = files.where("doc_id % 101 = 0").select(F.lit(1).alias("part"), F.concat(F.lit("links/"), F.col("doc_id").cast("string")).alias("path"), F.lit("symlink").alias("kind"), F.concat(F.lit("../"), "path").alias("target"), nothing.alias("size"), nothing.alias("place"))
    f = file_order(files, BLOCK, rows).select(F.lit(2).alias("part"), "path", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("target"), "size", "place")
    every = d.unionByName(s).unionByName(f).withColumn("one", F.lit(1))
    out = running(every, [F.col("part"), F.col("place"), F.col("path")], {"entry_no": "one", "end": "size"}, None, rows)
    return out.select("entry_no", "path", "kind", "target", "size", F.when(F.col("kind") == "file", F.col("end") - F.col("size")).otherwise(0).cast("long").alias("content_offset"))


def unsafe(path: Column) -> Column:
    """Absolute, empty, or with a component that leaves the folder."""
    return path.startswith("/") | (path == "") | F.array_contains(F.split(path, "/"), "..")


def q_unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("page_id") % 6, F.col("page_id").cast("string")
    path = F.when(i == 0, F.concat(F.lit("/"), s)).when(i == 1, F.concat(F.lit("a/../"), s)).when(i == 2, F.concat(F.lit("ok/"), s)).when(i == 3, F.concat(s, F.lit("/.."))).when(i == 4, F.concat(F.lit("a/..b/"), s)).otherwise("")
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(unsafe(F.col("path")))


def q_scan_chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_chunks(document_files(spark, sf_dir), 4096)


def q_dir_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_blocks(document_files(spark, sf_dir), BLOCK, n_docs(spark, sf_dir))


def q_dir_block_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_blocks(document_files(spark, sf_dir), BLOCK, n_docs(spark, sf_dir)).agg(F.sum("blocks").alias("blocks"), F.count("*").alias("runs"))


def q_inflight_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks may be in flight, for some worker counts: by workers, by bytes, by the blocks there are; and restore shards."""
    # Bounds of blocks in flight, blocks a worker, bytes in flight, most shards.
    low, high, per_worker, max_bytes, shards = 64, 4096, 16, 1 << 24, 8
    total = run_blocks(document_files(spark, sf_dir), BLOCK, n_docs(spark, sf_dir)).agg(F.sum("blocks").alias("blocks"))
    w = total.withColumn("workers", F.explode(F.array(*[F.lit(x) for x in (1, 4, 16, 64, 1024)])))
    by_workers = F.least(F.greatest(F.col("workers") * per_worker, F.lit(low)), F.lit(high))
    by_bytes = F.lit(max(1, -(-max(max_bytes, BLOCK) // BLOCK)))
    limit = F.least(F.greatest(F.least(by_workers, by_bytes), F.lit(1)), F.greatest("blocks", F.lit(1)))
    return w.select("workers", limit.cast("long").alias("inflight_blocks"), F.least(F.greatest(F.ceil(F.col("workers") / 2), F.lit(1)), F.lit(shards)).cast("long").alias("auto_shards"))


def q_stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical streams: source folders numbered by first appearance in archive order."""
    files = file_order(document_files(spark, sf_dir), BLOCK, n_docs(spark, sf_dir))
    firsts = files.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("source")).agg(F.min("place").alias("first_place")).withColumn("one", F.lit(1))
    return running(firsts, [F.col("first_place")], {"stream_id": "one"}).select("source", "first_place", "stream_id")


def q_block_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path that a block's dictionary is chosen by: its first file's, or the root where extensions are mixed."""
    from corpusgrid.operators.selection import extents_of

    ext = F.coalesce(extension(F.col("path")), F.lit(""))
    by = extents_of(spark, sf_dir).groupBy("block_id").agg(F.count_distinct(ext).alias("exts"), F.min_by("path", "content_offset").alias("first_path"))
    return by.select("block_id", F.when(F.col("exts") == 1, F.col("first_path")).otherwise("documents").alias("source_path"))


def q_dict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether dictionaries are worth training: enough files, enough small ones; for single files, blocks that are small on average."""
    # Least files or blocks, largest small file.
    least, small = 8, 131_072
    files = document_files(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("source"))
    out = files.agg(F.count("*").alias("files"), F.count_if(F.col("size") <= small).alias("small_files"), F.expr("sum(size) div count(*)").alias("mean_bytes"))
    return out.withColumns({"dir_gate": (F.col("files") >= least) & (F.col("small_files") >= least), "file_gate": (F.col("files") >= least) & (F.col("mean_bytes") <= small)})


def seeded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with place, 1 to its rows, in an order that the seed draws: by digest of seed and key, ties by key. The same everywhere, on any
    number of tasks."""
    df = df.withColumns({"__d": F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))), "__one": F.lit(1)})
    return running(df, [F.col("__d"), F.col(key)], {"place": "__one"}).drop("__d", "__one")


def q_seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_order(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42)


def file_manifest(files: DataFrame) -> DataFrame:
    """The manifest of archives that hold one file each: its last path component, at offset 0."""
    return files.select(F.lit(1).cast("long").alias("entry_no"), F.regexp_extract("path", r"([^/]*)$", 1).alias("path"), F.lit("file").alias("kind"), "size", F.lit(0).cast("long").alias("content_offset"))


def q_file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_manifest(document_files(spark, sf_dir))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
