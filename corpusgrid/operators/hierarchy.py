"""Hierarchy: rollups over path prefixes, listings, labels of modes and times, and comparison of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.operators.dedup import sized
from corpusgrid.operators.planning import document_files, n_docs
from corpusgrid.plans.scale import running
from corpusgrid.sources.corpus import corpus_files, read


def prefixes(path: Column) -> Column:
    """All ancestors of a path and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def rollup_tree(files: DataFrame) -> DataFrame:
    """Each node of the tree: path, depth, is_dir, files below (or itself) and their bytes. Sizes are summed map-side before the shuffle."""
    n = F.size(F.split("path", "/"))
    nodes = files.select("size", F.posexplode(prefixes(F.col("path"))).alias("i", "node"), n.alias("n"))
    out = nodes.groupBy("node").agg((F.max("i") + 1).alias("depth"), F.max(F.col("i") + 1 < F.col("n")).alias("is_dir"), F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return out.withColumnRenamed("node", "path")


def q_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_tree(corpus_files(spark, sf_dir))


def q_tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rollup_tree(corpus_files(spark, sf_dir))
    return t.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("directories"), F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("bytes"))), F.lit(0)).alias("payload_bytes"), F.max("depth").alias("deepest"))


def q_tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its parent, name and place among its siblings: directories first, then by name."""
    from pyspark.sql import Window

    t = rollup_tree(corpus_files(spark, sf_dir))
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.when(F.col("depth") > 1, F.expr("left(path, length(path) - length(element_at(split(path, '/'), -1)) - 1)")).otherwise("")
    t = t.select("path", "is_dir", "bytes", name.alias("name"), parent.alias("parent"))
    w = Window.partitionBy("parent").orderBy(~F.col("is_dir"), "name")
    return t.withColumn("place", F.row_number().over(w))


def q_implicit_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that files imply and that have no entry of their own; of the language folders only de's do."""
    files = document_files(spark, sf_dir)
    explicit = files.where("path like '%/de/%'").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).distinct()
    implied = files.select(F.explode(F.slice(prefixes(F.col("path")), 1, F.size(F.split("path", "/")) - 1)).alias("dir")).distinct()
    return implied.join(explicit, "dir", "left_anti").select("dir", F.lit("d---------").alias("mode"), F.lit("unknown time").alias("mtime"))


def q_depth_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_files(spark, sf_dir).groupBy(F.size(F.split("path", "/")).alias("depth")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def mode_label(kind: Column, mode: Column) -> Column:
    """drwxr-xr-x from kind and permission bits."""
    bits = [F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(F.when(kind == "directory", "d").when(kind == "symlink", "l").otherwise("-"), *bits)


def q_mode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "directory").when(F.col("doc_id") % 3 == 1, "symlink").otherwise("file").alias("kind"), (F.col("doc_id") * 37 % 512).cast("int").alias("mode"))
    return d.select("doc_id", mode_label(F.col("kind"), F.col("mode")).alias("label"))


def time_label(seconds: Column, nanos: Column) -> Column:
    """UTC civil time of floor seconds, with nine digits of nanoseconds if there are any. The session's zone must be UTC. A year has four
    digits, or as many as it needs and no sign before those after 9999."""
    at = F.timestamp_seconds(seconds)
    year = F.year(at)
    day = F.concat(F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string")), F.date_format(at, "-MM-dd HH:mm:ss"))
    return F.when(nanos == 0, day).otherwise(F.concat_ws(".", day, F.lpad(nanos.cast("string"), 9, "0")))


def q_mtime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") - 500) * 1_234_567).alias("s"), F.when(F.col("doc_id") % 2 == 0, 0).otherwise(F.col("doc_id") * 7919 % 1_000_000_000).cast("long").alias("ns"))
    return d.select("doc_id", time_label(F.col("s"), F.col("ns")).alias("label"))


def q_manifest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, the bytes of paths coded as the length of the prefix that they share with the path before, and the rest."""
    files = document_files(spark, sf_dir).select("path")
    files = running(files, [F.col("path")], {}, {"prev": "path"}, n_docs(spark, sf_dir)).withColumn("prev", F.coalesce("prev", F.lit("")))
    n = F.least(F.length("path"), F.length("prev"))
    common = F.expr("coalesce(array_min(filter(sequence(1, greatest(1, least(length(path), length(prev)))), i -> substring(path, i, 1) <> substring(prev, i, 1))) - 1, least(length(path), length(prev)))")
    files = files.withColumn("common", F.when(n == 0, 0).otherwise(common))
    coded = F.when(F.col("common") < 128, 1).otherwise(2) + 1 + F.length("path") - F.col("common")
    return files.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("source")).agg(F.count("*").alias("paths"), F.sum("common").cast("long").alias("shared_bytes"), F.sum(coded).cast("long").alias("coded_bytes"))


def tree_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path and status of what differs: missing, extra, size or content."""
    e = expected.select("path", F.col("size").alias("e_size"), F.col("digest").alias("e_digest"))
    a = actual.select("path", F.col("size").alias("a_size"), F.col("digest").alias("a_digest"))
    status = F.when(F.col("a_size").isNull(), "missing").when(F.col("e_size").isNull(), "extra").when(F.col("e_size") != F.col("a_size"), "size").when(F.col("e_digest") != F.col("a_digest"), "content")
    return e.join(a, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def q_tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus against a restore of it with planted faults."""
    docs = read(spark, sf_dir, "documents").select("doc_id", *sized())
    i = F.col("doc_id")
    expected = docs.select(i.cast("string").alias("path"), "size", "digest")
    name = F.when(i % 50 == 7, F.concat(F.lit("new/"), i.cast("string"))).otherwise(i.cast("string"))
    actual = docs.where(i % 40 != 3).select(name.alias("path"), F.when(i % 30 == 4, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(i % 35 == 6, "0").otherwise(F.col("digest")).alias("digest"))
    return tree_diff(expected, actual)


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
