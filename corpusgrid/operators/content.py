"""Content: entropy, sampling, classification, signatures, and the ranking and choice of dictionaries."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrid.functions.bytes import SAMPLE, distance, entropy, profile, profiles, sample
from corpusgrid.plans.scale import checkpointed
from corpusgrid.sources.corpus import read

# Least bytes and entropy of an incompressible sample; windows of an input; caps of a class; kept dictionaries.
ENTROPY_BYTES, INCOMPRESSIBLE, WINDOWS, MAX_SAMPLES, MAX_BYTES, MAX_DICTIONARIES = 512, 7.5, 8, 512, 8 << 20, 255
#: Windows of a sample are shorter here, so that the texts at hand have several.
WINDOW = 1024


def sampled(spark: SparkSession, sf_dir: str, n: int = SAMPLE) -> DataFrame:
    """doc_id, lang, source, size and the first n bytes of each document; only they leave the JVM. Null is empty."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.coalesce(sample("text", n), F.lit(b"")).alias("sample"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, size, ext, class and signature of each document, from one pass over the samples."""
    ext = F.when(F.col("doc_id") % 17 == 0, "gz").otherwise("txt")
    p = sampled(spark, sf_dir).withColumn("p", profile("sample"))
    return p.select("doc_id", "lang", "source", "size", ext.alias("ext"), "p.class", "p.signature")


def q_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sampled(spark, sf_dir, 4096).withColumn("e", entropy("sample"))
    return p.select("doc_id", F.round("e", 6).alias("entropy"), ((F.col("size") >= ENTROPY_BYTES) & (F.col("e") > INCOMPRESSIBLE)).alias("incompressible"))


def q_probe_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a compression probe of 1 KiB windows looks: the start, and in long sources the middle and the end."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    last = F.greatest(F.col("size") - WINDOW, F.lit(0))
    at = F.when(F.col("size") >= 2 * WINDOW, F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(last / 2), last))).otherwise(F.array(F.lit(0).cast("long")))
    return d.select("doc_id", F.posexplode(at).alias("probe_no", "probe_offset"))


def window_offsets(size: Column, window: int = WINDOW, most: int = WINDOWS) -> Column:
    """Offsets of up to `most` sample windows: 0, strides, and always the last possible one."""
    last = F.greatest(size - window, F.lit(0).cast("long"))
    stride = F.greatest(F.floor(last / (most - 1)), F.lit(window).cast("long"))
    inner = F.filter(F.transform(F.sequence(F.lit(1).cast("long"), F.lit(most - 2).cast("long")), lambda i: i * stride), lambda x: x < last)
    zero = F.array(F.lit(0).cast("long"))
    return F.when(size == 0, F.array().cast("array<bigint>")).when(last == 0, zero).otherwise(F.concat(zero, inner, F.array(last)))


def q_sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return d.select("doc_id", F.posexplode(window_offsets(F.col("size"))).alias("window_no", "window_offset"))


def q_classify_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("doc_id", "ext", "class")


def q_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bucket that isn't 0."""
    return classified(spark, sf_dir).select("doc_id", F.posexplode("signature").alias("bucket", "weight")).where("weight > 0")


def averages(docs: DataFrame, key: list[str]) -> DataFrame:
    """The integer mean signature of each group. Buckets are summed map-side; a group's rows are never gathered."""
    sums = [F.sum(F.get("signature", F.lit(i))).alias(f"s{i}") for i in range(16)]
    out = docs.groupBy(*key).agg(F.count("*").alias("samples"), F.sum("size").alias("sample_bytes"), *sums)
    return out.select(*key, "samples", "sample_bytes", F.array(*[F.expr(f"cast(s{i} div samples as int)") for i in range(16)]).alias("signature"))


def q_avg_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averages(classified(spark, sf_dir), ["lang"]).select("lang", "samples", "sample_bytes", F.posexplode("signature").alias("bucket", "weight"))


def q_sig_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's distance from its language's mean signature."""
    docs = checkpointed(classified(spark, sf_dir))  # metadata, read twice
    mean = averages(docs, ["lang"]).select(F.col("lang").alias("l"), F.col("signature").alias("mean"))
    return docs.join(mean, F.col("lang").eqNullSafe(F.col("l"))).select("doc_id", distance(F.col("signature"), F.col("mean")).alias("distance"))


def q_sample_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 512 samples of a language, as long as those before are less than a cap of bytes. The row number bounds what a task
    sorts: each task prunes to 512 rows a language before the shuffle."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    w = Window.partitionBy("lang").orderBy("doc_id")
    d = d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MAX_SAMPLES)
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("before", before).where(F.col("before") < MAX_BYTES // 64).select("lang", "doc_id", "size", "before")


def bank(docs: DataFrame) -> DataFrame:
    """Dictionary candidates of classified documents by extension and by class and language, ranked: id, class, samples, bytes, signature."""
    by_ext = averages(docs.withColumn("kind", F.concat(F.lit("Extension:"), "ext")), ["kind"])
    by_class = averages(docs.select(F.col("class").alias("kind"), "lang", "size", "signature"), ["kind", "lang"]).drop("lang")
    every = by_ext.unionByName(by_class).where("samples >= 8")
    top = every.orderBy(F.desc("sample_bytes"), F.desc("samples"), "kind", "signature").limit(MAX_DICTIONARIES)
    w = Window.orderBy(F.desc("sample_bytes"), F.desc("samples"), "kind", "signature")  # 255 rows at most
    return top.withColumn("id", F.row_number().over(w))


def q_dict_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(checkpointed(classified(spark, sf_dir))).select("id", "kind", "samples", "sample_bytes", F.concat_ws(",", F.col("signature").cast("array<string>")).alias("signature"))


def q_dict_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary that suits each document best: its extension's before its class's, less the distance; ties by samples, bytes, id."""
    docs = checkpointed(classified(spark, sf_dir))  # metadata, read by each branch
    b = F.broadcast(bank(docs).select("id", "kind", "samples", "sample_bytes", F.col("signature").alias("mean")))  # 255 rows at most
    kinds = docs.withColumn("kind", F.explode(F.array(F.concat(F.lit("Extension:"), "ext"), F.col("class"))))
    score = F.when(F.col("kind").startswith("Extension:"), 20_000).otherwise(10_000) - distance(F.col("signature"), F.col("mean"))
    hit = kinds.join(b, "kind").withColumn("score", score)
    best = hit.groupBy("doc_id").agg(F.max(F.struct("score", "samples", "sample_bytes", "id")).alias("b"))
    return best.select("doc_id", F.col("b.id").alias("dictionary_id"), F.col("b.score").alias("score"))


#: Bytes of a trained dictionary.
DICTIONARY_BYTES = 4096


def train(samples: DataFrame) -> DataFrame:
    """samples (kind, doc_id, sample): a zstd dictionary of each kind's first 512 samples, fewer than 8 give none; kind, samples,
    sample_bytes, signature (16 bytes, the integer mean of the samples'), dictionary, and the bytes of the samples compressed each alone
    and with the dictionary. A group has at most 512 samples, which tasks pick before the shuffle."""
    w = Window.partitionBy("kind").orderBy("doc_id")
    picked = samples.where(F.length("sample") > 0).withColumn("n", F.row_number().over(w)).where(F.col("n") <= MAX_SAMPLES).drop("n")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        data = [bytes(b) for b in rows.sort_values("doc_id")["sample"]]
        if len(data) < 8:
            return pd.DataFrame({c: [] for c in names})
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, data)
        size = lambda **more: sum(len(zstandard.ZstdCompressor(level=3, **more).compress(b)) for b in data)
        signature = bytes((profiles(data)[1].sum(axis=0) // len(data)).tolist())
        return pd.DataFrame([(rows["kind"].iloc[0], len(data), sum(map(len, data)), signature, trained.as_bytes(), size(), size(dict_data=trained))], columns=names)

    names = ["kind", "samples", "sample_bytes", "signature", "dictionary", "alone", "with_dictionary"]
    return picked.groupBy("kind").applyInPandas(run, "kind string, samples long, sample_bytes long, signature binary, dictionary binary, alone long, with_dictionary long")


def train_bank(files: DataFrame) -> DataFrame:
    """files (path, data): dictionaries by extension and by class of content, from the beginnings of files, ranked by bytes and number of
    samples; id (from 1), kind, samples, sample_bytes, signature, dictionary; 255 at most."""
    from corpusgrid.operators.planning import extension

    s = files.select("path", F.substring("data", 1, WINDOW).alias("sample")).withColumn("p", profile("sample"))
    kinds = F.array_compact(F.array(F.concat(F.lit("Extension:"), extension(F.col("path"))), F.col("p.class")))
    t = checkpointed(train(s.select(F.explode(kinds).alias("kind"), F.col("path").alias("doc_id"), "sample")))
    order = [F.desc("sample_bytes"), F.desc("samples"), F.col("kind"), F.col("signature")]
    top = t.orderBy(*order).limit(MAX_DICTIONARIES)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("id"), "kind", "samples", "sample_bytes", "signature", "dictionary")  # 255 rows at most


def q_dict_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary for each language's documents, from the first KiB of each, and what it saves."""
    d = sampled(spark, sf_dir, WINDOW).select(F.coalesce("lang", F.lit("none")).alias("kind"), "doc_id", "sample")
    return train(d).select("kind", "samples", F.length("dictionary").alias("dict_bytes"), "alone", "with_dictionary")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
