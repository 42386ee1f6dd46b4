"""Dedup of blocks, references between them, and statistics of a block layout."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.operators.planning import BLOCK, document_files, file_order, n_docs
from corpusgrid.operators.selection import encoded_blocks
from corpusgrid.plans.scale import running
from corpusgrid.sources.corpus import read


def canonical(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """df with target: the least order value of rows with the same key, null on that row itself. Nulls in a key are equal. A window of
    keys seen is FIFO and unbounded here: exact as long as it holds all distinct keys. Keys are grouped map-side first, so a hot key is
    no one task's rows."""
    firsts = df.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min(order).alias("first_id"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    out = df.join(firsts, same).drop(*[f"__{k}" for k in key])
    return out.withColumn("target", F.when(F.col("first_id") != F.col(order), F.col("first_id"))).drop("first_id")


def sized(text: str = "text") -> list[Column]:
    """A text's bytes and their digest; null as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.octet_length(t).cast("long").alias("size"), F.sha2(t, 256).alias("digest")]


def q_raw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks: later equal ones refer to the first, by length and digest. A null text is an empty one."""
    d = read(spark, sf_dir, "documents").select("doc_id", *sized())
    return canonical(d, ["size", "digest"], "doc_id").select("doc_id", "size", "digest", "target")


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as encoded blocks: a key of flags, dictionary, lengths and payload digest. A null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select(
        "doc_id", (F.length("lang") % 3 + 1).cast("int").alias("flags"), (F.col("doc_id") % 17 == 0).alias("raw"), F.when(F.col("lang") == "en", 1).otherwise(0).alias("dictionary_id"),
        F.octet_length(text).cast("long").alias("raw_len"), F.least(F.octet_length(text), F.lit(4096)).cast("long").alias("encoded_len"), F.sha2(text, 256).alias("digest"))


def q_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = canonical(doc_blocks(spark, sf_dir), ["flags", "raw", "dictionary_id", "raw_len", "encoded_len", "digest"], "doc_id")
    return out.select("doc_id", "raw_len", "encoded_len", "target")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that refer to the block before them, in runs of up to four."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") - 1).alias("target"))


def resolve(refs: DataFrame, hops: int = 30) -> DataFrame:
    """id, data_id: the block at the end of each chain of references. Pointers double each round, so hops rounds follow chains of up
    to 2**hops; rounds end when none moves. A target that doesn't exist stays unresolved."""
    state = refs.select("id", F.coalesce("target", "id").alias("data_id"))
    for _ in range(hops):
        nxt = state.select(F.col("id").alias("data_id"), F.col("data_id").alias("far"))
        moved = state.join(nxt, "data_id", "left").select("id", F.coalesce("far", "data_id").alias("new"), "data_id")
        from corpusgrid.plans.scale import checkpointed

        moved = checkpointed(moved)
        state = moved.select("id", F.col("new").alias("data_id"))
        if not moved.where("new <> data_id").limit(1).count():
            break
    return state


def q_ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(chains(spark, sf_dir))


def q_ref_fanin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references each referred-to document has, after dedup."""
    return q_raw_dedup(spark, sf_dir).where("target is not null").groupBy("target").agg(F.count("*").alias("refs"), F.sum("size").alias("saved_bytes"))


def q_dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal payloads, per language: how many, how many copies too many, their bytes."""
    d = read(spark, sf_dir, "documents").groupBy("lang", *sized()).count()
    return d.where("count > 1").groupBy("lang").agg(F.count("*").alias("groups"), F.sum(F.col("count") - 1).alias("extra"), F.sum((F.col("count") - 1) * F.col("size")).alias("extra_bytes"))


def q_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per algorithm: blocks, bytes, ratio, raw, near-raw and referring ones."""
    b = encoded_blocks(spark, sf_dir)
    near = ~F.col("raw_passthrough") & F.col("reference_target").isNull() & (F.col("encoded_len") / F.col("raw_len") >= 0.98)
    return b.groupBy("algo").agg(F.count("*").alias("blocks"), F.sum("raw_len").alias("raw_bytes"), F.sum("encoded_len").alias("encoded_bytes"), F.round(F.sum("encoded_len") / F.sum("raw_len"), 6).alias("ratio"), F.count_if("raw_passthrough").alias("raw_blocks"), F.count_if(near).alias("near_raw_blocks"), F.count("reference_target").alias("references"))


def q_chunk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive blocks with equal descriptors, as runs."""
    same = F.concat_ws("|", "force_raw", F.col("raw_passthrough").cast("string"), F.col("reference_target").isNotNull().cast("string"), (F.col("raw_len") == BLOCK).cast("string"))
    b = encoded_blocks(spark, sf_dir).withColumn("sig", same)
    b = running(b, [F.col("block_id")], {}, {"sig_before": "sig"}).withColumn("opens", F.when(F.col("sig").eqNullSafe(F.col("sig_before")), 0).otherwise(1))
    b = running(b, [F.col("block_id")], {"run_no": "opens"})
    return b.groupBy("run_no", "sig").agg(F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"), F.count("*").alias("blocks"), F.sum("encoded_len").alias("encoded_bytes"))


def q_head_tail(spark: SparkSession, sf_dir: str, n: int = 12) -> DataFrame:
    """The first and last n/2 blocks, and how many are between."""
    b = encoded_blocks(spark, sf_dir).select("block_id", "raw_offset", "raw_len", "algo")
    count = b.agg(F.count("*").alias("n"))
    head = b.orderBy("block_id").limit(n // 2).withColumn("part", F.lit("head"))
    tail = b.orderBy(F.desc("block_id")).limit(n // 2).withColumn("part", F.lit("tail"))
    both = head.unionByName(tail)
    return both.join(F.broadcast(count)).select("part", "block_id", "raw_offset", "raw_len", "algo", F.greatest(F.col("n") - n, F.lit(0)).alias("omitted"))


def q_manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source folder: files, raw files, bytes, path bytes, and the bytes of sizes as varints."""
    bytes_of = F.when(F.col("size") < 128, 1).when(F.col("size") < 16_384, 2).when(F.col("size") < 2_097_152, 3).when(F.col("size") < 268_435_456, 4).otherwise(5)
    files = document_files(spark, sf_dir)
    return files.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("source")).agg(F.count("*").alias("files"), F.count_if("force_raw").alias("raw_files"), F.sum("size").alias("payload_bytes"), F.sum(F.octet_length("path")).cast("long").alias("path_bytes"), F.sum(bytes_of).cast("long").alias("size_bytes"))


def layout_violations(blocks: DataFrame) -> DataFrame:
    """(block_id, violation): gaps and overlaps with the block before, empty blocks, references that don't point back to data,
    raw blocks of another length, encoded blocks that aren't smaller."""
    b = running(blocks.withColumn("stop", F.col("raw_offset") + F.col("raw_len")), [F.col("block_id")], {}, {"before": "stop"})
    data = blocks.where("reference_target is null").select(F.col("block_id").alias("t_id"), F.col("raw_len").alias("t_len"))
    b = b.join(data, b["reference_target"] == data["t_id"], "left")
    ref, tests = F.col("reference_target").isNotNull(), {}
    tests["gap"] = F.col("raw_offset") > F.coalesce("before", F.lit(0))
    tests["overlap"] = F.col("raw_offset") < F.coalesce("before", F.lit(0))
    tests["empty"] = F.col("raw_len") <= 0
    tests["bad_reference"] = ref & (F.col("t_id").isNull() | (F.col("t_id") >= F.col("block_id")))
    tests["reference_length"] = ref & (F.col("t_len") != F.col("raw_len"))
    tests["raw_length"] = F.col("raw_passthrough") & (F.col("encoded_len") != F.col("raw_len"))
    tests["not_smaller"] = ~F.col("raw_passthrough") & ~ref & (F.col("encoded_len") >= F.col("raw_len"))
    return b.select("block_id", F.explode(F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())).alias("violation"))


def q_layout_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a layout with planted faults: every 13th block is moved, every 19th emptied."""
    b = encoded_blocks(spark, sf_dir)
    i = F.col("block_id")
    b = b.withColumns({"raw_offset": F.when(i % 13 == 5, F.col("raw_offset") + 7).otherwise(F.col("raw_offset")), "raw_len": F.when(i % 19 == 8, 0).otherwise(F.col("raw_len"))})
    return layout_violations(b)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Values of key, null among them, that more than one row has, and how many have them: of dictionaries, or of results, an error."""
    return df.groupBy(key).count().where("count > 1").withColumnRenamed("count", "rows")


def q_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result numbers of blocks, with planted faults: every 17th has the number of the one before."""
    i = F.col("doc_id")
    return duplicate_ids(read(spark, sf_dir, "documents").select(F.when(i % 17 == 3, i - 1).otherwise(i).alias("index")), "index")


def q_dict_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose dictionary (by id and algorithm) isn't in the bank."""
    bank = spark.createDataFrame([(1, 1), (1, 3), (2, 3)], "dictionary_id int, flags int")
    blocks = doc_blocks(spark, sf_dir).withColumn("dictionary_id", (F.col("doc_id") % 4).cast("int")).where("dictionary_id > 0")
    return blocks.join(F.broadcast(bank), ["dictionary_id", "flags"], "left_anti").select("doc_id", "dictionary_id", "flags")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
