"""A corpus pipeline of five stages, each a training-data operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.llm.bpe import default_tokenizer, encode_decode
from corpusgrid.llm.common import documents, table
from corpusgrid.llm.langid import identify, train
from corpusgrid.llm.lines import drop_common_lines
from corpusgrid.llm.mixing import mix
from corpusgrid.llm.neardup import drop_near_copies


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject: they have a letter, and some language accepts their cross-entropy."""
    return identify(docs, train(docs)).where("not rejected").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least 10 documents share; n_chars is that of the text that is left."""
    rows = drop_common_lines(docs, out="kept", by_key=True).withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")})
    return rows.select(*docs.columns)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id."""
    return drop_near_copies(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of rarer sources up to twice, at the tempered weights; ordered as the blocks' permutations have it."""
    return mix(docs).sortWithinPartitions("epoch", "block", "place").select(*docs.columns)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, their number, and whether they decode to the text."""
    # the executors' heaps have grown in the stages before, so that workers hold less than they do for the operator alone
    rows = encode_decode(docs, default_tokenizer(), pieces=150_000, part=1 << 20)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_near_copy),
    ("mixing", mix_sources),
    ("bpe", encode_documents),
]

#: Stages 1, 3 and 5 have no SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, name)
    return docs
