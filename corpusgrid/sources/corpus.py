"""The corpus as files: documents, pages and conversations as paths with sizes and content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.sources.container import open_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> Column:
    suffix = F.when(F.col("doc_id") % 17 == 0, ".gz").otherwise(".txt")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return F.concat(F.lit("documents/"), known("source"), F.lit("/"), known("lang"), F.lit("/"), known("doc_id"), suffix)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, size and force_raw of all documents; a null text is an empty file, a null part of its path is "none". Content stays
    in the scan: only its length is read."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", document_path().alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.coalesce(F.col("doc_id") % 17 == 0, F.lit(False)).alias("force_raw"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and size of all files: documents, pages as HTML, conversations as JSON lines of their turns."""
    docs = read(spark, sf_dir, "documents").select(document_path().alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"))
    turns = turns.select(F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), "size")
    return docs.unionByName(pages).unionByName(turns)


def scan_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path (below the root), size, mtime and, if asked for, content of the files below a folder, empty and hidden ones included. Without
    content none is read. The driver lists two levels; the folders below them are listed, and files read, by tasks."""
    top = [(x.path, x.type == pafs.FileType.Directory) for x in listed(root, False)]
    second = [(x.path, x.type == pafs.FileType.Directory) for p, d in top if d for x in listed(root, False, p)]
    start = len(open_path(root)[1].rstrip("/")) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = open_path(root)[0]
        for batch in batches:
            for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist()):
                for x in listed(root, True, path) if folder else fs.get_file_info([path]):
                    if x.type == pafs.FileType.File:
                        data = fs.open_input_file(x.path).read() if content else None
                        yield pa.RecordBatch.from_pylist([{"path": x.path[start:], "size": x.size, "mtime": x.mtime, "content": data}], rows)

    rows = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("content", pa.binary())])
    entries = [x for x in top if not x[1]] + second
    found = spark.createDataFrame(entries, "path string, folder boolean").repartition(max(1, min(len(entries), 10_000)), "path")
    found = found.mapInArrow(run, "path string, size long, mtime timestamp, content binary")
    return found if content else found.drop("content")


def listed(root: str, recursive: bool, path: str | None = None) -> list[pafs.FileInfo]:
    fs, top = open_path(root)
    return fs.get_file_info(pafs.FileSelector(path or top, recursive=recursive))
