from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def null_dir(tmp_path_factory):
    """The smallest tables, with nulls in every column of documents but the id, empty texts and repeats of them."""
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("nulls")
    for path in Path(f"{DATA}/sf0.001").iterdir():
        table = pq.read_table(path)
        if path.name == "documents.parquet":
            rows = table.to_pylist()
            for r in rows:
                i = r["doc_id"]
                r["text"] = None if i % 11 == 3 else "" if i % 13 == 4 else r["text"]
                r["lang"], r["source"] = None if i % 7 == 2 else r["lang"], None if i % 9 == 5 else r["source"]
            table = type(table).from_pylist(rows, table.schema)
        pq.write_table(table, folder / path.name)
    return str(folder)
