from __future__ import annotations

import pytest

#: Texts that operators must take: null, empty, white space alone, no letter, ties, repeated rows, odd code points, and a long one.
ODD_TEXTS = [None, "", " ", "\n\n", "  \t x \r\n", "12 34!?", "The same line\nand another", "The same line\nand another", "É é É ß İ ﬁ", "日本語 テキスト", "a\x00b \x1f c\x0b", "x<|endoftext|>y", "word " * 30_000, "z" * 5000]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD_TEXTS with a null id, a repeated row, and columns whose names operators might use."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", i, "own") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id", "en", "s1", 0, "own"), rows[6], rows[6]]
    names = "doc_id long, text string, lang string, source string, n_chars long, {} string"
    return lambda extra="extra": spark.createDataFrame(rows, names.format(extra))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def texts():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    return sorted(t, key=lambda r: r["doc_id"])
