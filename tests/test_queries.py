"""Every query of the engine runs, and agrees with its SQL where there is one."""

from __future__ import annotations

import pytest

from corpusgrid import catalog
from tests.compare import oracle_rows, rows_of

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    got = rows_of(df)
    if name in SQL:
        names, want = oracle_rows(small_dir, SQL[name])
        assert sorted(df.columns) == names
        assert got == want


#: Queries that order all rows, which beyond a number of rows go over ranges of the order.
ORDERED = ["manifest", "dir_blocks", "extents", "project_ranges", "chunk_runs", "layout_violations", "manifest_prefix", "seeded_shuffle", "stream_ids", "archive_violations"]


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_queries_over_ranges(spark, small_dir, monkeypatch, name):
    from corpusgrid.plans import scale

    monkeypatch.setattr(scale, "ONE_TASK_ROWS", -1)
    assert rows_of(QUERIES[name](spark, small_dir)) == oracle_rows(small_dir, SQL[name])[1]


def test_entry_is_the_smallest_end_to_end_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


#: Queries whose result depends on null and empty texts, and on null parts of paths.
NULLABLE = [
    "raw_dedup", "block_dedup", "ref_fanin", "dup_report", "corpus_files", "file_order", "manifest", "manifest_stats", "manifest_prefix", "dict_gate", "dir_blocks", "extents", "prune_blocks",
    "project_ranges", "file_cost", "implicit_dirs", "tree_diff", "select_union", "scan_chunks_fixed", "archive_files", "first_copies_stream", "entropy", "signatures", "dict_select", "rs_protect", "rs_repair", "restore_tree", "corrupt_blocks", "archive_violations", "archive_cost", "archive_encrypted", "archive_dictionaries",
]


@pytest.mark.parametrize("name", NULLABLE)
def test_nulls_and_empty_texts_are_in_the_result(spark, null_dir, name):
    names, want = oracle_rows(null_dir, SQL[name])
    assert rows_of(QUERIES[name](spark, null_dir)) == want
