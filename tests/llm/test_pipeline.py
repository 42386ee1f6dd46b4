"""The pipeline's stages, each against what it must do to its own input."""

from __future__ import annotations

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusgrid.llm import langid
from corpusgrid.llm.bpe import default_tokenizer
from tests.llm.test_models import plain_classes
from tests.llm.test_native import plain_lines


@pytest.fixture(scope="module")
def stages(spark, small_dir):
    """(documents before, after) of each stage."""
    docs, out = spark.read.parquet(f"{small_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, small_dir).cache()
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


def test_columns_stay(stages, spark, small_dir):
    names = spark.read.parquet(f"{small_dir}/documents.parquet").columns
    assert len(stages) == 5 and all(after.columns == names for name, (_, after) in stages.items() if name != "bpe")


def test_language_id_keeps_what_it_knows(stages):
    before, after = map(rows, stages["language_id"])
    model = langid.train(stages["language_id"][0])
    rejected = langid.predict(model, [r["text"] for r in before])[2]
    assert [r for r, x in zip(before, rejected) if not x] == after and len(after) > 0.97 * len(before)


def test_line_dedup(stages):
    before, after = map(rows, stages["line_dedup"])
    assert [r["text"] for r in after] == [t for _, t in plain_lines([r["text"] for r in before], 10)]
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_one_document_of_each_class_stays(stages):
    before, after = map(rows, stages["near_dedup"])
    some = [r for r in before if r["text"].split()]
    want = {c[0] for c in plain_classes([(r["doc_id"], r["text"]) for r in some])}
    assert {r["doc_id"] for r in after if r["text"].split()} == want
    assert [r for r in before if r["doc_id"] in {x["doc_id"] for x in after}] == after


def test_mixing_keeps_all(stages):
    before, after = map(rows, stages["mixing"])
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    assert all(r in before for r in after)


def test_ids(stages):
    before, after = map(rows, stages["bpe"])
    library = Tokenizer.from_file(default_tokenizer())
    assert sorted((r["doc_id"], r["ids"]) for r in after) == sorted((r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in before)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in after)


def test_run_is_all_stages(stages, spark, small_dir):
    got = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, small_dir).collect())
    assert got == sorted((r["doc_id"], r["n_tokens"]) for r in stages["bpe"][1].collect())
