"""BPE and token files against the tokenizers library, Simple-8b round trips, odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusgrid.llm import bpe, registry, tokenfiles
from corpusgrid.llm.common import scratch

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
SPACED = ["", " ", "  ", "a  b   c\n\n  d \t e ", "don't I'll we've 'S", "x<|endoftext|>y <|endoftext|>", "日本語 テキスト　 é  b", "a\x1fb \x1c c", "\r\n\r\n", "z" * 900 + " " + "ab" * 300, "1234 567,89 ... !!!", "é" * 50, "👩‍👩‍👧 ok", "tab\tx\n y  z", "\x00 \x00a", "end "]


def ids_of(texts):
    return [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("cache", [bpe.loaded(PATH)[1], tokenfiles.library_encoder(PATH)])
def test_encoders_equal_the_library(cache, texts):
    rows = [*SPACED, None, *[r["text"] for r in texts]]
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() for x in cache.encode(pa.array(rows, pa.string()))] == ids_of(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAeéthE  \n\t.,'s1!<|>ß日\x1f\x00 "), max_size=40), max_size=5))
def test_any_text(rows):
    model, cache = bpe.loaded(PATH)
    got = cache.encode(pa.array(rows, pa.string()))
    assert [x.tolist() for x in got] == ids_of(rows)
    assert model.decode(got) == rows
    assert [x.tolist() for x in tokenfiles.library_encoder(PATH).encode(pa.array(rows, pa.string()))] == ids_of(rows)


def test_generations_of_the_cache(texts):
    model = bpe.TrieBPE(PATH)
    cache = bpe.PieceCache(model.encode_first, model.encode_spaced, model.encode_whole, list(model.special), 50)
    rows = [r["text"] for r in texts[:40]]
    for t in rows * 2:
        assert [x.tolist() for x in cache.encode(pa.array([t], pa.string()))] == ids_of([t])


def test_compatible_is_what_merging_says():
    model, r = bpe.loaded(PATH)[0], random.Random(1)
    names = {i: t for t, i in model.vocab.items()}
    short = [i for t, i in model.vocab.items() if len(t) <= 4]
    every = list(model.vocab.values())
    for k in range(4000):
        a, b = r.choice(short), r.choice(every if k % 2 else short)
        assert model.compatible(a, b) == (model.merge(names[a] + names[b]) == [names[a], names[b]])


def test_words_share_prefixes_and_equal_plain_merging():
    model = bpe.TrieBPE(PATH)
    words = ["the", "then", "thenb", "Ġthe", "Ġtheme", "t", "aaaaaaaaaaaa", "ab" * 150]
    got = model.words(words)
    for w in words:
        assert np.frombuffer(got[w], "<i4").tolist() == [model.vocab[x] for x in model.merge(w)]


def test_bytes_that_are_no_text_decode_with_replacement():
    model = bpe.loaded(PATH)[0]
    ids = ids_of(["日本"])[0][:1]
    assert model.decode([np.array(ids), np.array([], int)]) == [LIBRARY.decode(ids), ""]


def test_op9(spark, small_dir, texts):
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_bpe"](spark, small_dir).collect()}
    for r, ids in zip(texts, ids_of([r["text"] for r in texts])):
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, empty):
    df = odd("ids")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r["text"] or "", tuple(r["ids"]), r["decoded"]) for r in rows) == sorted((r["text"] or "", tuple(ids_of([r["text"]])[0]), r["text"] or "") for r in df.collect())
    assert bpe.encode_decode(empty, PATH).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 5000), st.integers(0, (1 << 60) - 1)), max_size=700))
def test_simple8b(values):
    v = np.array(values, np.int64)
    assert tokenfiles.unpack(tokenfiles.pack(v))[: len(v)].tolist() == values


@pytest.mark.parametrize("n", [240, 241, 500])
def test_runs_of_zeros_take_a_word_for_240(n):
    words = tokenfiles.pack(np.zeros(n, np.int64))
    assert len(words) <= -(-n // 240) + 10 and not tokenfiles.unpack(words)[:n].any()


def test_escapes():
    r = np.random.default_rng(0)
    for ids in (r.integers(0, 50_000, 60_000), r.integers(0, 1 << 32, 5000), np.array([7])):
        ids = ids.astype(np.uint32)
        data = tokenfiles.pack_block(ids)
        assert (tokenfiles.unpack_block(data) == ids).all()


def test_documents_across_blocks(tmp_path):
    r, totals = np.random.default_rng(1), {}
    docs = [(None if i == 0 else i, r.integers(0, 50_257, n).astype(np.uint32)) for i, n in enumerate([3, 0, 250, 1, 99, 100, 700])]
    uri = f"file://{tmp_path}/x/ids.s8b"
    tokenfiles.write_once(uri, tokenfiles.file_chunks(iter(docs), totals, 100))
    back = list(tokenfiles.read_file(uri))
    assert [k for k, _ in back] == [k for k, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(back, docs))
    assert totals == {"n_docs": 7, "n_ids": 1153, "n_blocks": 12}
    for step in (1, 2, 5):  # from any block on, each document once
        parts = [x for first in range(0, 12, step) for x in tokenfiles.read_range(uri, first, first + step)]
        assert [k for k, _, _ in parts] == [k for k, _ in docs] and all((a == b).all() for (_, _, a), (_, b) in zip(parts, docs))
        assert [s for _, s, _ in parts] == [0, 3, 3, 253, 254, 353, 453]


def test_op5(spark, small_dir, texts):
    got = registry.QUERIES["op5_token_files"](spark, small_dir).orderBy("doc_id").collect()
    start = 0
    for g, r, ids in zip(got, texts, ids_of([r["text"] for r in texts]), strict=True):
        ids = [*ids, 0]
        assert tuple(g[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_of_odd_rows(odd, empty, spark):
    df = odd()
    rows = tokenfiles.read_token_files(tokenfiles.write_token_files(df, PATH, scratch(spark, "t"), block_ids=64)).orderBy("start").collect()
    assert len(rows) == df.count()
    assert rows[0]["doc_id"] is None and [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
    assert sum(r["n_tokens"] for r in rows) == sum(len(x) + 1 for x in ids_of([r["text"] for r in df.collect()]))
    small = tokenfiles.write_token_files(df, PATH, scratch(spark, "t"), block_ids=64, file_ids=100, file_docs=2, rows_per_task=3)
    assert small.count() > df.count() / 2 and [tuple(x) for x in tokenfiles.read_token_files(small, 1).orderBy("start", "doc_id").collect()] == [tuple(x) for x in rows]
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(empty, PATH, scratch(spark, "t"))).collect() == []
