"""Line dedup, mixing and fingerprints against SQL or brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusgrid.llm import registry
from corpusgrid.llm.fingerprints import canonical, colliding, fingerprint, with_next
from corpusgrid.llm.lines import drop_common_lines
from corpusgrid.llm.mixing import mix, solve_exponent
from tests.compare import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, small_dir, name):
    df = registry.QUERIES[name](spark, small_dir)
    names, want = oracle_rows(small_dir, registry.ORACLES[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def plain_lines(rows, least):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    seen = Counter(k for t in rows for k in {key(s) for s in (t or "").split("\n")} if k)
    return [(len(ls := (t or "").split("\n")), "\n".join(s for s in ls if seen[key(s)] < least or not key(s))) for t in rows]


def test_lines_on_odd_rows(odd):
    df = odd("kept")
    rows = [r["text"] for r in df.collect()]
    for least in (2, 3):
        for broadcast in (0, 1000):
            got = drop_common_lines(df, min_docs=least, broadcast_rows=broadcast).collect()
            assert Counter((r["n_lines"], r["kept"]) for r in got) == Counter(plain_lines(rows, least))


def test_op2_counts_documents_not_rows(spark, tmp_path):
    """The line of one document's ten rows stays, as in OP2_SQL; that of ten documents goes, and rows without a key don't count."""
    rows = [(1, "mine")] * 10 + [(i, "ours") for i in range(2, 12)] + [(12, "odd")] + [(None, "odd")] * 10
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["n_dropped"]) for r in registry.QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0), *((i, 1) for i in range(2, 12)), (12, 0), (None, 0)}


def test_lines_of_nothing(empty):
    assert drop_common_lines(empty).collect() == []


def test_no_python_on_the_native_paths(spark, small_dir):
    for name in ("op2_line_dedup", "op6_mixing", "op7_fingerprints"):
        plan = registry.QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_mixture_keeps_every_document_within_the_limit(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = mix(docs, max_repeats=1.5).groupBy("doc_id").count().collect()
    assert len(rows) == docs.count() and {r["count"] for r in rows} <= {1, 2}


def test_mixture_follows_its_weights(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "a").otherwise("b").alias("source"), F.lit("one two three").alias("text"))
    rows = mix(docs, max_repeats=3.0, block_tokens=600).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.first("weight").alias("w")).collect()
    total = sum(r["t"] for r in rows)
    for r in rows:
        assert abs(r["t"] / total - r["w"]) < 0.02
    assert {r["source"]: r["t"] for r in rows}["b"] / 1500 == pytest.approx(3.0, abs=0.1)


def test_budget_is_met(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"), F.lit("a b c d").alias("text"))
    assert mix(docs, budget=4000, block_tokens=400).agg(F.sum("n_tokens")).first()[0] == pytest.approx(4000, rel=0.1)


def test_exponents(spark):
    import math

    shares = spark.createDataFrame([("a", 0.8), ("b", 0.2)], "__s string, p double")
    assert solve_exponent(shares, 2.0, None) == pytest.approx(1 - math.log(2) / math.log(4), abs=1e-6)
    assert solve_exponent(shares, 100.0, None) == 0.0
    a = solve_exponent(shares, None, 0.9)
    w = 0.8**a / (0.8**a + 0.2**a)
    assert -(w * math.log2(w) + (1 - w) * math.log2(1 - w)) == pytest.approx(0.9, abs=1e-4)
    even = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "__s string, p double")
    assert solve_exponent(even, 2.0, None) == 1.0


def test_mixing_odd_rows(odd, empty):
    df = odd("weight")
    rows = mix(df).collect()
    assert {(r["doc_id"], r["text"]) for r in rows} == {(r["doc_id"], r["text"]) for r in df.collect()}
    assert mix(empty).collect() == []


def plain_canonical(t: str | None) -> str:
    nfc = lambda s: unicodedata.normalize("NFC", s)
    return re.sub(r"\s+", " ", nfc(nfc(t or "").casefold())).strip(" ")


def plain_digest(t: str | None) -> str:
    c = plain_canonical(t).encode()
    second = xxhash.xxh64(c, seed=xxhash.xxh64((0x5EED).to_bytes(4, "little"), seed=42).intdigest()).hexdigest()
    return xxhash.xxh64(c, seed=42).hexdigest() + second


def test_canonical_text(odd, spark):
    for r in odd().select("text", canonical(F.coalesce("text", F.lit(""))).alias("c")).collect():
        assert r["c"] == plain_canonical(r["text"])
    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    df = spark.createDataFrame([(f"a{x}b",) for x in spaces], "text string")
    assert {r["c"] for r in df.select(canonical(F.col("text")).alias("c")).collect()} == {"a b"}
    two = spark.createDataFrame([("Café  au lait",), (" café AU\nlait ",), ("cafe au lait",)], "text string")
    a, b, c = (r["fingerprint"] for r in fingerprint(two).orderBy(F.desc("text")).collect())
    assert len({a, b, c}) == 2


def test_fingerprints_against_brute_force(spark, small_dir, texts):
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_fingerprints"](spark, small_dir).collect()}
    assert len(got) == len(texts)
    for i, r in enumerate(texts):
        t, nxt = r["text"] or "", texts[(i + 1) % len(texts)]["text"] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        g = got[r["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g["fingerprint"][:16] == xxhash.xxh64(plain_canonical(t).encode(), seed=42).hexdigest()
        assert g["edited_fingerprint"][:16] == xxhash.xxh64(plain_canonical(edited).encode(), seed=42).hexdigest()
        assert g["near_edited"] == float(plain_canonical(t) == plain_canonical(edited))
        assert g["near_next"] == float(plain_canonical(t) == plain_canonical(nxt))


def test_next_rows_over_many_ranges(spark, monkeypatch):
    from corpusgrid.llm import fingerprints

    bucket = fingerprints.ordered_buckets
    monkeypatch.setattr(fingerprints, "ordered_buckets", lambda df, key: bucket(df, key, 7))
    ids = [None, 5, 5, 9, *range(20, 400, 3)]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "k long, t string").withColumns({"__t1": F.xxhash64("t"), "__t2": F.lit(0)})
    rows = with_next(df, "k", ["k", "t", "__t1"]).collect()
    order = sorted(rows, key=lambda r: (r["k"] is not None, r["k"] or 0, r["__t1"]))
    assert len(rows) == len(ids)
    assert [r["next_t"] for r in order] == [r["t"] for r in order[1:] + order[:1]]
    assert with_next(df.where("k = 9"), "k", ["k", "t", "__t1"]).first()["next_t"] == "t3"


def test_colliding_buckets_are_told_apart_by_their_bytes(spark):
    members = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 2, "a"), (2, 2, "b")], "h1 long, h2 long, c string")
    assert [(r["h1"], r["h2"]) for r in colliding(members).collect()] == [(2, 2)]


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fingerprint(odd("fingerprint"), broadcast_rows=0).collect()
    assert len(rows) == odd().count()
    by = {}
    for r in rows:
        assert by.setdefault(plain_canonical(r["text"]), r["fingerprint"]) == r["fingerprint"]
    assert len(set(by.values())) == len(by)
    assert fingerprint(empty).collect() == []


def test_op7_of_odd_rows(odd, empty, tmp_path, spark):
    """Null and repeated ids, null texts and clashing names: each row once, beside the next in order."""
    for name, df in (("odd", odd("__text")), ("empty", empty), ("one", empty.sparkSession.createDataFrame([(None, None, "en", "s", 0)], empty.schema))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    query = registry.QUERIES["op7_fingerprints"]
    rows = query(spark, f"{tmp_path}/odd").collect()
    docs = [(r["doc_id"], r["text"] or "") for r in odd().collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["fingerprint"][:32]) for r in rows) == sorted((i is None, i or 0, len(t), plain_digest(t)) for i, t in docs)
    assert query(spark, f"{tmp_path}/empty").collect() == []
    one = query(spark, f"{tmp_path}/one").collect()
    assert [(r["doc_id"], r["n_chars"], r["near_edited"], r["near_next"]) for r in one] == [(None, 0, 1.0, 1.0)]
