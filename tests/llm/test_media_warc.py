"""Media columns and WARC archives: round trips, brute force, odd rows and broken files."""

from __future__ import annotations

import gzip
import hashlib
import zlib

import numpy as np
import pytest

from corpusgrid.llm import media, registry, warc
from corpusgrid.llm.common import scratch


def test_op1(spark, small_dir, texts):
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_media"](spark, small_dir).collect()}
    for r in texts:
        raw = (r["text"] or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.to_wav(p)
        g = got[r["doc_id"]]
        assert stored[:4] == b"RIFF" and p in stored
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (g["media_bytes"], g["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def plain_peaks(x):
    """The strongest bin of each tile, transform by transform."""
    x = x.astype(np.float32) - 128
    n = max(1, -(-len(x) // media.HOP))
    n += -n % media.TILE_FRAMES
    x = np.pad(x, (0, (n - 1) * media.HOP + media.N_FFT - len(x)))
    mag = [np.abs(np.fft.rfft(x[i * media.HOP : i * media.HOP + media.N_FFT] * np.hanning(media.N_FFT).astype(np.float32)))[1 : media.N_FFT // 2 + 1] for i in range(n)]
    out = []
    for t in range(0, n, media.TILE_FRAMES):
        for b in range(0, media.N_FFT // 2, media.TILE_BINS):
            best = max(((mag[i][j], -i, -j) for i in range(t, t + media.TILE_FRAMES) for j in range(b, b + media.TILE_BINS)))
            if best[0] > 1e-3:
                out.append((-best[1], -best[2]))
    return sorted(out)


def test_peaks_equal_a_plain_transform():
    x = np.frombuffer(("The quick brown fox " * 300).encode(), np.uint8)
    assert list(zip(*(a.tolist() for a in media.peaks(x)))) == plain_peaks(x)


def test_spans_of_a_long_signal_join(monkeypatch):
    x = np.frombuffer(bytes(i * i % 251 for i in range(9000)), np.uint8)
    whole = [a.tolist() for a in media.peaks(x)]
    monkeypatch.setattr(media, "SPAN", media.HOP * media.TILE_FRAMES * 2)
    assert [a.tolist() for a in media.peaks(x)] == whole


def test_pairs_are_time_coded():
    codes = media.pair_codes(np.array([1, 2, 5]), np.array([10, 20, 30]))
    assert [(c >> 32, c >> 24 & 255, c >> 16 & 255, c & 65535) for c in codes.tolist()] == [(1, 10, 20, 1), (1, 10, 30, 4), (2, 20, 30, 3)]
    assert len(media.pair_codes(np.array([1]), np.array([1]))) == 0


def test_op1_reads_a_stored_media_column(spark, small_dir, texts):
    """The query's only input is a table with the media of all documents, and not the documents themselves."""
    files = registry.QUERIES["op1_media"](spark, small_dir).inputFiles()
    assert files and not any(f.endswith("documents.parquet") for f in files)
    stored = {r["doc_id"]: bytes(r["media"]) for r in spark.read.parquet(*files).collect()}
    assert stored == {r["doc_id"]: media.media_of([r["text"]])[0] for r in texts}


def test_media_of_odd_rows(odd, empty):
    df = odd("feature")
    two = media.media_features(media.store_media(df)).collect()
    one = media.store_and_read(df).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["feature"], r["payload_bytes"], r["media_sha256"])
    assert sorted(map(key, one)) == sorted(map(key, two)) and len(one) == df.count()
    assert all(r["payload_bytes"] >= 64 and r["payload_bytes"] % 64 == 0 for r in one)
    assert media.store_and_read(empty).collect() == []
    from pyspark.sql import functions as F

    assert media.media_features(df.withColumn("media", F.lit(None).cast("binary"))).first()["feature"] is None


def archived(spark, df, **more):
    return warc.read_archives(warc.write_archives(df, scratch(spark, "w"), **more)).collect()


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_long_pages_are_segmented_and_joined(spark, monkeypatch, broadcast):
    pages = [(1, "http://a", "x" * 200_000), (2, None, "é" * 40_000), (3, "u", ""), (4, "u", None), (5, "u\r\nX: y", "x" * 200_000), (6, "u", "short"), (None, "u", "short"), (None, "u", "only null")]
    rows = archived(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), broadcast_rows=broadcast)
    got = {r["record_id"].split(":")[2]: r for r in rows if "::" not in r["record_id"]}
    assert len(rows) == len(pages)
    for i, _, h in pages[:6]:
        p = (h or "").encode()
        assert (got[str(i)]["payload_bytes"], got[str(i)]["payload_digest"]) == (len(p), warc.digest(p))
    assert {k for k, r in got.items() if r["record_type"] == "revisit"} == {"4", "5"}
    assert got["5"]["refers_to"].startswith("<urn:page:1:") and got["4"]["refers_to"].startswith("<urn:page:3:")
    assert sorted(r["record_type"] for r in rows if "::" in r["record_id"]) == ["response", "revisit"]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_repeated_long_rows_have_records_of_their_own(spark, broadcast):
    """Equal rows, with and without a key, are all responses, as OP8_SQL has them; rows that repeat them revisit the first."""
    long, other = "x" * 100_000, "y" * 70_000
    pages = [(1, "u", long), (1, "u", long), (1, "v", long), (2, "u", long), (2, "u", long), (None, "u", other), (None, "u", other), (None, None, other), (3, "u", "short"), (3, "u", "short")]
    rows = archived(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), broadcast_rows=broadcast)
    assert len(rows) == len({r["record_id"] for r in rows}) == len(pages)
    got = sorted((r["record_id"].split(":")[2], r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in rows)
    sizes = {"1": long, "2": long, "": other, "3": "short"}
    want = [(i, "revisit" if i == "2" else "response") for i in ["1"] * 3 + ["2"] * 2 + [""] * 3 + ["3"] * 2]
    assert got == sorted((i, kind, len(sizes[i]), warc.digest(sizes[i].encode())) for i, kind in want)
    names = {r["record_id"] for r in rows if r["record_type"] == "response"}
    assert all(r["refers_to"] in names for r in rows if r["record_type"] == "revisit")


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert sorted(r["record_type"] for r in archived(spark, pages, least_bytes=5)) == ["response"] * 3 + ["revisit"]


def test_no_pages(spark):
    assert archived(spark, spark.createDataFrame([], "page_id long, url string, html string")) == []


@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 8192, b"y" * 8193, bytes(range(256)) * 100])
def test_chunked_framing(payload):
    assert warc.unchunked(warc.chunked(payload)) == payload


@pytest.mark.parametrize("body", [b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc", b"zz\r\n"])
def test_broken_framing_is_an_error(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)


def test_a_missing_segment_is_an_error(spark, tmp_path):
    parts = list(warc.records_of(1, "u", b"z" * 100_000, None, False))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts[:1] + parts[2:]))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", 1)], "uri string, n_records long")
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_archives(manifest).collect()


def test_segments_may_be_in_several_archives(spark, tmp_path):
    parts = list(warc.records_of(1, "u", b"z" * 100_000, None, False))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts[2:]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(parts[:2]))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/{x}.warc.gz", 1) for x in "ab"], "uri string, n_records long")
    (row,) = warc.read_archives(manifest).collect()
    assert row["payload_bytes"] == 100_000


def test_a_wrong_digest_is_an_error(tmp_path):
    good = gzip.decompress(next(warc.records_of(1, "u", b"abc", None, False)))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good.replace(b"\r\nabc\r\n", b"\r\nabd\r\n")))
    ((head, block),) = warc.parse(str(tmp_path / "a.warc.gz"))
    with pytest.raises(ValueError, match="payload digest"):
        warc.checked(block, head["warc-payload-digest"].removeprefix("sha1:"))
