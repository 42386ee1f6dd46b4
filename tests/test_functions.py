"""Kernels against plain definitions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrid.functions import codecs
from corpusgrid.operators import coding, content, planning, telemetry


def chunks(data: bytes, least: int, target: int, most: int) -> list[int]:
    """Content-defined cuts, byte by byte."""
    span, (short, long_), gear, out, i = 8 * most, codecs.cdc_masks(target), codecs.GEAR.tolist(), [], 0
    while i < len(data):
        limit = max(1, min(most, span - i % span))
        norm, h, n = min(max(target, min(least, limit)), limit), 0, 0
        while i < len(data):
            h = ((h << 1 | h >> 63) & codecs.MASK64) + gear[data[i]] & codecs.MASK64
            n, i = n + 1, i + 1
            if n >= limit or (n >= least and h & (short if n < norm else long_) == 0):
                break
        out.append(n)
    return out


@pytest.mark.parametrize("sizes", [(8, 32, 64), (256, 1024, 2048), (1, 1, 3)])
def test_cuts_side_by_side_equal_a_sequential_scan(sizes):
    r = random.Random(1)
    texts = [r.randbytes(n) for n in (0, 1, 7, 100, 2000, 9000, 40_000)] + [bytes((i * 97 + 13) % 251 for i in range(512)), b"x" * 600]
    assert [x.tolist() for x in codecs.cdc_lengths(texts, *sizes)] == [chunks(t, *sizes) for t in texts]


def test_crc32c():
    r = random.Random(2)
    assert codecs.crc32c([b"123456789"])[0] == 0xE3069283

    def slow(b: bytes) -> int:
        c = 0xFFFFFFFF
        for x in b:
            c = int(codecs.CRC[(c ^ x) & 255]) ^ (c >> 8)
        return c ^ 0xFFFFFFFF

    blocks = [r.randbytes(n) for n in (0, 1, 3, 4, 5, 1023, 1024, 1025, 5000)]
    assert codecs.crc32c(blocks).tolist() == [slow(b) for b in blocks]


def test_parity_repairs_as_many_shards_as_it_has():
    r = random.Random(3)
    data = np.frombuffer(r.randbytes(500), np.uint8).reshape(10, 50)
    parity = codecs.rs_parity(data, 3)
    shards = {i: s for i, s in enumerate([*data, *parity])}
    for lost in (0, 4, 11):
        del shards[lost]
    assert (codecs.rs_repair(shards, 10, 3) == data).all()
    del shards[5]
    with pytest.raises(ValueError):
        codecs.rs_repair(shards, 10, 3)


def test_clusters():
    a, b = np.zeros((10, 16), np.int64), np.full((9, 16), 100, np.int64)
    assert coding.cluster(np.concatenate([a, b]), 2).tolist() == [0] * 10 + [1] * 9
    assert set(coding.cluster(np.concatenate([a, b[:3]]), 4).tolist()) == {0}  # too few for two


@pytest.mark.parametrize(("path", "ext"), [("a/b.TXT", "txt"), (".bashrc", None), ("a.", None), ("a.b/c", None), ("x/.git.idx", "idx"), ("a.tar.gz", "gz")])
def test_extensions(spark, path, ext):
    assert spark.range(1).select(planning.extension(F.lit(path)).alias("e")).first()["e"] == ext


@pytest.mark.parametrize(("path", "raw"), [(".git/objects/pack/p.idx", True), ("a/.git/objects/pack/p.pack", True), (".git/x/.git/objects/pack/p.idx", False), ("git/objects/pack/p.idx", False), ("a.JPG", True), ("a.txt", False)])
def test_raw_policy(spark, path, raw):
    assert spark.range(1).select(planning.force_raw(F.lit(path)).alias("r")).first()["r"] is raw


def test_sample_windows(spark):
    at = lambda n: spark.range(1).select(content.window_offsets(F.lit(n).cast("long"), 16_384).alias("w")).first()["w"]
    assert at(0) == [] and at(16_384) == [0] and at(32_768) == [0, 16_384] and len(at(262_144)) > 3


@pytest.mark.parametrize(("text", "n"), [("64K", 65_536), ("1M", 1 << 20), ("2G", 2 << 30), ("12", 12), ("3 kb", 3072), ("x", None), ("5q", None)])
def test_sizes(spark, text, n):
    assert spark.range(1).select(telemetry.size_of(F.lit(text)).alias("n")).first()["n"] == n


@pytest.mark.parametrize(("n", "pct", "parity"), [(1, 5, 1), (20, 10, 2), (21, 10, 3)])
def test_parity_counts(spark, n, pct, parity):
    assert spark.range(1).select(telemetry.parity(F.lit(n), F.lit(pct)).alias("p")).first()["p"] == parity


def test_published_scores(spark):
    score = {(r["tool"], r["mode"], r["phase"]): r["score"] for r in telemetry.q_published_score(spark, "").collect()}
    assert score["ref", "fast", "archive"] == 94.1 and score["tar+zstd", "balanced", "extract"] == 71.2 and score["pixz", "ultra", "archive"] == 9.4


def test_step_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('\n{"tool":"a","phase":"archive","elapsed_ns":5}\n{broken\n{"tool":"b"}\n{"tool":"c","phase":"x","elapsed_ns":7,"workers":"2","ratio":0.5}\n')
    assert sorted(map(tuple, telemetry.steps_jsonl(spark, str(tmp_path / "s.jsonl")).collect())) == [("a", "archive", 5, "0", 0.0), ("c", "x", 7, "2", 0.5)]
    head = "tool,phase,mode,workers,pass_num,elapsed_ns,throughput_mib_s,input_bytes,output_bytes,ratio,host_cpu_percent\n"
    (tmp_path / "s.csv").write_text(head + "a,archive,fast,1,1,100,2.5,10,5,0.5,\nb,archive,fast,1,x,100,2.5,10,5,0.5,3\n")
    assert [r["tool"] for r in telemetry.steps_csv(spark, str(tmp_path / "s.csv")).collect()] == ["a"]


def test_stream_dedup_equals_batch(spark, small_dir):
    from corpusgrid.streaming.progress import q_dedup_window_stream

    assert sorted(map(str, q_dedup_window_stream(spark, small_dir).collect())) == sorted(map(str, coding.q_raw_dedup_window(spark, small_dir).collect()))


def test_manifests_round_trip():
    from corpusgrid.sources.container import Entry, decode_manifest, encode_manifest

    rows = [
        Entry("nested", "directory", None, 0, 0o755, 1710000000, 42, 1000, 100),
        Entry("nested/data.bin", "file", None, 7, 0o640, 1710000123, 99, 1000, 100),
        Entry("nested/link", "symlink", "../shared.txt", 0, 0o777, 1710000456, 7, 1000, 100),
        Entry("nested/naïve", "file", None, 300, 0o640, -5, 7, 1000, 100, 7),
    ]
    data = encode_manifest(rows)
    assert decode_manifest(data) == (rows, {})
    for broken in (data[:-1], data + b"x", b"OXM9" + data[4:]):
        with pytest.raises(ValueError):
            decode_manifest(broken)


def archive_of(tmp_path, files, block=8, algo="lz4"):
    from corpusgrid.sources.container import Archive, archive_bytes

    data = b"".join(archive_bytes(iter(files), block, algo, {}))
    (tmp_path / "a").write_bytes(data)
    return data, Archive(str(tmp_path / "a"))


def test_an_equal_block_is_a_reference(tmp_path):
    _, a = archive_of(tmp_path, [("x", b"abcdabcd", False)], block=4)
    assert [(r[0], r[4], r[9]) for r in a.rows()] == [(0, 4, None), (1, 0, 0)]
    assert [a.block(i) for i in (0, 1)] == [b"abcd", b"abcd"]


def test_raw_policy_ends_a_block(tmp_path):
    _, a = archive_of(tmp_path, [("first.txt", b"123456", False), ("second.jpg", b"654321", True)])
    assert [(r[2], r[7]) for r in a.rows()] == [(6, True), (6, True)]  # too short to become smaller


@pytest.mark.parametrize("algo", ["lz4", "zstd", "lzma"])
def test_archives_restore_their_files(tmp_path, algo):
    from corpusgrid.sources.container import contents

    state, noise = 0xCAFEBABEDEADBEEF, bytearray()
    for _ in range(5000):
        state = (state * 6364136223846793005 + 1) % (1 << 64)
        noise.append(state >> 56)
    files = [("a", b"phase1 pipeline integration line\n" * 300, False), ("b", b"", False), ("c", bytes(noise), False), ("d", b"x" * 9000, True)]
    _, a = archive_of(tmp_path, files, 4096, algo)
    assert list(contents(a)) == [(p, c) for p, c, _ in files]
    rows = list(a.rows())
    assert rows[0][4] < rows[0][2] and any(r[7] for r in rows)


def test_broken_archives_are_errors(tmp_path):
    from corpusgrid.sources.container import Archive

    data, _ = archive_of(tmp_path, [("a", b"hello world, " * 50, False)], 64, "zstd")
    bad = bytearray(data)
    bad[30] ^= 1
    (tmp_path / "b").write_bytes(bad)
    with pytest.raises(ValueError, match="corrupt"):
        for i in range(len(Archive(str(tmp_path / "b")).blocks)):
            Archive(str(tmp_path / "b")).block(i)
    assert Archive(str(tmp_path / "b")).block(1, verify=False)
    for broken in (data[:-1], b"NOT\0" + data[4:], data[:40]):
        (tmp_path / "c").write_bytes(broken)
        with pytest.raises(ValueError):
            Archive(str(tmp_path / "c"))


def test_archive_source(spark, tmp_path):
    from corpusgrid.sources.container import register

    _, a = archive_of(tmp_path, [("x", bytes(range(200)) * 3, False)], 64)
    register(spark)
    df = spark.read.format("blockarchive").option("blocksPerTask", 2).load(str(tmp_path / "a"))
    assert [tuple(r) for r in df.orderBy("block_id").collect()] == list(a.rows())
    assert df.rdd.getNumPartitions() == -(-len(a.blocks) // 2)


def test_blocks_of_an_archive_are_checked_side_by_side(tmp_path, monkeypatch):
    from corpusgrid.sources import container

    calls = []
    monkeypatch.setattr(container, "crc32c", lambda blocks: calls.append(len(blocks)) or codecs.crc32c(blocks))
    noise = random.Random(7)
    files = [(f"{i:03}", noise.randbytes(100), False) for i in range(300)] + [("zero", bytes(640), False)]
    _, a = archive_of(tmp_path, files, 64)
    assert len(calls) == 1 and sum(calls) == sum(r[9] is None for r in a.rows()) < len(a.blocks)
    assert list(container.contents(a)) == [(p, c) for p, c, _ in files] and len(calls) == 2
    monkeypatch.setattr(container, "TOGETHER", 1000)  # many rounds give the same archive
    assert archive_of(tmp_path, files, 64)[1].blocks == a.blocks and len(calls) > 20


def ids_dir(tmp_path, ids):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64())}), tmp_path / "documents.parquet")
    return str(tmp_path)


def test_labels_of_more_bytes_than_a_long_holds(spark, tmp_path):
    got = dict(map(tuple, telemetry.q_fmt_bytes(spark, ids_dir(tmp_path, [0, 1, 209_715, 209_716, 2_400_000])).collect()))
    want = {i: f"{i**3 * 1000 / 1024**4:.2f} TiB" for i in (209_715, 209_716, 2_400_000)}
    assert got == {0: "0 B", 1: "1000 B"} | want


def test_hundredths_of_labels_are_those_of_the_double(spark):
    sizes = [1028, 1029, 1 << 19, 1025 * 5, (1 << 20) + 5243, (1 << 20) - 1, 12_345_678_901, (1 << 40) * 3 // 8 * 3]
    sizes += random.Random(3).sample(range(1 << 10, 1 << 43), 500) + [1024 * k + 128 for k in range(1, 200)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "n long").select(telemetry.bytes_label(F.col("n"))).collect()]
    power = [min((n.bit_length() - 1) // 10, 4) for n in sizes]
    assert got == [f"{n / 1024**k:.2f} {'KMGT'[k - 1]}iB" for n, k in zip(sizes, power)]


def test_years_of_more_than_four_digits(spark, tmp_path):
    from corpusgrid.operators import hierarchy
    from corpusgrid.oracles.layout import SQL
    from tests.compare import oracle_rows, rows_of

    folder = ids_dir(tmp_path, [0, 1, 500, 205_756, 205_757, 399_999, 2_399_999])
    assert rows_of(hierarchy.q_mtime_labels(spark, folder)) == oracle_rows(folder, SQL["mtime_labels"])[1]


def test_histograms_hold_little_beside_the_batch(spark):
    import tracemalloc

    import pyarrow as pa

    from corpusgrid.functions import bytes as kernels

    data = [bytes([i % 7, 65]) * 8192 for i in range(1000)]
    tracemalloc.start()
    hist = kernels.histograms(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(map(len, data)) // 2 and (hist[:, 65] == 8192).all() and (hist[1] > 0).sum() == 2
    odd = [b"", None, b"\0\1", None, b"abc"]
    assert kernels.histograms(pa.array([b"x", *odd]).slice(1)).tolist() == kernels.histograms(odd).tolist()
