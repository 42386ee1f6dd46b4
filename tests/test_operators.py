"""Operators that SQL doesn't express, against plain versions over the same rows."""

from __future__ import annotations

import hashlib
import json
import lzma
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from corpusgrid.functions.codecs import ChunkPolicy
from corpusgrid.operators import coding, content, recovery, selection, telemetry


@pytest.fixture(scope="module")
def docs(null_dir):
    rows = pq.read_table(f"{null_dir}/documents.parquet").to_pylist()
    return sorted([{**r, "data": (r["text"] or "").encode()} for r in rows], key=lambda r: r["doc_id"])


def zstd(level: int, data: bytes) -> int:
    return len(zstandard.ZstdCompressor(level=level).compress(data))


def xz(preset: int, data: bytes) -> int:
    return len(lzma.compress(data, format=lzma.FORMAT_XZ, check=lzma.CHECK_NONE, preset=preset))


def test_codec_ratio(spark, null_dir, docs):
    raw, stored, kept = Counter(), Counter(), Counter()
    for r in docs:
        lz4 = 4 + pa.Codec("lz4_raw").compress(r["data"]).size if r["data"] else 5
        for algo, n in (("lz4", lz4), ("zstd", zstd(2, r["data"])), ("lzma", xz(1, r["data"]))):
            key = r["source"], algo
            raw[key] += len(r["data"])
            stored[key] += min(n, len(r["data"]))
            kept[key] += n >= len(r["data"])
    got = {(r["source"], r["algo"]): r for r in coding.q_codec_ratio(spark, null_dir).collect()}
    assert set(got) == set(raw)
    for k, r in got.items():
        assert (r["raw_bytes"], r["stored_bytes"], r["kept_raw"]) == (raw[k], stored[k], kept[k]) and r["ratio"] == pytest.approx(stored[k] / max(raw[k], 1), abs=1e-6)


def test_probe(spark, null_dir, docs):
    w = coding.PROBE_WINDOW
    for r in coding.q_probe_zstd(spark, null_dir).collect():
        data = next(d["data"] for d in docs if d["doc_id"] == r["doc_id"])
        last = max(len(data) - w, 0)
        at = sorted({0, last // 2, last}) if len(data) >= 2 * w else [0]
        assert (r["size"], r["windows"]) == (len(data), len(at))
        assert r["incompressible"] == all(zstd(1, data[a : a + w]) >= len(data[a : a + w]) for a in at)


def test_encode_decision(spark, null_dir, docs):
    first, want = {}, {}
    for r in docs:
        b, i = r["data"], r["doc_id"]
        p = np.bincount(np.frombuffer(b[: coding.PROBE_WINDOW], np.uint8), minlength=256) / max(len(b[: coding.PROBE_WINDOW]), 1)
        noise = len(b) >= coding.PROBE_BYTES and -(p[p > 0] * np.log2(p[p > 0])).sum() > 7.5
        if first.setdefault(b, i) != i:
            want[i] = len(b), "reference", 0
        elif i % 17 == 0 or noise:
            want[i] = len(b), "raw_policy" if i % 17 == 0 else "raw_entropy", len(b)
        else:
            n = xz(1, b)
            want[i] = (len(b), "compressed", n) if n < len(b) else (len(b), "raw_larger", len(b))
    got = {r["doc_id"]: (r["size"], r["decision"], r["stored"]) for r in coding.q_encode_decision(spark, null_dir).collect()}
    assert got == want and {"reference", "raw_policy", "compressed", "raw_larger"} <= {d for _, d, _ in want.values()}


def test_entropy_decides_on_noise_only():
    batch = pa.record_batch({"data": pa.array([b"ab" * 5, None, b"x" * 100, b"", b"y" * 7], pa.binary()), "i": pa.array(range(5))})
    sizes = [(p.num_rows, p.column("i").to_pylist()) for p in coding.parts(iter([batch, batch]), 50)]
    assert [i for _, x in sizes for i in x] == [*range(5)] * 2 and len(sizes) > 2


def test_lpt_shards(spark, null_dir):
    from corpusgrid.operators.planning import document_files

    by = defaultdict(list)
    for r in document_files(spark, null_dir).collect():
        by[r["path"].split("/")[1]].append((-r["size"], r["path"]))
    want = {}
    for rows in by.values():
        load, count, hint = [0] * 4, [0] * 4, 0
        for size, path in sorted(rows):
            s = min(range(4), key=lambda k: (load[k], count[k], (k - hint) % 4))
            load[s], count[s], hint, want[path] = load[s] - size, count[s] + 1, (s + 1) % 4, s
    assert {r["path"]: r["shard"] for r in coding.q_shard_lpt(spark, null_dir).collect()} == want


def test_dedup_window(spark, null_dir, docs):
    want, windows = {}, defaultdict(list)
    for r in docs:
        window = windows[r["source"]]  # (text, id), oldest first
        known = dict(window)
        want[r["doc_id"]] = known.get(r["data"])
        if r["data"] not in known:
            window.append((r["data"], r["doc_id"]))
            del window[:-16]
    assert {r["doc_id"]: r["target"] for r in coding.q_raw_dedup_window(spark, null_dir).collect()} == want


def test_repair_of_missing_and_altered_shards(spark):
    r = np.random.default_rng(4)
    files = [(i, r.bytes(n)) for i, n in enumerate([0, 1, 256, 257, 5000, 30_000])] + [(9, None)]
    p = recovery.protect(spark.createDataFrame(files, "doc_id long, data binary"), 20)
    hurt = p.withColumn("shards", F.transform("shards", lambda s, k: F.when(k == 0, F.lit(None)).otherwise(s)))
    got = {x["doc_id"]: x for x in recovery.repair(hurt).collect()}
    assert {i: bytes(x["data"]) for i, x in got.items()} == {i: b or b"" for i, b in files}
    assert {i: x["status"] for i, x in got.items()} == {i: "repaired" if b else "ok" for i, b in files}
    gone = p.withColumn("shards", F.transform("shards", lambda s, k: F.when(k % 2 == 0, F.lit(None)).otherwise(s)))
    assert {x["doc_id"]: x["status"] for x in recovery.repair(gone).collect()}[5] == "lost"


def test_chunk_policies():
    assert ChunkPolicy.fixed(64) == ChunkPolicy(64, 64, 64) and ChunkPolicy.fixed(64).superchunk == 512
    assert ChunkPolicy.cdc(0, 8, 4) == ChunkPolicy(1, 8, 8) and ChunkPolicy.cdc(16, 8, 4) == ChunkPolicy(16, 16, 16)
    assert ChunkPolicy.cdc_for_target(1024) == ChunkPolicy(256, 1024, 2048) and ChunkPolicy.cdc_for_target(1).least == 1


def test_a_stream_is_cut_at_flips_too(spark, null_dir, docs):
    """Against a scan of the whole stream, a byte at a time."""
    from corpusgrid.functions.codecs import GEAR, MASK64, cdc_masks
    from corpusgrid.operators.planning import document_files, runs

    least, target, most = 256, 1024, 2048
    gear, (short, long_), want = GEAR.tolist(), cdc_masks(target), []
    data = {d["doc_id"]: d["data"] for d in docs}
    order, before = sorted(runs(document_files(spark, null_dir), 65_536).collect(), key=lambda r: r["content_offset"]), None
    offset = start = h = 0
    for r in order:
        if before is not None and r["run_id"] != before[0] and offset > start:
            want.append((*before, start, offset - start))
            start, h = offset, 0
        before = r["run_id"], r["force_raw"]
        for byte in data[r["doc_id"]]:
            h = ((h << 1 | h >> 63) + gear[byte]) & MASK64
            offset += 1
            limit, n = min(most, 8 * most - start % (8 * most)), offset - start
            norm = min(max(target, min(least, limit)), limit)
            if n >= limit or n >= least and h & (short if n < norm else long_) == 0:
                want.append((*before, start, n))
                start, h = offset, 0
    if offset > start:
        want.append((*before, start, offset - start))
    got = sorted(map(tuple, coding.q_cdc_stream(spark, null_dir).collect()), key=lambda r: r[2])
    assert got == want and len({r[0] for r in got}) > 1


def test_paths_of_a_single_file_arent_selected(spark):
    files = spark.createDataFrame([("a", 1)], "path string, size long")
    with pytest.raises(ValueError, match="directories"):
        selection.selected(files, ["a"], is_directory=False)
    assert selection.selected(files, is_directory=False).count() == 0


def test_later_preset_files_replace_values(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"preset": "fast", "compressor": "lz4", "block_size": "1M"}, {"preset": "own", "level": 3}]))
    (tmp_path / "b.json").write_text(json.dumps([{"preset": "fast", "block_size": "2M"}, {"preset": "new", "compressor": "zstd"}, {"compressor": "nameless"}]))
    got = {r["preset"]: r for r in telemetry.preset_files(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).collect()}
    assert set(got) == {"fast", "own", "new"} and (got["fast"]["compressor"], got["fast"]["block_size"]) == ("lz4", "2M") and got["own"]["level"] == 3


def test_sizes_and_shares_of_reports(spark):
    texts = ["1.50 KiB", "3 MB", "7B", "2gib", "x", "", "1.5", None, "0 B"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(telemetry.bytes_of(F.col("t"))).collect()]
    assert got == [1536, 3_000_000, 7, 2 << 30, None, None, None, None, 0]
    shares = spark.createDataFrame([("12.5%",), ("5",), ("x%",)], "t string").select(telemetry.percent_of(F.col("t"))).collect()
    assert [r[0] for r in shares] == [0.125, None, None]


def test_sections_of_reports(spark):
    rows = [(1, "│ before │ 1 │\n▣ Runtime\n│ a │ 1 │\n▣ Other\n│ b │\n▣ Runtime\n│ c │  │\n╔\n│ d │ 2 │"), (2, None), (3, ""), (4, "▣ Empty")]
    got = telemetry.report_cells(spark.createDataFrame(rows, "id long, report string")).orderBy("id", "line").collect()
    assert [(r["id"], r["section"], r["cells"]) for r in got] == [(1, "Other", ["b"]), (1, "Runtime", ["c", ""])]


def test_trained_dictionaries_help(spark):
    rows = content.q_dict_train(spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r["dict_bytes"] <= content.DICTIONARY_BYTES and r["with_dictionary"] < r["alone"] for r in rows)


def test_archives_compress_with_dictionaries(spark, small_dir):
    from corpusgrid.sources import container

    bank = content.train_bank(container.to_archive(spark, small_dir))
    helped = container.archived(spark, small_dir, "zstd", 2048, bank)
    size = lambda m: container.read_blocks(m).where("not raw_passthrough").agg(F.sum("encoded_len"), F.sum(F.expr("int(dictionary_id > 0)"))).first()
    with_bank, without = size(helped), size(container.archived(spark, small_dir, "zstd", 2048))
    assert with_bank[0] < without[0] and with_bank[1] > 0 == without[1]
    imported = container.read_bank(helped.orderBy("uri").limit(1)).drop("uri")
    assert sorted(map(tuple, imported.collect())) == sorted(map(tuple, bank.collect()))
    with pytest.raises(ValueError, match="ids of their own"):
        container.bank_of(imported.union(imported))


def test_encrypted_archives(spark, tmp_path):
    from corpusgrid.sources import container

    texts = [("a.txt", b"one " * 500, False), ("b.txt", b"one " * 500, False), ("c", b"", False), ("d.gz", bytes(range(256)), True)]
    files = spark.createDataFrame(texts, "path string, data binary, force_raw boolean")
    plain = container.write_archives(files, f"file://{tmp_path}/plain", 1000)
    hidden = container.recode(plain, f"file://{tmp_path}/hidden", new=coding.KEY, salt=b"s" * 16)
    again = container.recode(hidden, f"file://{tmp_path}/again", old=coding.KEY)
    assert {r["path"]: bytes(r["data"]) for r in container.read_files(again).collect()} == {p: b for p, b, _ in texts}
    table = lambda m: sorted(tuple(r) for r in container.read_blocks(m).drop("checksum").collect())
    assert table(again) == table(plain) != table(hidden)
    stored = lambda m: sum(r["encoded_len"] + 0 for r in container.read_blocks(m).collect())
    n = container.read_blocks(plain).where("reference_target is null").count()
    assert stored(hidden) == stored(plain) + 28 * n and container.read_blocks(plain).where("reference_target is not null").count() > 0
    assert all(container.Archive(r["uri"]).salt == b"s" * 16 for r in hidden.collect())
    for fails in (lambda: container.read_files(hidden), lambda: container.recode(hidden, f"file://{tmp_path}/x"), lambda: container.recode(plain, f"file://{tmp_path}/y", old=coding.KEY), lambda: container.recode(hidden, f"file://{tmp_path}/z", old=coding.KEY[::-1])):
        with pytest.raises(Exception):
            fails().collect()


def test_archives_of_empty_files_are_recoded(spark, tmp_path):
    from corpusgrid.sources import container

    files = spark.createDataFrame([("a", b"", False)], "path string, data binary, force_raw boolean")
    hidden = container.recode(container.write_archives(files, f"file://{tmp_path}/plain", 64), f"file://{tmp_path}/hidden", new=coding.KEY)
    assert [(r["encrypted"], r["recovery"]) for r in container.flags_of(hidden).collect()] == [(True, False)]
    assert [r["path"] for r in container.read_files(container.recode(hidden, f"file://{tmp_path}/again", old=coding.KEY)).collect()] == ["a"]
    assert [r["opens"] for r in container.opens(hidden, coding.KEY[::-1]).collect()] == [True]


def test_restoring_leaves_no_unsafe_path(spark, tmp_path):
    from corpusgrid.sources.container import restore, write_archives

    files = spark.createDataFrame([("../out.txt", b"x", False)], "path string, data binary, force_raw boolean")
    with pytest.raises(Exception, match="leaves the folder"):
        restore(write_archives(files, f"file://{tmp_path}/archives", 64), f"file://{tmp_path}/to").collect()
    assert not (tmp_path / "out.txt").exists()


def test_the_engine_stands_without_the_training_data_operators(tmp_path):
    """A copy of the repository without the llm folders and the pipeline imports, and has all other queries."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, check=True)
    n, *rest = out.stdout.split()
    assert int(n) > 100 and rest == ["False", "False", "True"]


def test_digests_of_restored_files(spark, null_dir, docs):
    from corpusgrid.sources.container import q_restore_tree

    assert sorted((r["size"], r["digest"]) for r in q_restore_tree(spark, null_dir).collect()) == sorted((len(d["data"]), hashlib.sha256(d["data"]).hexdigest()) for d in docs)


def test_a_tree_is_scanned_whole(spark, tmp_path):
    from corpusgrid.sources.corpus import scan_tree

    files = {"a": b"1", ".hidden": b"", "x/b": b"22", "x/y/c": b"", "x/y/z/deep": b"4444", "empty/.keep": b""}
    for name, data in files.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(data)
    for root in (f"file://{tmp_path}/t", f"{tmp_path}/t/"):
        assert {r["path"]: r["size"] for r in scan_tree(spark, root).collect()} == {k: len(v) for k, v in files.items()}
    assert {r["path"]: bytes(r["content"]) for r in scan_tree(spark, f"{tmp_path}/t", content=True).collect()} == files


def test_archives_are_dealt_evenly_and_recoded_where_they_are(spark, tmp_path, monkeypatch):
    from corpusgrid.sources import container

    for i in range(16):
        (tmp_path / f"{i}.archive").write_bytes(b"".join(container.archive_bytes(iter([(f"{i}/{k}", bytes([i, k]) * 40, False) for k in range(9)]), 64, "zstd", {})))
    manifest = spark.createDataFrame([(str(tmp_path / f"{i}.archive"),) for i in range(16)], "uri string")
    tasks = container.each_archive(manifest, lambda a: [(a.uri,)], "uri string").groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in tasks] == [4, 4, 4, 4]
    plans, kept = [], container.kept
    monkeypatch.setattr(container, "kept", lambda rows, folder: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or kept(rows, folder))
    hidden = container.recode(manifest, f"file://{tmp_path}/hidden", new=coding.KEY)
    again = container.recode(hidden, f"file://{tmp_path}/again", old=coding.KEY)
    assert all(p.count("Exchange") == 1 and "Sort" not in p for p in plans)  # the names'; no payload is moved
    assert {r["path"]: bytes(r["data"]) for r in container.read_files(again).collect()} == {f"{i}/{k}": bytes([i, k]) * 40 for i in range(16) for k in range(9)}


def test_reports_are_read_where_they_are(spark, small_dir):
    reports = telemetry.reports(spark, small_dir)
    for df in (telemetry.report_cells(reports), telemetry.q_report_fields(spark, small_dir), telemetry.q_report_workers(spark, small_dir)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Sort ", "Window", "Aggregate"))
    text = "▣ Runtime\n│ Writer peak │ 1 │\n╔\n▣ Runtime\n│ Writer peak │ 2 │\n│ Writer  peak │ 3 │ x │\n│ Stages │ b 1us | a 2us | b 3us │\n│ Stages │ a 4us │\n▣ Other\n│ Writer peak │ 9 │"
    rows = spark.createDataFrame([(1, text), (2, None), (3, text)], "id long, report string")
    want = [(i, *x) for i in (1, 3) for x in (("field", "writer_peak", "3", 3.0), ("stage", "a", "4us", 4.0), ("stage", "b", "3us", 3.0))]
    assert sorted(map(tuple, telemetry.table_fields(telemetry.report_tables(rows)).collect())) == want
    assert sorted(map(tuple, telemetry.report_fields(telemetry.report_cells(rows)).collect())) == want
