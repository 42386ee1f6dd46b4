"""Token ids in files: Simple-8b words over per-block frequency ranks, with escapes and block offsets."""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrid.llm.bpe import PieceCache, default_tokenizer
from corpusgrid.llm.common import HELD, bounded, documents, gathered, open_store, scratch, table, take_turn, text_of, write_once

#: Simple-8b's selectors, by number: values in a word and bits of each, in the word's low 60 bits, lowest first.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
MAGIC = b"S8BIDS1\n"
#: Codes of this many bits at most are packed; rarer ids of a block become code 0 and follow in its escape list.
CODE_BITS = 12


#: Bit lengths of small values.
WIDTHS = np.array([i.bit_length() for i in range(1 << CODE_BITS)], np.uint8)


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of values below 2**60. Each word takes as many values as a selector holds; for every start at once, from
    the largest bit length in the window, which each selector's window builds from the one before."""
    n = len(values)
    v = values.astype(np.uint64)
    if n and int(v.max()) < len(WIDTHS):
        widest = WIDTHS[values]
    else:
        widest = sum(((v >> np.uint64(bits) != 0).astype(np.uint8) for bits in range(60)), np.zeros(n, np.uint8))
    take, sel, width = np.ones(n, np.uint8), np.full(n, 15, np.uint8), 1
    for s in range(14, -1, -1):
        count, bits = SELECTORS[s]
        if count > n:
            break
        step = count - width
        widest, width = np.maximum(widest[:-step], widest[step:]), count
        fits = widest <= bits
        np.copyto(take[: len(fits)], count, where=fits)
        np.copyto(sel[: len(fits)], s, where=fits)
    steps, starts, i = take.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts, np.int64)
    chosen = sel[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in set(chosen.tolist()):
        count, bits = SELECTORS[s]
        if bits:
            rows = np.flatnonzero(chosen == s)
            at, packed = starts[rows], np.zeros(len(rows), np.uint64)
            for i in range(count):
                packed |= v[at + i] << np.uint64(i * bits)
            words[rows] |= packed
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of Simple-8b words; every selector's words at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[sel]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in set(sel.tolist()):
        count, bits = SELECTORS[s]
        if bits:
            rows = np.flatnonzero(sel == s)
            part = words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[starts[rows][:, None] + np.arange(count)] = part & np.uint64((1 << bits) - 1)
    return out


def pack_block(ids: np.ndarray) -> bytes:
    """A block: sizes, the ids by falling frequency (ties by id), Simple-8b words of ranks from 1, escaped ids."""
    if ids.max() < 1 << 22:
        every = np.bincount(ids)
        known = np.flatnonzero(every)
        order = np.lexsort((known, -every[known]))
        every[known[order]] = np.arange(1, len(known) + 1)
        codes = every[ids]
    else:
        known, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.lexsort((known, -counts))
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(1, len(known) + 1)
        codes = rank[inverse]
    limit = (1 << CODE_BITS) - 1
    escaped = ids[codes > limit].astype("<u4")
    codes[codes > limit] = 0
    names = known[order][:limit].astype("<u4")
    words = pack(codes).astype("<u8")
    return struct.pack("<4I", len(ids), len(names), len(words), len(escaped)) + names.tobytes() + words.tobytes() + escaped.tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    n, n_names, n_words, n_escaped = struct.unpack_from("<4I", data)
    at = 16
    names = np.frombuffer(data, "<u4", n_names, at)
    at += 4 * n_names
    codes = unpack(np.frombuffer(data, "<u8", n_words, at).astype(np.uint64)).astype(np.int64)[:n]
    out = np.zeros(n, np.uint32)
    plain = codes > 0
    out[plain] = names[codes[plain] - 1]
    out[~plain] = np.frombuffer(data, "<u4", n_escaped, at + 8 * n_words)
    return out


def file_chunks(docs: Iterator[tuple[int | None, np.ndarray]], totals: dict, block_ids: int) -> Iterator[bytes]:
    """A file's bytes: magic, blocks of block_ids ids (the last may have fewer), then block offsets, keys, their null flags and lengths,
    and a fixed-size tail."""
    yield MAGIC
    at, offsets, keys, nulls, lengths, held, size = len(MAGIC), [], array("q"), bytearray(), array("I"), [], 0

    def full(ids: np.ndarray) -> bytes:
        nonlocal at
        data = pack_block(ids)
        offsets.append(at)
        at += len(data)
        return data

    for key, ids in docs:
        keys.append(key or 0)
        nulls.append(key is None)
        lengths.append(len(ids))
        held.append(ids)
        size += len(ids)
        if size >= block_ids:
            ids = np.concatenate(held)
            while len(ids) >= block_ids:
                yield full(ids[:block_ids])
                ids = ids[block_ids:]
            held, size = [ids], len(ids)
    if size:
        yield full(np.concatenate(held))
    totals |= {"n_docs": len(keys), "n_ids": sum(lengths), "n_blocks": len(offsets)}
    yield np.array([*offsets, at], "<u8").tobytes() + np.array(keys, "<i8").tobytes() + bytes(nulls) + np.array(lengths, "<u4").tobytes()
    yield struct.pack("<4Q", len(offsets), len(keys), at, block_ids)


def read_range(uri: str, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(key, start in the file, ids) of each document that starts in the blocks from first to before last (none: to the end), a block
    in memory at a time. Reading begins at the first block's offset."""
    fs, path = open_store(uri)
    with fs.open_input_file(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        f.seek(f.size() - 32)
        n_blocks, n_docs, at, block_ids = struct.unpack("<4Q", f.read(32))
        f.seek(at)
        offsets = np.frombuffer(f.read(8 * (n_blocks + 1)), "<u8")
        keys = np.frombuffer(f.read(8 * n_docs), "<i8")
        nulls = np.frombuffer(f.read(n_docs), "u1")
        lengths = np.frombuffer(f.read(4 * n_docs), "<u4").astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        low = int(np.searchsorted(starts, first * block_ids))
        high = n_docs if last is None or last >= n_blocks else int(np.searchsorted(starts, last * block_ids))

        def blocks() -> Iterator[np.ndarray]:
            """The ids from the start of document low on."""
            f.seek(int(offsets[first]))
            skip = int(starts[low]) - first * block_ids
            for n in np.diff(offsets[first:]).tolist():
                ids = unpack_block(f.read(n))
                yield ids[skip:]
                skip = max(0, skip - len(ids))

        source, held = blocks(), np.empty(0, np.uint32)
        for i in range(low, high):
            parts, n = [], int(lengths[i])
            while n > len(held):
                parts.append(held)
                n -= len(held)
                held = next(source)
            parts.append(held[:n])
            held = held[n:]
            yield None if nulls[i] else int(keys[i]), int(starts[i]), np.concatenate(parts)


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, ids) of each document."""
    return ((key, ids) for key, _, ids in read_range(uri))


ENCODERS: dict[str, PieceCache] = {}
HELD[__name__] = ENCODERS.clear


def library_encoder(path: str) -> PieceCache:
    """The tokenizers library behind a cache of pieces."""
    if path not in ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        to_bytes = lambda e: np.array(e.ids, "<i4").tobytes()
        specials = [t.content for t in tok.get_added_tokens_decoder().values()]
        lengths = np.zeros(tok.get_vocab_size(), np.int64)
        for t, i in tok.get_vocab().items():
            lengths[i] = len(t)  # in the byte-level alphabet a character is a byte

        def encode_spaced(found: list[str]) -> list[bytes]:
            """Pieces after a space are encoded as texts of some pieces, and told apart by the bytes that their ids stand for."""
            texts = [" " + " ".join(found[i : i + 64]) for i in range(0, len(found), 64)]
            ids = np.concatenate([np.array(e.ids, "<i4") for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.cumsum(pc.binary_length(pa.array(found, pa.string())).to_numpy().astype(np.int64) + 1)
            cuts = [0, *(4 * np.searchsorted(np.cumsum(lengths[ids]), ends) + 4).tolist()]
            data = ids.tobytes()
            return [data[a:b] for a, b in zip(cuts, cuts[1:])]

        encode_first = lambda xs: [to_bytes(e) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]
        ENCODERS[path] = PieceCache(encode_first, encode_spaced, lambda t: to_bytes(tok.encode(t, add_special_tokens=False)), specials, 400_000)
    return ENCODERS[path]


def write_token_files(df: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0, block_ids: int = 1 << 19, file_ids: int = 1 << 27, file_docs: int = 1 << 20, rows_per_task: int = 500_000) -> DataFrame:
    """Writes the ids of every whole text, each followed by end_id, in ascending order of the integer key (null first, ties by
    text hash) and returns the manifest: shard, file, uri, n_docs, n_ids, n_blocks, base (ids in all files before).

    One shuffle deals ranges of the key, each of about rows_per_task rows at most; a task writes its range as files of at most file_docs
    documents that each end with the document that reaches file_ids, a block at a time, under its attempt's own name; only files of
    attempts that succeeded are in the manifest. A null or empty text is its end id alone. An empty table gives an empty manifest."""
    rows = df.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t"))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_task))
    rows = rows.repartitionByRange(n, F.asc_nulls_first("k"), F.xxhash64("t")).sortWithinPartitions(F.asc_nulls_first("k"), F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(__name__)
        enc, task, end, number = library_encoder(tokenizer), TaskContext.get(), np.array([end_id], np.int32), 0

        def docs():
            for part in gathered(batches, "t", 8 << 20):  # pieces are made distinct, and looked up, for a part at once
                for k, ids in zip(part.column("k").to_pylist(), enc.encode(part.column("t"))):
                    yield k, np.concatenate([ids, end]).astype(np.uint32)

        def one_file(first: tuple, more: Iterator[tuple]) -> Iterator[tuple]:
            n, size = 1, len(first[1])
            yield first
            while n < file_docs and size < file_ids and (doc := next(more, None)) is not None:
                yield doc
                n, size = n + 1, size + len(doc[1])

        every = docs()
        while (first := next(every, None)) is not None:
            totals: dict = {}
            uri = f"{folder}/ids-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.s8b"
            write_once(uri, file_chunks(one_file(first, every), totals, block_ids))
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "file": [number], "uri": [uri], **{k: [v] for k, v in totals.items()}})
            number += 1

    manifest = table(bounded(rows).mapInArrow(run, "shard long, file long, uri string, n_docs long, n_ids long, n_blocks long"), "manifest")
    before = Window.orderBy("shard", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, blocks_per_task: int = 64) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files, decoded block by block; a task begins at the offset of any
    block, so a file is read by as many as it has runs of blocks_per_task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base, first in zip(*[batch.column(c).to_pylist() for c in ("uri", "base", "first")]):
                out: list[tuple] = []
                for k, start, ids in read_range(uri, first, first + blocks_per_task):
                    out.append((k, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 50_000:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_blocks") - 1, F.lit(0)), F.lit(blocks_per_task).cast("long"))
    spread = manifest.select("uri", "base", F.explode(runs).alias("first")).repartition(n, "uri", "first")
    return bounded(spread).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ids and read back."""
    manifest = write_token_files(documents(spark, sf_dir), default_tokenizer(), scratch(spark, "tokens"))
    return read_token_files(manifest)
