"""Block archives: a container of encoded blocks with a manifest of files, written by tasks and read by block ranges.

Layout: header (24 bytes), block payloads in order of id, manifest, table of 14-byte block descriptors, footer (40 bytes). Payload
offsets are prefix sums of the encoded lengths, content offsets of files prefix sums of their sizes; neither is stored."""

from __future__ import annotations

import hashlib
import lzma
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusgrid.functions.bytes import SAMPLE, profiles
from corpusgrid.functions.codecs import crc32c
from corpusgrid.plans.scale import checkpointed, running, sized_broadcast

# Magic numbers and versions of header, footer and manifest; flags of header, footer, blocks and entries.
HEADER_MAGIC, HEADER_VERSION, FOOTER_MAGIC, FOOTER_VERSION = b"OXZ\0", 3, b"END\0", 2
MANIFEST_MAGICS = {b"OXM2": 2, b"OXM3": 3}
IS_DIRECTORY, PATH_PREFIX, INHERIT, IMPLICIT_CONTENT, IMPLICIT_CHUNKS, ENCRYPTED, RECOVERY = (1 << i for i in range(7))
MANIFEST_PACKED, TABLE_PACKED = 1, 2
ALGORITHMS = {1: "lz4", 2: "zstd", 3: "lzma"}
RAW, REFERENCE = 8, 16
DIRECTORY, SYMLINK, MODE, UID, GID, SECONDS, NANOS = (1 << i for i in range(7))
CLASSES = {1: "Text", 2: "StructuredText", 3: "Binary", 4: "Extension"}
HEADER, FOOTER, DESCRIPTOR = struct.Struct("<4sHH16s"), struct.Struct("<4sHHIQIQII"), struct.Struct("<IIIBB")
#: The largest manifest that is unpacked.
MANIFEST_MAX = 256 << 20
#: Bytes of blocks that are encoded, or checked, side by side: kernels over one small block take as long as over a thousand.
TOGETHER = 4 << 20


def together(rows: Iterator, size) -> Iterator[list]:
    """The rows in lists of about TOGETHER bytes, by size(row)."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= TOGETHER:
            yield held
            held, n = [], 0
    if held:
        yield held


def open_path(uri: str):
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


class Bytes:
    """A cursor; reading past the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the manifest is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
            if shift >= 64:
                raise ValueError("a number is too long")


@dataclass
class Entry:
    path: str
    kind: str = "file"
    target: str | None = None
    size: int = 0
    mode: int = 0
    seconds: int = 0
    nanos: int = 0
    uid: int = 0
    gid: int = 0
    content_offset: int = 0


@dataclass(frozen=True)
class Dictionary:
    """kind: a class of content, or Extension: and an extension. signature: 16 bytes, the mean of the samples'."""

    id: int
    kind: str
    samples: int
    sample_bytes: int
    signature: bytes
    data: bytes
    algo: str = "zstd"


class Bank:
    """Dictionaries, 255 at most, and which of them suit blocks: one's extension's before its class's, less the distance of the
    signatures; ties by samples, bytes, id."""

    def __init__(self, dictionaries: list[Dictionary]):
        ids = [d.id for d in dictionaries]
        if len(set(ids)) < len(ids) or not all(0 < i < 256 for i in ids) or not all(d.data for d in dictionaries):
            raise ValueError("dictionaries have ids of their own from 1 to 255, and none is empty")
        self.dictionaries, self.codecs = dictionaries, {}

    def choose(self, algo: str, blocks: list[tuple[str | None, bytes]]) -> list[Dictionary | None]:
        """blocks: (extension, content), profiled at once."""
        known = sorted((d for d in self.dictionaries if d.algo == algo), key=lambda d: (d.samples, d.sample_bytes, d.id), reverse=True)
        if not known or not blocks or algo != "zstd":
            return [None] * len(blocks)
        kinds, own = profiles([data[:SAMPLE] for _, data in blocks])
        ext = np.array([f"Extension:{e}" for e, _ in blocks], object)
        score = np.full((len(known), len(blocks)), -1, np.int64)  # of a dictionary that fits it is positive: signatures are at most 4,080 apart
        for row, d in zip(score, known):
            reach = np.where(ext == d.kind, 20_000, np.where(kinds == d.kind, 10_000, 0))
            row[reach > 0] = (reach - np.abs(own - np.frombuffer(d.signature, np.uint8)).sum(axis=1))[reach > 0]
        best = score.argmax(axis=0)  # the first, of equals
        return [known[k] if score[k, i] >= 0 else None for i, k in enumerate(best.tolist())]

    def compress(self, d: Dictionary, data: bytes) -> bytes:
        if d.id not in self.codecs:
            self.codecs[d.id] = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d.data))
        return self.codecs[d.id].compress(data)


def encode_manifest(entries: list[Entry], dictionaries: list[Dictionary] = ()) -> bytes:
    """Dictionaries, then entries, each coded against the one before."""
    out, before = [b"OXM3\x03", varint(len(dictionaries))], Entry("")
    for d in dictionaries:
        kind, _, ext = d.kind.partition(":")
        out += [bytes([d.id, next(n for n, a in ALGORITHMS.items() if a == d.algo), next(n for n, c in CLASSES.items() if c == kind)])]
        out += [varint(len(ext.encode())), ext.encode()] if ext else []
        out += [varint(d.samples), varint(d.sample_bytes), d.signature, varint(len(d.data)), d.data]
    out.append(varint(len(entries)))
    for e in entries:
        new = {MODE: e.mode != before.mode, UID: e.uid != before.uid, GID: e.gid != before.gid, SECONDS: e.seconds != before.seconds, NANOS: e.nanos != before.nanos}
        path, prev = e.path.encode(), before.path.encode()
        shared = len(os.path.commonprefix([path, prev]))
        out += [bytes([sum(f for f, x in new.items() if x) | {"directory": DIRECTORY, "symlink": SYMLINK}.get(e.kind, 0)]), varint(shared), varint(len(path) - shared), path[shared:]]
        if e.kind == "symlink":
            out += [varint(len(e.target.encode())), e.target.encode()]
        if e.kind == "file":
            out.append(varint(e.size))
        step = e.seconds - before.seconds
        values = {MODE: e.mode, UID: e.uid, GID: e.gid, SECONDS: step << 1 if step >= 0 else (-step << 1) - 1, NANOS: e.nanos}
        out += [varint(values[f]) for f in (MODE, UID, GID, SECONDS, NANOS) if new[f]]
        before = e
    return b"".join(out)


def decode_manifest(data: bytes) -> tuple[list[Entry], dict[int, Dictionary]]:
    """Entries with their content offsets, and dictionaries by id."""
    b = Bytes(data)
    version = MANIFEST_MAGICS.get(b.take(4))
    if version is None or b.take(1)[0] != version:
        raise ValueError("no manifest of a known version")
    dictionaries = {}
    for _ in range(b.number()):
        name, algo, number = b.take(3)
        kind, about = CLASSES.get(number), (0, 0, bytes(16))
        if kind is None or algo not in ALGORITHMS or name in dictionaries or not name:
            raise ValueError("a dictionary of an unknown class or codec, or with another's id")
        if kind == "Extension":
            kind = f"Extension:{b.take(b.number()).decode()}"
        if version >= 3:
            about = b.number(), b.number(), b.take(16)
        dictionaries[name] = Dictionary(name, kind, *about, b.take(b.number()), ALGORITHMS[algo])
    entries, e, offset = [], Entry(""), 0
    for _ in range(b.number()):
        flags = b.take(1)[0]
        kind = "directory" if flags & DIRECTORY else "symlink" if flags & SYMLINK else "file"
        path = (e.path.encode()[: b.number()] + b.take(b.number())).decode()
        target = b.take(b.number()).decode() if kind == "symlink" else None
        size = b.number() if kind == "file" else 0
        mode = b.number() if flags & MODE else e.mode
        uid = b.number() if flags & UID else e.uid
        gid = b.number() if flags & GID else e.gid
        step = b.number() if flags & SECONDS else 0
        nanos = b.number() if flags & NANOS else e.nanos
        if nanos >= 1_000_000_000:
            raise ValueError("nanoseconds are out of range")
        e = Entry(path, kind, target, size, mode, e.seconds + (step >> 1 ^ -(step & 1)), nanos, uid, gid, offset if kind == "file" else 0)
        offset += size
        entries.append(e)
    if b.at != len(data):
        raise ValueError("the manifest has trailing bytes")
    return entries, dictionaries


@lru_cache(1)
def zstd() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@lru_cache(256)
def unzstd(dictionary: bytes | None) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def encode_block(algo: str, data: bytes, force_raw: bool = False) -> tuple[int, bytes]:
    """(flags, payload) of a block: raw if it is to be, or if the codec doesn't make it smaller."""
    number = next(n for n, a in ALGORITHMS.items() if a == algo)
    if force_raw:
        return number | RAW, data
    if algo == "lz4":
        packed = struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True)
    elif algo == "zstd":
        packed = zstd().compress(data)
    else:
        packed = lzma.compress(data, format=lzma.FORMAT_XZ, check=lzma.CHECK_NONE, preset=6)
    return (number, packed) if len(packed) < len(data) else (number | RAW, data)


def decode_block(flags: int, raw_len: int, payload: bytes, dictionary: bytes | None = None) -> bytes:
    if flags & RAW:
        out = payload
    elif ALGORITHMS.get(flags & 7) == "lz4":
        if struct.unpack_from("<I", payload)[0] != raw_len:
            raise ValueError("a block says another length")
        out = pa.Codec("lz4_raw").decompress(payload[4:], raw_len, asbytes=True)
    elif ALGORITHMS.get(flags & 7) == "zstd":
        out = unzstd(dictionary).decompress(payload, max_output_size=raw_len)
    elif ALGORITHMS.get(flags & 7) == "lzma":
        out = lzma.decompress(payload)
    else:
        raise ValueError("an unknown codec")
    if len(out) != raw_len:
        raise ValueError("a block is of another length")
    return out


def packed(data: bytes) -> tuple[bytes, bool]:
    small = zstd().compress(data) if data else data
    return (small, True) if len(small) < len(data) else (data, False)


def ext_of(path: str) -> str | None:
    stem, _, ext = path.rpartition("/")[2].rpartition(".")
    return ext.lower() if stem and ext else None


def archive_bytes(files: Iterator[tuple[str, bytes, bool]], block: int, algo: str, totals: dict, bank: Bank | None = None) -> Iterator[bytes]:
    """An archive's bytes, some MB at a time: files (path, content, force raw) are concatenated, and a block ends when it is full or
    when the raw policy changes. A block equal to an earlier one refers to it. With a bank, a block is compressed with the dictionary
    that suits it; a block of files with several extensions has none of its own."""
    yield HEADER.pack(HEADER_MAGIC, HEADER_VERSION, IS_DIRECTORY | PATH_PREFIX | INHERIT | IMPLICIT_CONTENT | IMPLICIT_CHUNKS, bytes(16))
    at, table, entries, seen = HEADER.size, [], [], {}

    def blocks() -> Iterator[tuple[bytes, bool, str | None]]:
        """(content, force raw, extension)."""
        held, raw_now, exts = bytearray(), False, set()
        ext = lambda: next(iter(exts)) if len(exts) == 1 else None
        for path, content, raw in files:
            entries.append(Entry(path, size=len(content), mode=0o644))
            if content and raw != raw_now:
                if held:
                    yield bytes(held), raw_now, ext()
                held, raw_now = bytearray(), raw
            if not held:
                exts = set()
            if content:
                exts.add(ext_of(path))
            held += content
            while len(held) >= block:
                yield bytes(held[:block]), raw_now, ext()
                del held[:block]
                exts = {ext_of(path)}  # what is left is the last file's
        if held:
            yield bytes(held), raw_now, ext()

    for some in together(blocks(), lambda b: len(b[0])):
        new = []
        for data, raw, ext in some:
            key = (len(data), hashlib.sha256(data).digest())
            if key in seen:
                table.append(DESCRIPTOR.pack(0, len(data), seen[key], REFERENCE, 0))
                continue
            seen[key] = len(table)
            new.append((len(table), data, raw, ext))
            table.append(b"")
        chosen = [None] * len(new) if bank is None else bank.choose(algo, [(ext, data) for _, data, _, ext in new])
        stored = []
        for (_, data, raw, _), d in zip(new, chosen):
            flags, payload = encode_block(algo, data, raw)
            helped = bank.compress(d, data) if d and not raw else payload
            stored.append((flags & ~RAW, helped, d.id) if len(helped) < len(payload) else (flags, payload, 0))
        for (i, data, _, _), (flags, payload, used), check in zip(new, stored, crc32c([p for _, p, _ in stored]).tolist()):
            table[i] = DESCRIPTOR.pack(len(payload), len(data), check, flags, used)
            at += len(payload)
        yield b"".join(p for _, p, _ in stored)
    manifest, m_small = packed(encode_manifest(entries, bank.dictionaries if bank else []))
    chunks, c_small = packed(b"".join(table))
    totals |= {"n_files": len(entries), "n_blocks": len(table)}
    yield manifest + chunks
    yield FOOTER.pack(FOOTER_MAGIC, FOOTER_VERSION, MANIFEST_PACKED * m_small | TABLE_PACKED * c_small, len(table), at, len(manifest), at + len(manifest), len(chunks), 0)


class Archive:
    """What an archive says of itself: flags, entries, dictionaries and blocks. Payloads are read only by block()."""

    def __init__(self, uri: str):
        fs, path = open_path(uri)
        self.uri, self.file = uri, fs.open_input_file(path)
        size = self.file.size()
        if size < HEADER.size + FOOTER.size:
            raise ValueError(f"{uri}: too short")
        magic, version, self.flags, self.salt = HEADER.unpack(self.part(0, HEADER.size))
        end, end_version, packing, count, m_at, m_len, c_at, c_len, _crc = FOOTER.unpack(self.part(size - FOOTER.size, FOOTER.size))
        if (magic, version, end, end_version) != (HEADER_MAGIC, HEADER_VERSION, FOOTER_MAGIC, FOOTER_VERSION):
            raise ValueError(f"{uri}: not an archive of a known version")
        self.encrypted = bool(self.flags & ENCRYPTED)
        unpack = lambda b: zstandard.ZstdDecompressor().decompress(b, max_output_size=MANIFEST_MAX)
        manifest, chunks = self.part(m_at, m_len), self.part(c_at, c_len)
        self.packed_manifest = manifest, packing & MANIFEST_PACKED
        self.entries, self.dictionaries = decode_manifest(unpack(manifest) if packing & MANIFEST_PACKED else manifest)
        chunks = unpack(chunks) if packing & TABLE_PACKED else chunks
        if len(chunks) != count * DESCRIPTOR.size:
            raise ValueError(f"{uri}: the block table is of another length")
        self.blocks = list(DESCRIPTOR.iter_unpack(chunks))
        encoded = np.array([b[0] for b in self.blocks], np.int64)
        raw = np.array([b[1] for b in self.blocks], np.int64)
        self.payload_at, self.raw_at = HEADER.size + np.cumsum(encoded) - encoded, np.cumsum(raw) - raw
        if HEADER.size + int(encoded.sum()) != m_at or int(raw.sum()) != sum(e.size for e in self.entries):
            raise ValueError(f"{uri}: lengths don't add up")
        for i, b in enumerate(self.blocks):
            if b[3] & REFERENCE and (b[2] >= i or self.blocks[b[2]][1] != b[1]):
                raise ValueError(f"{uri}: block {i} refers to no earlier block of its length")

    def part(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int, verify: bool = True) -> bytes:
        """The content of a block, through its references. A checksum of 0 wasn't recorded."""
        return next(self.decoded([i], verify))

    def decoded(self, blocks, verify: bool = True) -> Iterator[bytes]:
        """block() of each, some MB checked at a time, and what is referred to more than once in them read once."""
        for some in together(map(self.stored, blocks), lambda i: self.blocks[i][1]):
            if self.encrypted:
                raise ValueError(f"{self.uri}: encrypted; recode() it with its key first")
            payloads = {i: self.part(int(self.payload_at[i]), self.blocks[i][0]) for i in dict.fromkeys(some)}
            if verify:
                for i, found in zip(payloads, crc32c(list(payloads.values())).tolist()):
                    if self.blocks[i][2] not in (0, found):
                        raise ValueError(f"block {i} is corrupt")
            for i in some:
                _, raw, _, flags, dictionary = self.blocks[i]
                yield decode_block(flags, raw, payloads[i], self.dictionaries[dictionary].data if dictionary else None)

    def stored(self, i: int) -> int:
        """The block that holds a block's payload: itself, or the one that it refers to."""
        while self.blocks[i][3] & REFERENCE:
            i = self.blocks[i][2]
        return i

    def payloads(self) -> Iterator[tuple]:
        """(uri, block, what is stored of it): empty for a reference, and for block -1, which stands for the archive."""
        yield self.uri, -1, b""
        for i, at in enumerate(self.payload_at.tolist()):
            yield self.uri, i, self.part(at, self.blocks[i][0])

    def rows(self, first: int = 0, last: int | None = None) -> Iterator[tuple]:
        for i in range(first, len(self.blocks) if last is None else min(last, len(self.blocks))):
            encoded, raw, check, flags, dictionary = self.blocks[i]
            ref = check if flags & REFERENCE else None
            yield i, int(self.raw_at[i]), raw, int(self.payload_at[i]), encoded, None if ref is not None else check, ALGORITHMS.get(flags & 7), bool(flags & RAW), dictionary, ref


BLOCK_ROWS = "block_id long, raw_offset long, raw_len long, payload_offset long, encoded_len long, checksum long, algo string, raw_passthrough boolean, dictionary_id int, reference_target long"


class BlockRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        n = len(Archive(self.path).blocks)
        return [BlockRange(i, min(n, i + self.per_task)) for i in range(0, n, self.per_task)] or [BlockRange(0, 0)]

    def read(self, partition: BlockRange) -> Iterator[tuple]:
        yield from Archive(self.path).rows(partition.first, partition.last)


class ArchiveSource(DataSource):
    """spark.read.format("blockarchive").load(path): the block table, in ranges of blocks."""

    @classmethod
    def name(cls) -> str:
        return "blockarchive"

    def schema(self) -> str:
        return BLOCK_ROWS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("blocksPerTask", 100_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def write_archives(files: DataFrame, folder: str, block: int, algo: str = "zstd", bank: DataFrame | None = None) -> DataFrame:
    """files (path, data, force_raw) as archives, one a task, each a range of paths; uri, n_files, n_blocks of those whose attempts
    succeeded. Within an archive fragments aren't reordered: files are in order of path. bank: the dictionaries to compress with, as
    content.train_bank() or read_bank() give them, 255 at most."""
    known = bank_of(bank) if bank is not None else None
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = files.select("path", "data", "force_raw").repartitionByRange(n, "path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (x for b in batches for x in zip(*[b.column(c).to_pylist() for c in ("path", "data", "force_raw")]))
        first = next(every, None)
        if first is None:
            return
        totals: dict = {}
        uri = written(folder, archive_bytes((x for y in ([first], every) for x in y), block, algo, totals, known))
        yield pa.RecordBatch.from_pydict({"uri": [uri], "n_files": [totals["n_files"]], "n_blocks": [totals["n_blocks"]]})

    return kept(rows.mapInArrow(run, "uri string, n_files long, n_blocks long"), folder)


def written(folder: str, data: Iterator[bytes], number: int = 0) -> str:
    """Writes a task's archive under its attempt's name."""
    task = TaskContext.get()
    uri = f"{folder.rstrip('/')}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.archive"
    fs, path = open_path(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        for part in data:
            out.write(part)
    return uri


def kept(rows: DataFrame, folder: str) -> DataFrame:
    """The manifest of the archives that attempts which succeeded have written, kept with them."""
    at = f"{folder.rstrip('/')}/manifest"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def each_archive(manifest: DataFrame, fn, schema: str) -> DataFrame:
    """fn(archive) -> rows, over all archives, those of one after another, in order. They are dealt by ranges of names, as many to each
    task; by hash some tasks would have several and others none."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, size = [], 0
                for row in fn(Archive(uri)):
                    rows.append(row)
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    if len(rows) == 1000 or size > 16 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[c.strip().split()[1]]) for n, c in zip(names, schema.split(","))])
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("uri").repartitionByRange(n, "uri").mapInArrow(run, schema)


def read_blocks(manifest: DataFrame) -> DataFrame:
    return each_archive(manifest, lambda a: a.rows(), BLOCK_ROWS)


def one_stream(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, files) of all archives as of one stream: each archive's blocks and files come after those of the archives before it by
    name, block numbers, references and offsets counted on. Blocks as read_blocks(), files as read_entries()."""
    sizes = each_archive(manifest, lambda a: [(a.uri, len(a.blocks), sum(b[1] for b in a.blocks))], "uri string, n_blocks long, n_bytes long")
    starts = running(checkpointed(sizes), [F.col("uri")], {"blocks": "n_blocks", "bytes": "n_bytes"})
    starts = sized_broadcast(checkpointed(starts.select("uri", (F.col("blocks") - F.col("n_blocks")).alias("b0"), (F.col("bytes") - F.col("n_bytes")).alias("r0"))), 100_000)
    blocks = each_archive(manifest, lambda a: ((a.uri, *r) for r in a.rows()), f"uri string, {BLOCK_ROWS}").join(starts, "uri")
    moved = {"block_id": F.col("block_id") + F.col("b0"), "reference_target": F.col("reference_target") + F.col("b0"), "raw_offset": F.col("raw_offset") + F.col("r0")}
    files = each_archive(manifest, lambda a: ((a.uri, e.path, e.kind, e.size, e.content_offset) for e in a.entries), "uri string, path string, kind string, size long, content_offset long")
    files = files.join(starts, "uri").withColumn("content_offset", F.when(F.col("kind") == "file", F.col("content_offset") + F.col("r0")).otherwise(0))
    return blocks.withColumns(moved).drop("b0", "r0", "uri"), files.drop("b0", "r0", "uri")


BANK = "id int, kind string, samples long, sample_bytes long, signature binary, dictionary binary"


def read_bank(manifest: DataFrame) -> DataFrame:
    """The dictionaries of archives, to compress others with: uri, and what content.train_bank() gives."""
    return each_archive(manifest, lambda a: ((a.uri, d.id, d.kind, d.samples, d.sample_bytes, d.signature, d.data) for d in a.dictionaries.values()), f"uri string, {BANK}")


def bank_of(rows: DataFrame) -> Bank:
    """Collects 255 dictionaries at most; more, or equal ids, are an error."""
    rows = rows.select(*[c.strip().split()[0] for c in BANK.split(",")]).limit(256).collect()
    return Bank([Dictionary(r["id"], r["kind"], r["samples"], r["sample_bytes"], bytes(r["signature"]), bytes(r["dictionary"])) for r in sorted(rows)])


def rewritten(a: Archive, payloads: Iterator[bytes], encrypted: bool, salt: bytes) -> Iterator[bytes]:
    """An archive's bytes with other payloads of the same blocks."""
    yield HEADER.pack(HEADER_MAGIC, HEADER_VERSION, a.flags & ~ENCRYPTED | ENCRYPTED * encrypted, salt if encrypted else bytes(16))
    at, table = HEADER.size, []
    for some in together(zip(a.blocks, payloads, strict=True), lambda x: len(x[1])):
        for ((_, raw, check, flags, dictionary), payload), found in zip(some, crc32c([x for _, x in some]).tolist()):
            table.append(DESCRIPTOR.pack(len(payload), raw, check if flags & REFERENCE else found, flags, dictionary))
            at += len(payload)
            yield payload
    (manifest, m_small), (chunks, c_small) = a.packed_manifest, packed(b"".join(table))
    yield manifest + chunks
    yield FOOTER.pack(FOOTER_MAGIC, FOOTER_VERSION, m_small | TABLE_PACKED * c_small, len(table), at, len(manifest), at + len(manifest), len(chunks), 0)


def header_flags(uri: str) -> int | None:
    """The flags in a file's header; None if it isn't an archive."""
    fs, path = open_path(uri)
    with fs.open_input_file(path) as f:
        head = f.read(HEADER.size)
    return HEADER.unpack(head)[2] if len(head) == HEADER.size and head[:4] == HEADER_MAGIC else None


def recode(manifest: DataFrame, folder: str, old: str | None = None, new: str | None = None, salt: bytes = bytes(16)) -> DataFrame:
    """The archives again, their stored blocks decrypted with old and encrypted with new (AES-256-GCM: nonce, content, tag), either of
    which may be None; nothing is compressed anew, and references remain. uri, n_files, n_blocks as write_archives(). Archives that are
    encrypted and old is None, or the other way round, are an error, as is a wrong key. salt goes into the header: keys are the
    caller's. Keys are literals of the plan: who may see plans sees them."""
    data = F.col("payload")
    for key, code in ((old, F.aes_decrypt), (new, F.aes_encrypt)):
        data = data if key is None else F.when(F.length(data) > 0, code(data, F.lit(key), F.lit("GCM"))).otherwise(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (x for b in batches for x in zip(*[b.column(c).to_pylist() for c in ("uri", "block_id", "payload")]))
        for number, (uri, rows) in enumerate(groupby(every, key=lambda r: r[0])):
            a = Archive(uri)
            if a.encrypted != (old is not None):
                raise ValueError(f"{uri}: {'no key for an encrypted archive' if a.encrypted else 'not encrypted'}")
            to = written(folder, rewritten(a, (r[2] for r in rows if r[1] >= 0), new is not None, salt), number)
            yield pa.RecordBatch.from_pydict({"uri": [to], "n_files": [len(a.entries)], "n_blocks": [len(a.blocks)]})

    rows = each_archive(manifest, lambda a: a.payloads(), "uri string, block_id long, payload binary").select("uri", "block_id", data.alias("payload"))
    return kept(rows.mapInArrow(run, "uri string, n_files long, n_blocks long"), folder)  # still in order: nothing is moved


def flags_of(manifest: DataFrame) -> DataFrame:
    """uri, is_archive, encrypted and recovery (whether the archive says that it has recovery data), from the first 24 bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = {uri: header_flags(uri) for uri in batch.column("uri").to_pylist()}
            rows = [{"uri": u, "is_archive": f is not None, "encrypted": bool((f or 0) & ENCRYPTED), "recovery": bool((f or 0) & RECOVERY)} for u, f in flags.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("uri", pa.string()), *((c, pa.bool_()) for c in ("is_archive", "encrypted", "recovery"))]))

    return manifest.select("uri").mapInArrow(run, "uri string, is_archive boolean, encrypted boolean, recovery boolean")


def opens(manifest: DataFrame, key: str) -> DataFrame:
    """uri and opens: whether the key decrypts the archive's first stored block; any does if none is stored, or nothing is encrypted."""
    first = each_archive(manifest, lambda a: ((a.uri, a.encrypted, next((x[2] for x in a.payloads() if x[2]), None)),), "uri string, encrypted boolean, payload binary")
    tried = F.try_aes_decrypt("payload", F.lit(key), F.lit("GCM")).isNotNull()
    return first.select("uri", (~F.col("encrypted") | F.col("payload").isNull() | tried).alias("opens"))


def read_entries(manifest: DataFrame) -> DataFrame:
    return each_archive(manifest, lambda a: ((e.path, e.kind, e.size, e.content_offset) for e in a.entries), "path string, kind string, size long, content_offset long")


def contents(archive: Archive) -> Iterator[tuple[str, bytes]]:
    """Each file's content, put together from the blocks it is in, a block decoded once."""
    held, blocks = bytearray(), archive.decoded(range(len(archive.blocks)))
    for e in archive.entries:
        if e.kind != "file":
            continue
        while len(held) < e.size:
            held += next(blocks)
        yield e.path, bytes(held[: e.size])
        del held[: e.size]


def read_files(manifest: DataFrame) -> DataFrame:
    return each_archive(manifest, contents, "path string, data binary")


def restore(manifest: DataFrame, folder: str) -> DataFrame:
    """Writes the archives' files below the folder, each under its path; path, size and uri of those written. An unsafe path is an error.
    A file is written under its attempt's name and then moved, so that one that is there is whole, whichever attempt wrote it."""

    def write(archive: Archive) -> Iterator[tuple]:
        for path, data in contents(archive):
            if path.startswith("/") or not path or ".." in path.split("/"):
                raise ValueError(f"a path leaves the folder: {path!r}")
            uri = f"{folder.rstrip('/')}/{path}"
            fs, to = open_path(uri)
            fs.create_dir(os.path.dirname(to), recursive=True)
            part = f"{to}.part-{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(part, compression=None) as out:
                out.write(data)
            fs.move(part, to)
            yield path, len(data), uri

    return each_archive(manifest, write, "path string, size long, uri string")


def new_folder(spark: SparkSession) -> str:
    from corpusgrid.plans.scale import shared_folder

    return f"{shared_folder(spark).rstrip('/')}/archives-{os.urandom(8).hex()}"


def to_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgrid.sources.corpus import document_path, read

    docs = read(spark, sf_dir, "documents")
    return docs.select(document_path().alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), (F.col("doc_id") % 17 == 0).alias("force_raw"))


def archived(spark: SparkSession, sf_dir: str, algo: str, block: int = 65_536, bank: DataFrame | None = None) -> DataFrame:
    return write_archives(to_archive(spark, sf_dir), new_folder(spark), block, algo, bank)


def q_archive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block tables of archives of all documents, summed by what the blocks are."""
    b = read_blocks(archived(spark, sf_dir, "zstd")).withColumn("kind", F.when(F.col("reference_target").isNotNull(), "reference").when(F.col("raw_passthrough"), "raw").otherwise("encoded"))
    return b.groupBy("algo", "kind").agg(F.count("*").alias("blocks"), F.sum("raw_len").alias("raw_bytes"), F.sum("encoded_len").alias("encoded_bytes"))


def q_archive_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the block tables of archives that were just written: nothing."""
    from corpusgrid.operators.dedup import layout_violations

    return layout_violations(checkpointed(one_stream(archived(spark, sf_dir, "zstd"))[0]))


def q_archive_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file with content, in archives that were just written: its bytes by what the blocks that hold them are."""
    from corpusgrid.operators.selection import costs_of

    blocks, files = one_stream(archived(spark, sf_dir, "zstd"))
    blocks = checkpointed(blocks.withColumn("block_end", F.col("raw_offset") + F.col("raw_len")))
    c = costs_of(files.withColumn("end", F.col("content_offset") + F.col("size")), blocks)
    return c.select("path", "size", F.expr("lz4_bytes + zstd_bytes + lzma_bytes + reference_bytes").alias("held_bytes"), (F.col("est_bytes") <= F.col("size")).alias("no_larger"))


def q_archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_entries(archived(spark, sf_dir, "lz4")).select("path", "kind", "size")


def q_archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written and restored."""
    return read_files(archived(spark, sf_dir, "zstd")).select("path", F.length("data").cast("long").alias("size"), F.sha2("data", 256).alias("digest"))


def q_archive_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written, encrypted without being compressed anew, decrypted likewise, and restored."""
    from corpusgrid.operators.coding import KEY

    hidden = recode(archived(spark, sf_dir, "zstd"), new_folder(spark), new=KEY)
    return read_files(recode(hidden, new_folder(spark), old=KEY)).select("path", F.length("data").cast("long").alias("size"), F.sha2("data", 256).alias("digest"))


def q_archive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives before and after they are encrypted: what their headers say, and whether the right key and another one open them."""
    from corpusgrid.operators.coding import KEY

    plain = archived(spark, sf_dir, "lz4")
    both = plain.withColumn("state", F.lit("plain")).unionByName(recode(plain, new_folder(spark), new=KEY).withColumn("state", F.lit("encrypted"))).select("uri", "state")
    rows = both.join(flags_of(both), "uri").join(opens(both, KEY), "uri").join(opens(both, KEY[::-1]).withColumnRenamed("opens", "other"), "uri")
    return rows.groupBy("state").agg(F.bool_and("is_archive").alias("archives"), F.bool_and("encrypted").alias("encrypted"), F.bool_or("recovery").alias("recovery"), F.bool_and("opens").alias("right_key"), F.bool_and("other").alias("wrong_key"))


def q_archive_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written with dictionaries trained on them, again with those that one of the archives holds, and restored."""
    from corpusgrid.operators.content import train_bank

    first = archived(spark, sf_dir, "zstd", 4096, train_bank(to_archive(spark, sf_dir)))
    return read_files(archived(spark, sf_dir, "zstd", 4096, read_bank(first.orderBy("uri").limit(1)))).select("path", F.length("data").cast("long").alias("size"), F.sha2("data", 256).alias("digest"))


def q_restore_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written to archives, restored to files, and these scanned as a tree."""
    from corpusgrid.plans.scale import shared_folder
    from corpusgrid.sources.corpus import scan_tree

    folder = f"{shared_folder(spark).rstrip('/')}/restored-{os.urandom(8).hex()}"
    done = restore(archived(spark, sf_dir, "zstd"), folder)
    done.write.parquet(f"{folder}-manifest")
    files = scan_tree(spark, folder, content=True)
    return files.select("path", "size", F.sha2("content", 256).alias("digest"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
