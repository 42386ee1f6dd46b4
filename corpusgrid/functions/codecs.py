"""Vectorised kernels that SQL can't express: content-defined cuts, CRC-32C, Reed-Solomon parity, codecs."""

from __future__ import annotations

import lzma
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

MASK64 = (1 << 64) - 1


def gear_table() -> np.ndarray:
    """The gear of each byte b: splitmix64 of state b + 1."""
    z = (np.arange(1, 257, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


GEAR = gear_table()


def cdc_masks(target: int) -> tuple[int, int]:
    """(mask below the target size, mask from it on): one bit more and one less than log2 of the next power of two."""
    bits = max(target - 1, 0).bit_length()
    ones = lambda n: MASK64 if n >= 63 else (1 << n) - 1
    return ones(min(bits + 1, 63)), ones(max(bits - 1, 1))


@dataclass(frozen=True)
class ChunkPolicy:
    """Least, wanted and largest chunk; a superchunk, at whose multiples a chunk always ends, is 8 largest chunks."""

    least: int
    target: int
    most: int

    @classmethod
    def fixed(cls, target: int) -> ChunkPolicy:
        return cls.cdc(target, target, target)

    @classmethod
    def cdc(cls, least: int, target: int, most: int) -> ChunkPolicy:
        """Sizes are at least 1, and each at least the one before."""
        least = max(1, least)
        target = max(least, target)
        return cls(least, target, max(target, most))

    @classmethod
    def cdc_for_target(cls, target: int) -> ChunkPolicy:
        return cls.cdc(target // 4, target, target * 2)

    @property
    def superchunk(self) -> int:
        return 8 * self.most


def cdc_lengths(texts: list[bytes], least: int, target: int, most: int, starts: np.ndarray | None = None) -> list[np.ndarray]:
    """Chunk lengths of each byte string. No chunk crosses a multiple of the superchunk, 8 times the largest chunk, and the hash
    starts anew there; so all superchunks of all strings are scanned side by side, a byte of each at a time. starts: where in its
    superchunk each string begins, which it then must not leave; 0 if not given."""
    span, lens = 8 * most, np.fromiter(map(len, texts), np.int64, len(texts))
    pieces = -(-lens // span)
    owner = np.repeat(np.arange(len(texts)), pieces)
    inside = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * span
    size_of = np.minimum(span, lens[owner] - inside)
    order = np.argsort(-size_of, kind="stable")  # so that those still running are a prefix
    owner, inside, size_of = owner[order], inside[order], size_of[order]
    flat, at = np.frombuffer(b"".join(texts), np.uint8), (np.cumsum(lens) - lens)[owner] + inside
    short, long_ = (np.uint64(m) for m in cdc_masks(target))
    n = len(owner)
    h, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    phase = np.zeros(n, np.int64) if starts is None else np.asarray(starts, np.int64)[owner]
    limit = np.minimum(most, span - phase)
    norm = np.minimum(np.maximum(target, np.minimum(least, limit)), limit)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    one, rest = np.uint64(1), np.uint64(63)
    upto = n - np.searchsorted(size_of[::-1], np.arange(int(size_of[0]) if n else 0), "right")  # lanes longer than each step
    for step, running in enumerate(upto.tolist()):
        hs, ss = h[:running], size[:running]
        hs[:] = ((hs << one) | (hs >> rest)) + GEAR[flat[at[:running] + step]]
        ss += 1
        cut = ss >= limit[:running]
        ripe = np.flatnonzero(ss >= least)
        if len(ripe):
            cut[ripe] |= (hs[ripe] & np.where(ss[ripe] < norm[ripe], short, long_)) == 0
        cut = np.flatnonzero(cut)
        if len(cut):
            found.append((cut, np.full(len(cut), step + 1), ss[cut]))
            hs[cut] = 0
            ss[cut] = 0
            limit[cut] = np.minimum(most, span - (phase[cut] + step + 1) % span)
            norm[cut] = np.minimum(np.maximum(target, np.minimum(least, limit[cut])), limit[cut])
    left = np.flatnonzero(size)  # what is left at the end of a string
    found.append((left, size_of[left], size[left]))
    lane, end, length = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((inside[lane] + end, owner[lane]))
    cuts = np.searchsorted(owner[lane][order], np.arange(len(texts) + 1))
    return [length[order[a:b]] for a, b in zip(cuts, cuts[1:])]


def crc_table() -> np.ndarray:
    """CRC-32C (Castagnoli, reflected polynomial 0x82F63B78) of each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0x82F63B78), c >> np.uint32(1))
    return c


CRC = crc_table()
LANE = 1024


def zeros_operator(n: int) -> np.ndarray:
    """Tables, one for each byte of a CRC register, that pass it over n zero bytes."""
    basis = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    for _ in range(n):
        basis = CRC[basis & np.uint32(255)] ^ (basis >> np.uint32(8))
    values = np.arange(256)
    return np.array([np.bitwise_xor.reduce(np.where((values[:, None] >> np.arange(8)) & 1, basis[8 * k : 8 * k + 8], 0).astype(np.uint32), axis=1) for k in range(4)])


OVER_LANE = zeros_operator(LANE)


def crc32c(blocks: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string. Strings are cut into lanes, counted from their end; all lanes are scanned side by side and
    joined by the operator that passes a register over a lane of zeros."""
    out = np.zeros(len(blocks), np.uint32)
    lanes, owner = [], []
    for i, b in enumerate(blocks):
        if len(b) < 4:
            c = 0xFFFFFFFF
            for x in b:
                c = int(CRC[(c ^ x) & 255]) ^ (c >> 8)
            out[i] = c ^ 0xFFFFFFFF
            continue
        b = bytes(x ^ 255 for x in b[:4]) + b[4:]  # stands for the register's first value, all ones
        b = bytes(-len(b) % LANE) + b
        lanes.append(np.frombuffer(b, np.uint8).reshape(-1, LANE))
        owner.append((i, len(b) // LANE))
    if lanes:
        data = np.ascontiguousarray(np.concatenate(lanes).T)
        c = np.zeros(data.shape[1], np.uint32)
        for row in data:
            c = CRC[(c ^ row) & np.uint32(255)] ^ (c >> np.uint32(8))
        at = 0
        for i, n in owner:
            r = c[at]
            for x in c[at + 1 : at + n]:
                r = OVER_LANE[0][r & 255] ^ OVER_LANE[1][(r >> 8) & 255] ^ OVER_LANE[2][(r >> 16) & 255] ^ OVER_LANE[3][r >> 24] ^ x
            out[i] = r ^ np.uint32(0xFFFFFFFF)
            at += n
    return out


def field() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms of 2 in GF(256) with polynomial 0x11D."""
    exp, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = (x << 1) ^ (0x11D if x & 128 else 0)
    return exp, log


EXP, LOG = field()


def gf_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]])


def gf_matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((a.shape[0], b.shape[1]), np.int64)
    for k in range(a.shape[1]):
        out ^= gf_mul(a[:, k : k + 1], b[k : k + 1])
    return out


def gf_inverse(m: np.ndarray) -> np.ndarray:
    n = len(m)
    work = np.concatenate([m.astype(np.int64), np.eye(n, dtype=np.int64)], axis=1)
    for i in range(n):
        p = i + int(np.flatnonzero(work[i:, i])[0])
        work[[i, p]] = work[[p, i]]
        work[i] = gf_mul(work[i], EXP[255 - LOG[work[i, i]]])
        for j in range(n):
            if j != i and work[j, i]:
                work[j] ^= gf_mul(work[j, i], work[i])
    return work[:, n:]


@lru_cache(256)
def rs_matrix(data: int, parity: int) -> np.ndarray:
    """Systematic coding matrix: a Vandermonde matrix of powers of the row numbers, times the inverse of its top."""
    rows, powers = np.arange(data + parity), []
    col = np.ones(data + parity, np.int64)
    for _ in range(data):
        powers.append(col)
        col = gf_mul(col, rows)
    v = np.stack(powers, axis=1)
    out = gf_matmul(v, gf_inverse(v[:data]))
    out.setflags(write=False)  # it is shared
    return out


def rs_parity(shards: np.ndarray, parity: int) -> np.ndarray:
    """Parity shards of data shards, all of one length."""
    return gf_matmul(rs_matrix(len(shards), parity)[len(shards) :], shards.astype(np.int64)).astype(np.uint8)


def rs_repair(shards: dict[int, np.ndarray], data: int, parity: int) -> np.ndarray:
    """The data shards, from any `data` of all shards, by number. As many parity shards as data shards are missing give equations for
    these alone; the others are known."""
    if len(shards) < data:
        raise ValueError("more shards are missing than parity covers")
    known, lost = ([i for i in range(data) if (i in shards) is there] for there in (True, False))
    spare = [i for i in sorted(shards) if i >= data][: len(lost)]
    out = dict(shards)
    if lost:
        rows = rs_matrix(data, parity)[spare]
        sums = np.stack([shards[i] for i in spare]).astype(np.int64)
        if known:
            sums = sums ^ gf_matmul(rows[:, known], np.stack([shards[i] for i in known]).astype(np.int64))
        out |= dict(zip(lost, gf_matmul(gf_inverse(rows[:, lost]), sums).astype(np.uint8)))
    return np.stack([out[i] for i in range(data)]).astype(np.uint8)


def compressed_size(algo: str, level: int | None, data: bytes) -> int:
    """Bytes of data under a codec: lz4 blocks with a size prefix, zstd frames, xz streams without check."""
    if algo == "lz4":
        return 4 + pa.Codec("lz4_raw").compress(data).size if data else 5
    if algo == "zstd":
        return len(zstandard.ZstdCompressor(level=level or 3).compress(data))
    if algo == "lzma":
        return len(lzma.compress(data, format=lzma.FORMAT_XZ, check=lzma.CHECK_NONE, preset=level or 6))
    raise ValueError(f"unknown codec {algo!r}")
