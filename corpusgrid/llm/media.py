"""Media columns: WAV payloads, short-time Fourier transforms, and spectral-peak pair fingerprints as time-coded arrays."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.llm.bpe import extended
from corpusgrid.llm.common import documents, table

#: Samples a second, transform length, step, and the tile (frames by bins) that gives one peak.
RATE, N_FFT, HOP, TILE_FRAMES, TILE_BINS = 8000, 256, 128, 8, 32
#: Each peak is paired with so many that follow it.
FAN = 3
#: Samples transformed at once, a whole number of tiles.
SPAN = HOP * TILE_FRAMES * 512


def to_wav(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit mono samples of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV file; another form is an error."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the strongest bin in each tile of the magnitude spectrogram, by frame, then bin; silent tiles have none.
    Long signals are transformed a span at a time, so memory doesn't grow with their length."""
    window = np.hanning(N_FFT).astype(np.float32)
    frames, bins = [], []
    for at in range(0, len(samples), SPAN):
        x = samples[at : at + SPAN + N_FFT - HOP].astype(np.float32) - 128
        n = max(1, -(-min(len(samples) - at, SPAN) // HOP))
        n += -n % TILE_FRAMES
        x = np.pad(x, (0, (n - 1) * HOP + N_FFT - len(x)))
        view = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP][:n]
        mag = np.abs(np.fft.rfft(view * window, axis=1)[:, 1 : N_FFT // 2 + 1])
        tiles = mag.reshape(n // TILE_FRAMES, TILE_FRAMES, -1, TILE_BINS).transpose(0, 2, 1, 3).reshape(n // TILE_FRAMES, -1, TILE_FRAMES * TILE_BINS)
        best = tiles.argmax(axis=2)
        t, band = np.nonzero(np.take_along_axis(tiles, best[:, :, None], 2)[:, :, 0] > 1e-3)
        frames.append(at // HOP + t * TILE_FRAMES + best[t, band] // TILE_BINS)
        bins.append(band * TILE_BINS + best[t, band] % TILE_BINS)
    f, b = np.concatenate(frames), np.concatenate(bins)
    order = np.lexsort((b, f))
    return f[order], b[order]


def pair_codes(frame: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Time-coded pairs: the anchor's frame above 32 bits of (its bin, the partner's bin, frames between), ascending."""
    out = [frame[:-k] << 32 | freq[:-k] << 24 | freq[k:] << 16 | np.minimum(frame[k:] - frame[:-k], 65_535) for k in range(1, FAN + 1) if len(frame) > k]
    return np.sort(np.concatenate(out)).astype(np.int64) if out else np.empty(0, np.int64)


MEDIA = T.StructField("media", T.BinaryType())
FEATURES = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType(), False))]


def media_of(texts: list[str | None]) -> list[bytes]:
    raw = [(t or "").encode() for t in texts]
    return [to_wav(b + bytes(-len(b) % 64 if b else 64)) for b in raw]


def features_of(media: list[bytes | None]) -> list[pa.Array]:
    """The columns of FEATURES. Null media has nulls and no pairs."""
    rows, pairs = [], []
    for m in media:
        if m is None:
            rows.append((None,) * 6)
            pairs.append(np.empty(0, np.int64))
            continue
        p = from_wav(m)
        codes = pair_codes(*peaks(np.frombuffer(p, np.uint8))) if p else np.empty(0, np.int64)
        rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"{len(codes)}:{xxhash.xxh3_128_hexdigest(codes.astype('<i8').tobytes())}"))
        pairs.append(codes)
    offsets = np.zeros(len(pairs) + 1, np.int32)
    np.cumsum([len(p) for p in pairs], out=offsets[1:])
    listed = pa.ListArray.from_arrays(offsets, np.concatenate(pairs) if pairs else np.empty(0, np.int64))
    return [*[pa.array(c, f.dataType.typeName() == "string" and pa.string() or pa.int64()) for c, f in zip(zip(*rows), FEATURES)], listed]


def store_media(df: DataFrame, text: str = "text") -> DataFrame:
    """df with media: each whole text's UTF-8 bytes, zeros appended up to a positive multiple of 64, as a WAV file. Null is the
    empty text: 64 zeros."""
    return extended(df, [MEDIA], lambda part: [pa.array(media_of(part.column(text).to_pylist()), pa.binary())], text)


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the columns of FEATURES, from the stored bytes alone: equal media, equal values. Columns so named are replaced."""
    return extended(df, FEATURES, lambda part: features_of(part.column(media).to_pylist()), media)


def store_and_read(df: DataFrame, text: str = "text") -> DataFrame:
    """store_media and media_features in one pass over the rows."""

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        media = media_of(part.column(text).to_pylist())
        return [pa.array(media, pa.binary()), *features_of(media)]

    return extended(df, [MEDIA, *FEATURES], fn, text)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a stored WAV payload, read back, with its fingerprint."""
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    stored = table(store_media(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", n, "media"), "media")
    return media_features(stored).select("doc_id", "n_bytes", *[f.name for f in FEATURES])
