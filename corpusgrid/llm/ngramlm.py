"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, broadcast; probabilities by repeated membership probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.llm.common import HELD, LOWER, bounded, documents, gathered, open_store, scratch, slices, table, take_turn, text_of, write_once
from corpusgrid.llm.langid import fold
from corpusgrid.llm.neardup import mixed

#: The end of a text is a token of its own; no word has a space.
END = xxhash.xxh64_intdigest(b" end")
#: Bits of the filter for each (n-gram, level) and probes of each.
BITS, PROBES = 10, 5
#: Of a filter that is too large to be broadcast: bytes of a part, of the texts that ask at once, and of what one task asks of a part.
PART, HELD_TEXT, ASKED = 64 << 20, 8 << 20, 256 << 20
#: The weight of the bigrams is a multiple of 1 / STEPS below 1.
STEPS = 1 << 12
WORD_HASH: dict[bytes, int] = {}
HELD[__name__] = WORD_HASH.clear


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words (ASCII white space apart, A-Z lower-cased), then END."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(WORD_HASH) > 200_000:
        WORD_HASH.clear()
    for w in words:
        if w not in WORD_HASH:
            WORD_HASH[w] = xxhash.xxh64_intdigest(w)
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def bigram_hashes(tokens: np.ndarray) -> np.ndarray:
    """Of each token with the one before; before the first: END."""
    before = np.empty_like(tokens)
    before[0], before[1:] = END, tokens[:-1]
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def short(keys: np.ndarray) -> np.ndarray:
    """The 48 bits by which the filter knows an n-gram."""
    return keys >> np.uint64(16)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray, width: int) -> bytes:
    """Keys as little-endian integers of so many bytes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


#: Bytes of a key: unigrams are counted by all 64 bits, bigrams by the 48 that the filter sees.
WIDTH = {1: 8, 2: 6}
COUNTS = "kind long, bucket long, keys binary, counts binary"


def blobs(kind: int, keys: np.ndarray, n: int) -> Iterator[tuple]:
    """Counted keys as a row a bucket. Keys: whole hashes; a bucket is a range of them."""
    if kind == 2:
        keys = short(keys) << np.uint64(16)
    keys, counts = np.unique(keys, return_counts=True)
    cuts = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    stored = short(keys) if kind == 2 else keys
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[b], cuts[b + 1])
        yield kind, b, packed(stored[part], WIDTH[kind]), packed(counts[part], 4)


def arrow(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def count_ngrams(df: DataFrame, text: str, n_buckets: int, least: dict[int, int], flush: int = 3_000_000) -> DataFrame:
    """kind (1: words, 2: bigrams), bucket, and the bucket's ascending keys and counts as bytes, over all texts of df. Tasks count
    before anything moves; a bucket is a range of hashes, so none is hot. Bigrams rarer than least[2] aren't kept."""
    kinds, names = [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["kind", "bucket", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(__name__)
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "t"):
                for t in part.column("t").to_pylist():
                    held.append(token_hashes(t))
                    size += len(held[-1])
                    if size >= flush:
                        yield counted(held)
                        held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate([bigram_hashes(t) for t in held])
        return arrow([*blobs(1, np.concatenate(held), n_buckets), *blobs(2, pairs, n_buckets)], kinds, names)

    def merge(rows: pa.Table) -> pa.Table:
        kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
        keys = np.concatenate([unpacked(x, WIDTH[kind]) for x in rows.column("keys").to_pylist()])
        counts = np.concatenate([unpacked(x, 4) for x in rows.column("counts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.add.reduceat(counts[order], heads)
        keep = total >= least[kind]
        return pa.table({"kind": [kind], "bucket": [bucket], "keys": [packed(keys[heads][keep], WIDTH[kind])], "counts": [packed(total[keep], 6)]}, pa.schema(list(zip(names, kinds))))

    rows = bounded(df.select(text_of(text).alias("t"))).mapInArrow(run, COUNTS)
    return table(rows.groupBy("kind", "bucket").applyInArrow(merge, COUNTS), "counts")


def histogram(counts: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(kind, floor of log2 of the count) to (n-grams, their occurrences): some tens of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("counts").to_pylist()):
                c = unpacked(data, 6)
                log = np.frexp(c.astype(np.float64))[1] - 1
                rows = [(kind, int(x), int((log == x).sum()), int(c[log == x].sum())) for x in np.unique(log)]
                if rows:
                    yield arrow(rows, [pa.int64()] * 4, ["kind", "log", "n", "total"])

    rows = counts.select("kind", "counts").mapInArrow(run, "kind long, log long, n long, total long")
    return {(r["kind"], r["log"]): (r["n"], r["t"]) for r in rows.groupBy("kind", "log").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).collect()}


def levels(counts: np.ndarray, least: int) -> np.ndarray:
    """Quantised counts: 1 for least, one more for each doubling."""
    return np.frexp(counts.astype(np.float64) / least)[1]


def expected(level: np.ndarray, least: int) -> np.ndarray:
    """The geometric middle of the counts of a level, 1 for a level that holds 1 alone; 0 for level 0."""
    low = least * np.exp2(np.maximum(level, 1) - 1.0)
    return np.where(level > 0, np.sqrt(low * np.maximum(2 * low - 1, 1)), 0.0)


def seeds(kind: int, keys48: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the probes of (n-gram, level)."""
    h = mixed(keys48 * np.uint64(4) + np.uint64(kind) + mixed(np.full(1, level, np.uint64)))
    return h, mixed(h) | np.uint64(1)


def place(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def set_bits(out: np.ndarray, kind: int, keys48: np.ndarray, counts: np.ndarray, least: int) -> None:
    """Enters each n-gram with all levels up to its own; those rarer than least have none."""
    level = levels(counts, least)
    for i in range(1, int(level.max(initial=0)) + 1):
        h, step = seeds(kind, keys48[level >= i], i)
        for _ in range(PROBES):
            out[place(h, len(out))] = True
            h = h + step


class Filter:
    """The whole filter: so many bits a bucket, all in data, or in a file for each run of `each` buckets (those without n-grams have
    none)."""

    def __init__(self, data: np.ndarray | None, bits: int, n: int, least: dict[int, int], files: dict[int, str] | None = None, each: int = 0):
        self.data, self.bits, self.n, self.least, self.files, self.each = data, bits, n, least, files, each

    def __len__(self) -> int:
        """The number of parts."""
        return -(-self.n // self.each) if self.files is not None else 1

    def part(self, i: int) -> np.ndarray | None:
        """The bits of a part; none of a part without n-grams."""
        if self.files is None:
            return self.data
        if i not in self.files:
            return None
        fs, path = open_store(self.files[i])
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), np.uint8)

    def probe(self, kind: int, k48: np.ndarray, first: int, data: np.ndarray | None) -> np.ndarray:
        """The levels of n-grams in data, the bits from bucket `first` on: levels are probed one after another until one isn't there."""
        level, i = np.zeros(len(k48), np.int64), 0
        at = np.arange(len(k48)) if data is not None else np.empty(0, np.int64)
        base = (bucket_of(k48 << np.uint64(16), self.n) - first) * self.bits
        while len(at) and i < 62:  # no count has more levels
            i += 1
            h, step = seeds(kind, k48[at], i)
            for _ in range(PROBES):
                bit = base[at] + place(h, self.bits)
                hit = (data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                at, step = at[hit], step[hit]
                h = h[hit] + step
            level[at] = i
        return level

    def lookup(self, asked: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """Levels for each (kind, hashes of n-grams), of a filter in memory."""
        return [self.probe(kind, short(keys), 0, self.data) for kind, keys in asked]

    def counts(self, kind: int, keys: np.ndarray) -> np.ndarray:
        return expected(self.lookup([(kind, keys)])[0], self.least[kind])


def entries(hist: dict, kind: int, log: int) -> int:
    """(n-gram, level) pairs of n-grams with counts of at least 2**log."""
    return sum(n * (x - log + 1) for (k, x), (n, _) in hist.items() if k == kind and x >= log)


def filter_bytes(hist: dict, logs: dict[int, int]) -> int:
    """Of a filter of the n-grams with counts of at least 2**logs[kind]."""
    return sum(entries(hist, k, x) for k, x in logs.items()) * BITS // 8


def filled(counts: DataFrame, n_bytes: int, n_buckets: int, least: dict[int, int]) -> tuple[int, DataFrame]:
    """Bits of a bucket, and (bucket, bits) of those that have n-grams."""
    bits = 64 * (1 + n_bytes * 8 * 11 // 10 // n_buckets // 64)

    def part(rows: pa.Table) -> pa.Table:
        out = np.zeros(bits, bool)
        for kind, keys, c in zip(*[rows.column(x).to_pylist() for x in ("kind", "keys", "counts")]):
            keys, c = unpacked(keys, WIDTH[kind]), unpacked(c, 6)
            set_bits(out, kind, short(keys) if kind == 1 else keys, c, least[kind])
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    return bits, counts.groupBy("bucket").applyInArrow(part, "bucket long, bits binary")


def build_filter(counts: DataFrame, hist: dict, n_buckets: int, max_bytes: int) -> Filter:
    """The filter of the counted n-grams in memory, at most max_bytes large. If it would be larger, n-grams below the least power of
    two at which it fits aren't entered, bigrams first; score() then takes filter_in_parts() instead, which leaves none out."""
    logs = {1: 0, 2: 1}
    while filter_bytes(hist, logs) > max_bytes:
        logs[2 if entries(hist, 2, logs[2]) >= entries(hist, 1, logs[1]) else 1] += 1
    least = {k: 1 << x for k, x in logs.items()}
    bits, rows = filled(counts, filter_bytes(hist, logs), n_buckets, least)
    data = np.zeros(n_buckets * bits // 8, np.uint8)
    for r in rows.toLocalIterator():  # max_bytes in all
        data[r["bucket"] * bits // 8 : (r["bucket"] + 1) * bits // 8] = np.frombuffer(r["bits"], np.uint8)
    return Filter(data, bits, n_buckets, least)


def filter_in_parts(counts: DataFrame, hist: dict, n_buckets: int) -> Filter:
    """The filter of all counted n-grams, of any size, in files of about PART bytes in the shared folder: the same bits as in memory.
    The driver and the workers know the files' names alone."""
    least = {1: 1, 2: 2}
    bits, rows = filled(counts, filter_bytes(hist, {1: 0, 2: 1}), n_buckets, least)
    each, folder = max(1, PART * 8 // bits), scratch(counts.sparkSession, "filter")

    def stored(rows: pa.Table) -> pa.Table:
        i = rows.column("part")[0].as_py()
        data = np.zeros(each * bits // 8, np.uint8)
        for b, some in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
            at = (b - i * each) * bits // 8
            data[at : at + bits // 8] = np.frombuffer(some, np.uint8)
        uri = f"{folder}/{i:06d}-{TaskContext.get().taskAttemptId()}.bits"
        write_once(uri, [data.tobytes()])
        return pa.table({"part": pa.array([i], pa.int64()), "uri": [uri]})

    rows = table(rows, "filter").withColumn("part", F.floor(F.col("bucket") / each))
    files = table(rows.groupBy("part").applyInArrow(stored, "part long, uri string"), "files").collect()
    return Filter(None, bits, n_buckets, least, {r["part"]: r["uri"] for r in sorted(files)}, each)


def word_counts(counts: DataFrame, least: int | None, below: int | None) -> DataFrame:
    """(h, c) of the words counted at least `least` times, or fewer than `below` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, data in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                h, c = unpacked(keys, 8), unpacked(data, 6)
                keep = (c >= (least or 0)) & (c < (below or 1 << 62))
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], ["h", "c"])

    return counts.where("kind = 1").select("keys", "counts").mapInArrow(run, "h long, c long")


def mass(hist: dict, least: int) -> float:
    """What (c + 1) sums to over all words, by their counts in the filter, and 1 for the words not seen: so that probabilities of words sum to 1."""
    total = 1.0
    for (kind, log), (n, _) in hist.items():
        if kind == 1:
            level = np.maximum(log - (least.bit_length() - 1) + 1, 0)
            total += n * (float(expected(np.array(level), least)) + 1)
    return total


class Tokens:
    """Some texts as arrays: of each token its place among the distinct words and bigrams, whose hashes ascend."""

    def __init__(self, texts: list[str | None]):
        parts = [token_hashes(t) for t in texts]
        self.n = np.array([len(p) for p in parts])
        self.heads = np.cumsum(self.n) - self.n
        self.words, self.which = np.unique(np.concatenate(parts), return_inverse=True)
        self.pairs, self.pair = np.unique(np.concatenate([bigram_hashes(p) for p in parts]), return_inverse=True)
        self.end = int(np.searchsorted(self.words, np.uint64(END)))


#: Bits of a level in an evidence code: no count has more levels than 62.
LEVEL = 6


def evidence(n: np.ndarray, which: np.ndarray, pair: np.ndarray, end: int, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the filter says of texts of n tokens each, given the levels of their distinct words and bigrams: the distinct codes of each
    text's tokens (levels of the word, of the one before, of both together), how often each occurs, and where each text's begin."""
    before = np.empty_like(which)
    before[1:] = which[:-1]
    before[np.cumsum(n) - n] = end
    code = one[which] | one[before] << LEVEL | two[pair] << 2 * LEVEL
    found, times = np.unique(np.repeat(np.arange(len(n)), n) << 3 * LEVEL | code, return_counts=True)
    return found & ((1 << 3 * LEVEL) - 1), times, np.searchsorted(found >> 3 * LEVEL, np.arange(len(n) + 1))


def counts_of(codes: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts that evidence codes stand for: of the word, of the one before, and of both, which neither alone is rarer than."""
    low = (1 << LEVEL) - 1
    one, first = expected(codes & low, least[1]), expected(codes >> LEVEL & low, least[1])
    return one, first, np.minimum(expected(codes >> 2 * LEVEL, least[2]), np.minimum(one, first))


def best_weights(codes: np.ndarray, times: np.ndarray, cuts: np.ndarray, least: dict[int, int], unit: float) -> np.ndarray:
    """Of each text the weight of the bigram estimate, in STEPS, that makes it most likely, each token's own occurrence taken out of
    its bigram's counts: where the derivative of the log-likelihood, which falls as the weight grows, is positive for the last time."""
    one, first, both = counts_of(codes, least)
    more = np.maximum(both - 1, 0) / np.maximum(first - 1, 1) * unit / (one + 1) - 1
    k, step = np.zeros(len(cuts) - 1, np.int64), STEPS
    while step := step // 2:
        to = k + step
        slope = np.add.reduceat(times * more / (1 + np.repeat(to / STEPS, np.diff(cuts)) * more), cuts[:-1])
        k = np.where(slope > 0, to, k)
    return k


def median_weight(rows: DataFrame) -> float:
    """The median of the best weights k of all training texts, each a row; not that of all tokens together, as texts with copies in
    the training texts have all their bigrams there. At most STEPS rows are collected."""
    rows = rows.groupBy("k").agg(F.count("*").alias("n")).collect()
    half, seen = sum(r["n"] for r in rows) / 2, 0
    for r in sorted(rows):
        seen += r["n"]
        if seen >= half:
            return r["k"] / STEPS
    return 0.0


def lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(values))


def rare_words(tokens: Tokens, known: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Of each text the hashes of its distinct words that aren't known, and how often each occurs there."""
    size, at = len(tokens.words), np.flatnonzero(~known[tokens.which])
    rare, times = np.unique(np.repeat(np.arange(len(tokens.n)), tokens.n)[at] * size + tokens.which[at], return_counts=True)
    cuts = np.searchsorted(rare // size, np.arange(len(tokens.n) + 1))
    return lists(tokens.words[rare % size].view(np.int64), cuts), lists(times.astype(np.int32), cuts)


#: What is known of a text before its score: codes, n and k as in evidence() and best_weights().
CODES = "codes array<int>, n array<int>, k long"


def evidence_of(df: DataFrame, text: str, key: str, shared, unit: float, total: float) -> DataFrame:
    """row, id, n_tokens, known, base, words, times (those of the frequent words, and the words that aren't), codes, n and k of each row
    of df, written to the shared folder. shared: the broadcast (hashes and counts of the frequent words, the filter). One pass over the texts;
    if the filter isn't in the broadcast, the texts' distinct n-grams are dealt to its parts and the levels come back."""
    id_kind, whole = df.schema[key].dataType.simpleString(), shared.value[2].files is None
    doc_rows = f"row long, id {id_kind}, n_tokens long, known long, base double, words array<long>, times array<int>"

    def of_slice(part: pa.RecordBatch, row: int) -> tuple[Tokens, list[pa.Array]]:
        hs, cs, _ = shared.value
        tokens, c = Tokens(part.column("t").to_pylist()), 0
        if len(hs):
            at = np.minimum(np.searchsorted(hs, tokens.words), len(hs) - 1)
            c = np.where(hs[at] == tokens.words, cs[at], 0)
        c = np.zeros(len(tokens.words), np.int64) + c
        sums = lambda x: np.add.reduceat(x[tokens.which], tokens.heads)
        found = [sums((c > 0).astype(np.int64)), sums(np.where(c > 0, np.log10((c + 1) / unit), 0.0))]
        rows = np.arange(row, row + len(tokens.n))
        return tokens, [pa.array(rows), part.column("id"), *map(pa.array, (tokens.n, *found)), *rare_words(tokens, c > 0)]

    def codes_of(n: np.ndarray, which: np.ndarray, pair: np.ndarray, end: int, one: np.ndarray, two: np.ndarray) -> list[pa.Array]:
        codes, times, cuts = evidence(n, which, pair, end, one, two)
        k = best_weights(codes, times, cuts, shared.value[2].least, total)
        return [lists(codes.astype(np.int32), cuts), lists(times.astype(np.int32), cuts), pa.array(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(__name__)
        bloom, row = shared.value[2], TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "t"):
                tokens, docs = of_slice(part, row)
                row += len(tokens.n)
                levels = bloom.lookup([(1, tokens.words), (2, tokens.pairs)])
                yield pa.RecordBatch.from_arrays([*docs, *codes_of(tokens.n, tokens.which, tokens.pair, tokens.end, *levels)], names)

    names = ["row", "id", "n_tokens", "known", "base", "words", "times", "codes", "n", "k"]
    texts = df.select(F.col(key).alias("id"), text_of(text).alias("t"))
    if whole:
        return table(bounded(texts).mapInArrow(run, f"{doc_rows}, {CODES}"), "scored")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text, one a slice (its tokens' places), and one for each part of the filter that the slice's n-grams are in."""
        take_turn(__name__)
        bloom, start = shared.value[2], TaskContext.get().partitionId() << 36
        row, number = start, start
        for part in gathered(batches, "t", HELD_TEXT):
            tokens, docs = of_slice(part, row)
            yield padded([pa.nulls(len(docs[0]), pa.int64())] * 2 + [pa.nulls(len(docs[0]), pa.binary())] * 3 + docs)
            asks, cuts = [], []
            for keys in (tokens.words, tokens.pairs):
                keys = short(keys)
                cuts.append(np.searchsorted(bucket_of(keys << np.uint64(16), bloom.n) // bloom.each, np.arange(len(bloom) + 1)))
                asks.append(keys)
            here = np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)).tolist()
            a, b = ([packed(keys[c[i] : c[i + 1]], 6) for i in here] for keys, c in zip(asks, cuts))
            places = [np.array([row, tokens.end, *tokens.n], "<i8"), tokens.which.astype("<i4"), tokens.pair.astype("<i4")]
            blobs = [[places[0].tobytes()] + [None] * len(here), [places[1].tobytes(), *a], [places[2].tobytes(), *b]]
            head = [pa.array([number] * (1 + len(here)), pa.int64()), pa.array([None, *here], pa.int64()), *[pa.array(x, pa.binary()) for x in blobs]]
            yield padded(head + [pa.nulls(1 + len(here), x.type) for x in docs])
            row, number = row + len(tokens.n), number + 1

    def padded(columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, ["slice", "part", "places", "a", "b", *names[:7]])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The levels of the n-grams asked for. Rows come in order of the part, so that each is read once a task."""
        take_turn(__name__)
        bloom, at, data = shared.value[2], None, None
        for batch in batches:
            out = []
            for i, a, b in zip(*[batch.column(c).to_pylist() for c in ("part", "a", "b")]):
                if i != at:
                    at, data = i, bloom.part(i)
                out.append([bloom.probe(kind, unpacked(x, 6), i * bloom.each, data).astype(np.uint8).tobytes() for kind, x in ((1, a), (2, b))])
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("part"), *[pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)]], ["slice", "part", "a", "b"])

    def answered(places: pa.Table, replies: pa.Table) -> pa.Table:
        """Of a slice, the codes of its texts. Parts are ranges of hashes, so their levels follow one another as the n-grams do."""
        order = np.argsort(replies.column("part").to_numpy())
        one, two = (np.frombuffer(b"".join(replies.column(c).take(pa.array(order)).to_pylist()), np.uint8).astype(np.int64) for c in ("a", "b"))
        head = np.frombuffer(places.column("places")[0].as_py(), "<i8")
        which, pair = (np.frombuffer(places.column(c)[0].as_py(), "<i4").astype(np.int64) for c in ("a", "b"))
        rows = np.arange(head[0], head[0] + len(head) - 2)
        return pa.Table.from_arrays([pa.array(rows), *codes_of(head[2:], which, pair, int(head[1]), one, two)], ["row", "codes", "n", "k"])

    every = table(bounded(texts).mapInArrow(ask, f"slice long, part long, places binary, a binary, b binary, {doc_rows}"), "asked")
    asks = every.where("part is not null").select("slice", "part", "a", "b")
    size = asks.agg(F.sum(F.length("a") + F.length("b")).alias("size")).first()["size"] or 0
    salt = F.col("slice") % max(1, size // len(shared.value[2]) // ASKED)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    replies = bounded(asks.withColumn("salt", salt).repartition(n, "part", "salt").sortWithinPartitions("part").drop("salt")).mapInArrow(probe, "slice long, part long, a binary, b binary")
    places = every.where("slice is not null and part is null").select("slice", "places", "a", "b")
    found = places.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(answered, f"row long, {CODES}")
    return table(every.where("slice is null").select(*names[:7]).join(found, "row"), "scored")


def score(df: DataFrame, train: DataFrame | Column, text: str = "text", key: str = "doc_id", max_filter_mb: int = 64, head_words: int = 500_000) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of each row of df, by the model of all texts of train: a DataFrame,
    or a condition on df's rows, whose texts are then read once less.

    All words of train are counted, and all bigrams; those seen once, at any size of the corpus, aren't in the model, as all that is known
    of them is one text's own occurrence. The counts, quantised by powers of two, fill a Bloom filter that grows with them. Up to
    max_filter_mb it is broadcast; beyond, it lies in parts in the shared folder: the distinct n-grams of some MB of texts at once are
    dealt to its parts, and their levels back to the texts, with the same scores. What that shuffles grows with the texts alone.

    score sums log10 of w * c(v x) / c(v) + (1 - w) * p(x) over the tokens x, all counts from the filter; v is the token before, END
    before the first; p(x) is (c(x) + 1) over what that sums to; the weight w is estimated on all texts of train, of any length.
    base_score needs exact counts: those of frequent words, at most head_words of them, are broadcast; the others' occurrences
    meet their counts by a join on the word, which has no hot key, for no word in it is frequent. Repeated and null ids are kept
    apart. A null text is empty: its end alone. Without training texts N and V are 0 and both scores are those of the smoothing."""
    spark, inside = df.sparkSession, isinstance(train, Column)
    texts = df.where(train) if inside else train
    n_buckets = min(1 << 20, max(64, texts.count() // 2000))
    counts = count_ngrams(texts, text, n_buckets, {1: 1, 2: 2})
    hist = histogram(counts)
    n_train, n_words = (sum(v[i] for (k, _), v in hist.items() if k == 1) for i in (1, 0))
    fits = filter_bytes(hist, {1: 0, 2: 1}) <= max_filter_mb << 20
    bloom = build_filter(counts, hist, n_buckets, max_filter_mb << 20) if fits else filter_in_parts(counts, hist, n_buckets)
    log = max([0, *(x + 1 for (k, x) in hist if k == 1 and sum(v[0] for (j, y), v in hist.items() if j == 1 and y >= x) > head_words)])
    head = word_counts(counts, 1 << log, None).toArrow() if n_words else pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    hs, cs = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy()
    order = np.argsort(hs)
    total, unit, least = mass(hist, bloom.least[1]), n_train + n_words + 1, bloom.least
    shared = spark.sparkContext.broadcast((hs[order], cs[order], bloom))
    rows = evidence_of(df.withColumn("__id", F.struct(F.col(key).alias("id"), train.alias("train"))) if inside else df, text, "__id" if inside else key, shared, unit, total)
    weight = median_weight(rows.where("id.train") if inside else evidence_of(train, text, key, shared, unit, total))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times = batch.column("codes"), batch.column("n").flatten().to_numpy()
            one, first, both = counts_of(codes.flatten().to_numpy().astype(np.int64), least)
            logs = np.log10(weight * both / np.maximum(first, 1) + (1 - weight) * (one + 1) / total)
            n = codes.value_lengths().to_numpy()
            sums = np.add.reduceat(times * logs, np.cumsum(n) - n) if len(n) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sums)], ["row", "score"])

    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("h"), F.col("w.times").alias("n"))
    rare = rare.join(word_counts(counts, None, 1 << log), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(unit)))).alias("rest"))
    model = rows.select("row", "codes", "n").mapInArrow(scored, "row long, score double")
    rows = rows.select("row", F.col("id.id").alias("id") if inside else "id", "n_tokens", "known", "base").join(model, "row").join(rare, "row", "left")
    none = F.lit(0)
    return rows.select("id", "n_tokens", (F.col("known") + F.coalesce("more", none)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", none.cast("double"))).alias("base_score"), "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model of those whose fold of 7 isn't 2."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = score(docs, fold("doc_id", 7) != 2)
    return rows.select(F.col("id").alias("doc_id"), (fold("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
