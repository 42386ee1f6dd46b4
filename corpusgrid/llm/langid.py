"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays, lowest cross-entropy, calibrated rejection."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.llm.bpe import extended
from corpusgrid.llm.common import documents, text_of

#: Longest n-gram, symbols that an unseen character may be, code points scored as one sequence.
ORDER, ALPHABET, SPAN = 5, 4096, 500_000
#: Code of a run of anything but letters, and of the padding before a text.
GAP, PAD = 0, 1
FACTOR = 0x9E3779B97F4A7C15
#: Nats over a language's bound that a whole text must have to be rejected.
EVIDENCE = 20.0
TABLE = np.full(0x110000, -1, np.int32)


def codes_of(points: np.ndarray) -> np.ndarray:
    """Letters as their lower-case code points, all else as GAP. The table fills as code points turn up."""
    codes = TABLE[points]
    if (codes < 0).any():
        for p in np.unique(points[codes < 0]).tolist():
            c = chr(p)
            TABLE[p] = ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else GAP
        codes = TABLE[points]
    return codes


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of codes, runs of gaps as one and ORDER - 1 pads before each text; the text each code is of; whether it is no pad."""
    gap = "\0" * (ORDER - 1)
    points = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lens + ORDER - 1) - lens
    edge = np.zeros(len(points) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lens, -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    codes = codes_of(points)
    codes[~inside] = PAD
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
    owner = np.repeat(np.arange(len(texts)), lens + ORDER - 1)
    return codes[keep], owner[keep], inside[keep]


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """hashes(codes)[k][i]: of the k codes that end at i. The context of the k-gram at i is [k-1][i-1], its shorter form [k-1][i]."""
    c = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    c = (c ^ (c >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    out, power = [np.zeros(len(c), np.uint64)], 1
    for k in range(ORDER):
        h = out[-1].copy()
        h[k:] += c[: len(c) - k] * np.uint64(power)
        out.append(h)
        power = power * FACTOR % (1 << 64)
    return out


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted array, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    at[table[at] != keys] = -1
    return at


def fit(samples: dict[str, list[str]]) -> dict:
    """The model of some texts a language: for each order a sorted array of n-gram hashes over all languages with the
    interpolated log-probability in each language, and one of context hashes with the weight of the shorter context."""
    langs = sorted(samples)
    grams: list[list[dict]] = [[] for _ in range(ORDER + 1)]
    for lang in langs:
        codes, _, inside = sequences(samples[lang])
        h, at = hashes(codes), np.flatnonzero(inside)
        _, first, count = np.unique(h[ORDER][at], return_index=True, return_counts=True)
        first = at[first]
        for k in range(ORDER, 0, -1):
            ctx, inv = np.unique(h[k - 1][first - 1], return_inverse=True)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total, kinds = np.bincount(inv, count), np.bincount(inv)
            grams[k].append({"hash": h[k][first], "ctx": h[k - 1][first - 1], "short": h[k - 1][first], "p": (count - d) / total[inv], "ctxs": ctx, "rest": d * kinds / total})
            if k > 1:  # continuation counts: how many longer n-grams end so
                _, at1, count = np.unique(h[k - 1][first], return_index=True, return_counts=True)
                first = first[at1]
    model = {"langs": langs, "tables": [None]}
    below = None
    for k in range(1, ORDER + 1):
        every, pick = np.unique(np.concatenate([g["hash"] for g in grams[k]]), return_index=True)
        ctx, short = (np.concatenate([g[x] for g in grams[k]])[pick] for x in ("ctx", "short"))
        ctxs = np.unique(np.concatenate([g["ctxs"] for g in grams[k]]))
        rest = np.ones((len(ctxs), len(langs)))
        prob = np.zeros((len(every), len(langs)))
        for i, g in enumerate(grams[k]):
            rest[find(ctxs, g["ctxs"]), i] = g["rest"]
            prob[find(every, g["hash"]), i] = g["p"]
        lower = below[1][find(below[0], short)] if below else np.full((len(every), len(langs)), 1 / ALPHABET)
        prob += rest[find(ctxs, ctx)] * lower
        below = every, prob
        model["tables"].append((every, np.log(prob).astype(np.float32), ctxs, np.log(rest).astype(np.float32)))
    return model


def log_probs(model: dict, h: list[np.ndarray], at: np.ndarray, k: int = ORDER) -> np.ndarray:
    """Log-probabilities of the codes at these places in each language; where the n-gram is unseen, of the shorter one."""
    if not k:
        return np.full((len(at), len(model["langs"])), -np.log(ALPHABET), np.float32)
    grams, logs, ctxs, rest = model["tables"][k]
    found = find(grams, h[k][at])
    out = logs[found]
    miss = np.flatnonzero(found < 0)
    if len(miss):
        c = find(ctxs, h[k - 1][at[miss] - 1])
        out[miss] = np.where((c >= 0)[:, None], rest[c], np.float32(0)) + log_probs(model, h, at[miss], k - 1)
    return out


def entropies(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy a code of each text in each language, and the codes scored; texts without a letter have none. Texts of more
    than SPAN code points are scored whole, a span at a time."""
    parts = [(i, t[a : a + SPAN]) for i, t in enumerate(texts) for a in range(0, max(1, len(t)), SPAN)]
    total, n, letters = np.zeros((len(texts), len(model["langs"]))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    start = 0
    while start < len(parts):
        stop, size = start, 0
        while stop < len(parts) and (stop == start or size + len(parts[stop][1]) <= SPAN):
            size += len(parts[stop][1])
            stop += 1
        codes, owner, inside = sequences([t for _, t in parts[start:stop]])
        text_no = np.array([i for i, _ in parts[start:stop]])[owner]
        at = np.flatnonzero(inside)
        if len(at):
            logs, whose = log_probs(model, hashes(codes), at), text_no[at]
            heads = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
            total[whose[heads]] += np.add.reduceat(logs, heads, axis=0, dtype=np.float64)
            np.add.at(n, whose[heads], np.diff(np.r_[heads, len(at)]))
            np.add.at(letters, whose, codes[at] > PAD)
        start = stop
    n[letters == 0] = 0
    return -total / np.maximum(n, 1)[:, None], n


def scrambled(text: str) -> str:
    """The text's characters in an order that its own hash draws: as frequent as in the language, but not of it."""
    chars = np.array(list(text))
    return "".join(chars[np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass"))).permutation(len(chars))])


def calibrate(model: dict, samples: dict[str, list[str]]) -> None:
    """For each language the cross-entropy above which a text is rather none: half-way between the largest of the calibration texts
    that are nearest to the language, and the least 1 % of the same texts scrambled. A language that no calibration text is nearest to, or whose
    scrambled texts aren't above the others, takes the largest bound of the others; without any, nothing is rejected for it."""
    texts = [t for lang in sorted(samples) for t in samples[lang]]
    model["most"] = np.full(len(model["langs"]), np.inf)
    if not texts or not model["langs"]:
        return
    (e, n), (noise, m) = entropies(model, texts), entropies(model, [scrambled(t) for t in texts])
    best, some = e.argmin(axis=1), (n > 0) & (m > 0)
    for i in range(len(model["langs"])):
        own = some & (best == i)
        if own.any():
            high, low = e[own, i].max(), np.quantile(noise[own].min(axis=1), 0.01)
            model["most"][i] = (high + low) / 2 if low > high else np.inf
    known = model["most"][np.isfinite(model["most"])]
    model["most"][~np.isfinite(model["most"])] = known.max() if len(known) else np.inf


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """(language, score, rejected) of each text. The score is the best language's share of the likelihoods, each for the
    text's codes but 20 at most, at its own cross-entropy. Rejected: no letter, or more cross-entropy than the best language's bound
    by at least EVIDENCE over all codes, so that a text of a few words isn't rejected for a rare one."""
    if not model["langs"]:
        return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    e, n = entropies(model, [t or "" for t in texts])
    best = e.argmin(axis=1)
    low = e[np.arange(len(e)), best]
    score = 1 / np.exp((low[:, None] - e) * np.minimum(n, 20)[:, None]).sum(axis=1)
    some = n > 0
    rejected = ~some | ((low - model["most"][best]) * n > EVIDENCE)
    return [model["langs"][b] if s else "und" for b, s in zip(best, some)], np.where(some, score, 0.0).tolist(), rejected.tolist()


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 400, max_chars: int = 20_000, max_langs: int = 500, total_chars: int = 100_000_000) -> dict:
    """A model from a bounded sample of the labelled rows of df: for each language about docs_per_lang whole texts of at most
    max_chars code points, by hash of key and text; where a language has fewer, the first max_chars of longer ones too; a fifth of them,
    by hash, calibrates rejection. With many languages max_chars is less, so that the sample has at most about 2 * total_chars code
    points. More than max_langs languages are an error. Rows with a null language or text don't count. Without rows the model knows no
    language."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    langs = rows.select(lang).distinct().limit(max_langs + 1).count()
    max_chars = min(max_chars, max(1000, total_chars // (docs_per_lang * max(langs, 1))))
    rows = rows.select(F.col(lang).cast("string").alias("l"), F.substring(text, 1, max_chars).alias("t"), F.xxhash64(key, text).alias("h"), (F.length(text) > max_chars).alias("long"))
    counts = rows.groupBy("l").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long")).limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return {"langs": [], "tables": [], "most": np.empty(0)}
    part = lambda want, n: F.lit(max(0.0, min(1.0, want / n)) if n else 0.0)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["l"]), F.struct(part(docs_per_lang, r["short"]).alias("short"), part(docs_per_lang - r["short"], r["long"]).alias("long")))])
    share = F.element_at(share, F.col("l"))
    share = F.when(F.col("long"), share["long"]).otherwise(share["short"])
    sample = rows.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).limit(2 * docs_per_lang * len(counts) + 100).collect()
    fitted: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: r["h"]):
        (held if (r["h"] >> 40) % 5 == 0 else fitted).setdefault(r["l"], []).append(r["t"])
    for name in held.keys() - fitted.keys():
        fitted[name] = held[name]
    model = fit(fitted)
    calibrate(model, held)
    return model


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """df with lang_pred (und: null text or no letter), score in 0..1 and rejected, from the whole text alone. The model, as
    bounded as its sample, is broadcast; rows stay where they are. Columns so named are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        langs, score, rejected = predict(shared.value, part.column(text).to_pylist())
        return [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return extended(df, FIELDS, fn, text)


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose fold isn't 1."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(fold("doc_id", 3) != 1))
    rows = identify(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "rejected")
