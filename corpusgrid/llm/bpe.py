"""Byte-level BPE: encoding by depth-first traversal of a trie of distinct words, decoding, and their query."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.llm.common import HELD, bounded, documents, give_back, slices, take_turn, text_of

#: Before a space that a character other than white space follows, the split pattern always starts a word; so the pieces
#: between such spaces can be encoded apart. Texts with other spaces, or with code points on which notions of white space
#: differ, are encoded whole. U+0000 marks a text's first piece, which has no space before it.
ODD = r" (?:[\s\x{0b}\x{85}\pZ]|\z)|[\x{00}\x{1c}-\x{1f}]"


class PieceCache:
    """ids of texts, by a cache of their pieces' ids (little-endian int32 as bytes). encode_first: from new first pieces to such
    bytes; encode_spaced: from new pieces that a space comes before; encode_whole: the same for a text that can't be cut or that holds a special token's string. Past limit pieces a new
    generation begins, into which the old one's pieces move as they are met again; two generations are held."""

    def __init__(self, encode_first: Callable[[list[str]], list[bytes]], encode_spaced: Callable[[list[str]], list[bytes]], encode_whole: Callable[[str], bytes], specials: list[str], limit: int = 250_000):
        self.encode_first, self.encode_spaced, self.encode_whole, self.limit = encode_first, encode_spaced, encode_whole, limit
        self.odd = "|".join([ODD, *map(re.escape, specials)])
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lookup(self, found: list[str]) -> list[bytes]:
        """ids of distinct pieces."""
        if len(self.cache) > self.limit:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old
        new = [p for p in found if p not in cache]
        if old:
            cache.update((p, old[p]) for p in new if p in old)
        if old:
            new = [p for p in new if p not in old]
        heads = [p for p in new if p[:1] == "\0"]
        cache.update(zip(heads, self.encode_first([p[1:] for p in heads])))
        if len(heads) < len(new):
            new = [p for p in new if p not in cache]
            cache.update(zip(new, self.encode_spaced(new)))
        return [cache[p] for p in found]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """ids of each text; null is empty. Texts are cut, and their pieces made distinct, for the whole array at once."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd)
        cut = pc.split_pattern(pc.binary_join_element_wise("\0", pc.if_else(odd, "", texts), ""), " ")
        coded = cut.flatten().dictionary_encode()
        known = self.lookup(coded.dictionary.to_pylist())
        lens = np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = coded.indices.to_numpy()
        ends = np.cumsum(lens[which])
        at = np.repeat((np.cumsum(lens) - lens)[which] - (ends - lens[which]), lens[which]) + np.arange(ends[-1] if len(ends) else 0)
        values = np.frombuffer(b"".join(known), "<i4")[at]
        cuts = np.r_[0, ends][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        out = [values[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.frombuffer(self.encode_whole(texts[i].as_py()), "<i4")
        return out


class TrieBPE:
    """Encodes distinct words with the vocabulary and merges of a tokenizer file.

    The encoding of a word's prefix ends in exactly one token t, and the rest of it is the encoding of the prefix without t; of
    the vocabulary's suffixes of the prefix it is the one that the merges leave apart from the token before. So each trie node
    needs only its last token, found from its ancestors' last tokens, and prefixes that words share are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.pair = {self.vocab[x] << 32 | self.vocab[y]: i for i, (x, y) in enumerate(merges)}
        # of each token its left part, its right part and the rank of their merge; -1 for a token that isn't merged
        self.made = [array("i", [-1]) * (max(self.vocab.values()) + 1) for _ in range(3)]
        for i, (x, y) in reversed(list(enumerate(merges))):
            for column, value in zip(self.made, (self.vocab[x], self.vocab[y], i)):
                column[self.vocab[x + y]] = value
        names = {i: t for t, i in self.vocab.items()}
        self.size = [len(names.get(i, "")) for i in range(len(self.made[0]))]
        # every beginning of a token, with the tokens that it ends in, longest first, once they have been asked for
        self.part: dict[str, tuple | None] = dict.fromkeys(t[:i] for t in self.vocab for i in range(1, len(t) + 1))
        self.spines: tuple[dict[int, list], dict[int, list]] = {}, {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names |= {i: t for t, i in self.special.items()}
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        # byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on, in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.bytes = pa.array([bytes(byte[c] for c in names.get(i, "")) for i in range(max(names) + 1)], pa.large_binary())

    def merge(self, word: str) -> list[str]:
        """Plain BPE, by rank: the definition that tests hold compatible() and words() against."""
        parts, rank = list(word), lambda x, y: self.pair.get(self.vocab[x] << 32 | self.vocab[y], 1 << 60)
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: (rank(parts[i], parts[i + 1]), i))
            if rank(parts[at], parts[at + 1]) == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at a token's left (0) or right (1) edge while it is merged, from the single byte to itself, each with the
        rank of the merge that ends it."""
        known = self.spines[side].get(token)
        if known is None:
            part, until, known = token, 1 << 60, []
            while True:
                known.append((part, until))
                if self.made[2][part] < 0:
                    break
                until, part = self.made[2][part], self.made[side][part]
            known = self.spines[side][token] = known[::-1]
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b apart. Merges go by rank, so at any time the edge tokens x of a and y of b
        are known; they merge if their pair's rank comes before the merges that end x (which is further left) and y."""
        known = self.apart.get(a << 32 | b)
        if known is not None:
            return known
        xs, ys, pair, i, j = self.spine(a, 1), self.spine(b, 0), self.pair, 0, 0
        while True:
            (x, x_until), (y, y_until) = xs[i], ys[j]
            r = pair.get(x << 32 | y)
            if r is not None and r < x_until and r <= y_until:
                known = False
                break
            if x_until <= y_until:
                if x_until == 1 << 60:
                    known = True
                    break
                i += 1
            else:
                j += 1
        if len(self.apart) > 250_000:
            self.apart.clear()
        self.apart[a << 32 | b] = known
        return known

    def endings(self, part: str) -> tuple:
        """(length, id) of the tokens that a beginning of a token ends in, longest first."""
        found = self.part[part] = tuple((len(part) - i, self.vocab[part[i:]]) for i in range(len(part)) if part[i:] in self.vocab)
        return found

    def step(self, part: str, c: str, last: list[int], depth: int) -> str:
        """Sets the last token of the prefix of this length, which c ends and which before c ended in `part`, the longest
        beginning of a token that it could. The token is the longest that the prefix ends in and that stays apart from the
        token before it. Gives the new part, in which every token that the prefix ends in ends too."""
        part, parts = part + c, self.part
        while part not in parts:
            part = part[1:]
        for n, t in parts[part] or self.endings(part):
            at = depth - n
            if not at:
                last[depth] = t
                return part
            known = self.apart.get(last[at] << 32 | t)
            if known or known is None and self.compatible(last[at], t):
                last[depth] = t
                return part
        raise ValueError("a byte is not in the vocabulary")

    def collect(self, last: list[int], depth: int) -> bytes:
        out = []
        while depth:
            out.append(last[depth])
            depth -= self.size[last[depth]]
        return np.array(out[::-1], "<i4").tobytes()

    def words(self, words: list[str]) -> dict[str, bytes]:
        """ids of distinct words in the byte-level alphabet. The trie of the words is laid out depth first, as the sorted words and the
        length of the prefix that each shares with the one before: the node where its own branch begins. The states on the path to the
        present node are held by depth, so each node's is found once, and a trie takes no more memory than its words."""
        out: dict[str, bytes] = {}
        last, parts, before, step = [0], [""], "", self.step
        for w in sorted(words):
            d, size = 0, len(w)
            for x, y in zip(before, w):
                if x != y:
                    break
                d += 1
            if size >= len(parts):
                parts += [""] * (size + 1 - len(parts))
                last += [0] * (size + 1 - len(last))
            part = parts[d]
            for c in w[d:]:
                d += 1
                part = parts[d] = step(part, c, last, d)
            out[w] = self.collect(last, size)
            before = w
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The known words' ids, these among them."""
        if len(self.known) > 150_000:
            self.known.clear()
        self.known.update(self.words([w for w in words if w not in self.known]))
        return self.known

    def encode_first(self, texts: list[str]) -> list[bytes]:
        split = [[w for w, _ in self.split(t)] for t in texts]
        known = self.learn({w for ws in split for w in ws})
        return [b"".join([known[w] for w in ws]) for ws in split]

    def encode_spaced(self, found: list[str]) -> list[bytes]:
        """Pieces after a space are split into words some at a time: their first words alone begin with the space's letter."""
        words = [w for i in range(0, len(found), 256) for w, _ in self.split(" " + " ".join(found[i : i + 256]))]
        known = self.learn(set(words))
        starts = [i for i, w in enumerate(words) if w[0] == "\u0120"]
        ids = [known[w] for w in words]
        return [ids[a] if b == a + 1 else b"".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(words)])]

    def encode_whole(self, text: str) -> bytes:
        if not self.special:
            return self.encode_first([text])[0]
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        return b"".join(np.array([self.special[p]], "<i4").tobytes() if p in self.special else self.encode_first([p])[0] for p in parts)

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """The text of each list of ids; all of them are looked up at once."""
        cuts = np.cumsum([0, *map(len, lists)])
        joined = self.bytes.take(pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32)))
        data, ends = joined.buffers()[2], np.frombuffer(joined.buffers()[1], np.int64)[cuts]
        data = data.to_pybytes() if data else b""
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


LOADED: dict[str, tuple[TrieBPE, PieceCache]] = {}
HELD[__name__] = LOADED.clear


#: Pieces that a worker holds in one generation, and bytes of the texts whose pieces are made distinct at once.
PIECES, PART = 250_000, 2 << 20


def loaded(path: str) -> tuple[TrieBPE, PieceCache]:
    if path not in LOADED:
        bpe = TrieBPE(path)
        LOADED[path] = bpe, PieceCache(bpe.encode_first, bpe.encode_spaced, bpe.encode_whole, list(bpe.special), PIECES)
        give_back()  # what reading the file took
    return LOADED[path]


def extended(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]], text: str, limit: int = 1 << 20) -> DataFrame:
    """df with more columns, from parts of batches of about limit bytes of the column text. Columns of the same names are replaced."""
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *fields])
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(fn.__module__)
        for batch in batches:
            give_back()
            for part in slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *fn(part)], out_names)

    return bounded(df).mapInArrow(run, schema)


def int_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate(parts) if parts else np.empty(0, np.int32))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
DECODED = T.StructField("decoded", T.StringType())


def encode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """df with ids: the whole text's tokens, as the tokenizers library gives them without added special tokens. The string of a
    special token in the text becomes that token. Null and empty texts have no ids. Rows stay where they are: no shuffle."""
    return extended(df, [IDS], lambda part: [int_lists(loaded(tokenizer)[1].encode(part.column(text)))], text, PART)


def decode(df: DataFrame, tokenizer: str) -> DataFrame:
    """df with decoded: the text of the column ids, special tokens included; bytes that aren't UTF-8 become U+FFFD. Null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)[0]
        for part in batches:
            texts = pa.array(bpe.decode([np.array(x or [], np.int32) for x in part.column("ids").to_pylist()]), pa.string())
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in kept], texts], [*kept, "decoded"])

    kept = [c for c in df.columns if c != "decoded"]
    return bounded(df).mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], DECODED]))


def encode_decode(df: DataFrame, tokenizer: str, text: str = "text", pieces: int = PIECES, part: int = PART) -> DataFrame:
    """encode and decode in one pass over the rows: df with ids and decoded. pieces and part bound a worker's memory: fewer held pieces and
    smaller parts take more time, for the same ids."""

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        bpe, cache = loaded(tokenizer)
        cache.limit = pieces
        ids = cache.encode(part.column(text))
        return [int_lists(ids), pa.array(bpe.decode(ids), pa.string())]

    return extended(df, [IDS, DECODED], fn, text, part)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    rows = encode_decode(documents(spark, sf_dir).select("doc_id", text_of("text").alias("text")), default_tokenizer())
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
