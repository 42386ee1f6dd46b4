"""Language ID, LM scoring and near duplicates against brute force, and on odd rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrid.llm import langid, neardup, ngramlm, registry
from corpusgrid.llm.common import LOWER

# ---- language ID


def plain_kn(texts, order):
    """Interpolated Kneser-Ney by dictionaries: a function from (context, symbol) to a probability."""
    pad = "\1" * (order - 1)
    seqs = [pad + t for t in texts]
    counts = {order: Counter(s[i - order + 1 : i + 1] for s in seqs for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, c in counts.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total, kinds = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        tables[k] = c, d, total, kinds

    def p(gram, k=order):
        if not k:
            return 1 / langid.ALPHABET
        c, d, total, kinds = tables[k]
        gram = gram[-k:]
        ctx = gram[:-1]
        lower = p(gram, k - 1)
        if ctx not in total:
            return lower
        return max(c[gram] - d, 0) / total[ctx] + d * kinds[ctx] / total[ctx] * lower

    return p


def test_probabilities_equal_plain_kneser_ney():
    samples = {"a": ["the then thee", "hat that"], "b": ["der den dem", "ada"]}
    # the tables hold letters and gaps only, which these texts are made of
    model = langid.fit(samples)
    text = "the dada zz"
    codes, _, inside = langid.sequences([text])
    at = np.flatnonzero(inside)
    got = langid.log_probs(model, langid.hashes(codes), at)
    for i, lang in enumerate(model["langs"]):
        p = plain_kn([t.replace(" ", "\0") for t in samples[lang]], langid.ORDER)
        seq = "\1" * (langid.ORDER - 1) + text.replace(" ", "\0")
        want = [math.log(p(seq[j - langid.ORDER + 1 : j + 1])) for j in range(langid.ORDER - 1, len(seq))]
        assert np.allclose(got[:, i], want, atol=1e-4)


def test_probabilities_sum_to_one():
    model = langid.fit({"a": ["abcabcabd bca", "cab"]})
    ctx = "ab"
    total = 0.0
    for c in map(chr, [0, *range(97, 101)]):
        codes, _, inside = langid.sequences([ctx + (c if c != "\0" else "!")])
        total += math.exp(langid.log_probs(model, langid.hashes(codes), np.flatnonzero(inside)[-1:])[0, 0])
    # the other symbols of the alphabet share what is left
    codes, _, inside = langid.sequences([ctx + "z"])
    rest = math.exp(langid.log_probs(model, langid.hashes(codes), np.flatnonzero(inside)[-1:])[0, 0])
    assert total + rest * (langid.ALPHABET - 5) == pytest.approx(1, abs=1e-5)


def test_spans_of_a_long_text_are_scored_whole(monkeypatch):
    model = langid.fit({"a": ["the then thee"], "b": ["der den dem"]})
    text = "the den " * 50
    whole, n = langid.entropies(model, [text, "", None or "!!"])
    monkeypatch.setattr(langid, "SPAN", 64)
    parts, m = langid.entropies(model, [text, "", "!!"])
    assert n[0] == m[0] and abs(whole[0] - parts[0]).max() < 0.2 and n[1] == n[2] == m[1] == m[2] == 0


def test_op4_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in registry.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(rows) == len(docs)
    right = []
    for d in docs:
        r = rows[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in d["text"] or ""))
        if r["held_out"]:
            right.append(r["lang_pred"] == d["lang"])
    assert np.mean(right) > 0.97
    assert np.mean([r["rejected"] for r in rows.values()]) < 0.01


def test_noise_is_rejected(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    model = langid.train(docs)
    r = random.Random(0)
    noise = ["".join(r.choice("qxzjkvwpgbf") for _ in range(300)), "日本語のテキスト" * 20, "1234 !!", None]
    lang, score, rejected = langid.predict(model, noise)
    assert rejected == [True] * 4 and lang[2:] == ["und", "und"] and score[2:] == [0.0, 0.0]


def test_rejection_rates(spark):
    """Scrambled texts, letters drawn at random and another script are rejected; texts and their parts of 40 code points are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, r = langid.train(docs), random.Random(1)
    texts = [x["text"] for x in docs.where(F.length("text") > 300).orderBy("doc_id").limit(300).collect()]
    share = lambda some: np.mean(langid.predict(model, some)[2])
    assert share(texts) < 0.005 and share([t[100:140] for t in texts if any(c.isalpha() for c in t[100:140])]) < 0.01
    assert share([langid.scrambled(t) for t in texts]) > 0.95
    assert share(["".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(200)) for _ in range(50)]) == 1
    assert share(["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(50)) for _ in range(50)]) == 1


def test_language_of_odd_rows(odd, empty):
    model = langid.train(odd("score"))
    rows = langid.identify(odd("score"), model).collect()
    assert len(rows) == odd().count() and all(r["lang_pred"] in ("en", "und") for r in rows)
    none = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(odd(), none).collect()} == {"und"}
    assert langid.identify(empty, model).collect() == []


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(i, "the hat that they had then " * 5, "short") for i in range(20)] + [(20 + i, "zu dem und den oder das " * 1000 + str(i), "long") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model["langs"] == ["long", "short"]
    assert {(r["lang"], r["lang_pred"]) for r in langid.identify(df, model).collect()} == {("long", "long"), ("short", "short")}


def test_too_many_languages_are_an_error(odd):
    with pytest.raises(ValueError):
        langid.train(odd().withColumn("lang", F.col("text")), max_langs=3)


# ---- LM scoring


def tokens_of(t):
    return [*(t or "").encode("utf-8", "surrogatepass").translate(LOWER).split(), b" end"]


def test_op10_against_brute_force(spark, small_dir, texts):
    got = {r["doc_id"]: r for r in registry.QUERIES["op10_lm_scoring"](spark, small_dir).collect()}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in texts}
    c = Counter(w for r in texts if not held[r["doc_id"]] for w in tokens_of(r["text"]))
    n, v = sum(c.values()), len(c)
    model, base = [], []
    for r in texts:
        ws, g = tokens_of(r["text"]), got[r["doc_id"]]
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert g["base_score"] == pytest.approx(want, rel=1e-9)
        if held[r["doc_id"]]:
            model.append(g["score"] / len(ws))
            base.append(want / len(ws))
    assert np.mean(model) > np.mean(base)


def test_rare_words_go_by_the_join(spark, small_dir, texts):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    a = {r["id"]: r for r in ngramlm.score(docs, docs).collect()}
    b = {r["id"]: r for r in ngramlm.score(docs, docs, head_words=5).collect()}
    for k, r in a.items():
        assert r["n_known"] == b[k]["n_known"] and r["base_score"] == pytest.approx(b[k]["base_score"], rel=1e-9)


def test_filter_counts(spark):
    words = [f"w{i}" for i in range(200)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(1 + i % 9))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    counts = ngramlm.count_ngrams(df, "text", 4, {1: 1, 2: 1})
    hist = ngramlm.histogram(counts)
    assert sum(n for (k, _), (n, _) in hist.items() if k == 1) == 201
    bloom = ngramlm.build_filter(counts, hist, 4, 1 << 20)
    got = bloom.counts(1, np.array([ngramlm.token_hashes(w)[0] for w in words]))
    want = np.array([1 + i % 9 for i in range(200)])
    assert (got >= np.exp2(np.floor(np.log2(want)))).all()  # never less than the level's least
    assert np.mean(got <= np.exp2(np.floor(np.log2(want)) + 1)) > 0.95
    absent = bloom.counts(1, np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert np.mean(absent > 0) < 0.05


def test_a_small_filter_keeps_the_frequent(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    counts = ngramlm.count_ngrams(docs, "text", 64, {1: 1, 2: 2})
    bloom = ngramlm.build_filter(counts, ngramlm.histogram(counts), 64, 2000)
    assert len(bloom.data) < 4000 and max(bloom.least.values()) > 2


@pytest.mark.parametrize(("part", "held", "asked"), [(0, 8 << 20, 1 << 28), (4000, 50_000, 10_000), (1 << 20, 1, 1)])
def test_a_filter_in_parts_gives_the_same_scores(spark, small_dir, monkeypatch, part, held, asked):
    """With few and many parts, slices and tasks a part; the training texts as rows of their own and as a condition."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    want = {r["id"]: r for r in ngramlm.score(docs, docs).collect()}
    for name, value in (("PART", part), ("HELD_TEXT", held), ("ASKED", asked)):
        monkeypatch.setattr(ngramlm, name, value)
    got = ngramlm.score(docs, F.lit(True), max_filter_mb=0).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["score"] == pytest.approx(want[r["id"]]["score"], rel=1e-12) and r["n_known"] == want[r["id"]]["n_known"]


def test_long_training_texts_count_for_the_bigrams_weight(spark):
    r = random.Random(5)
    phrases = [[f"p{i}x{j}" for j in range(5)] for i in range(300)]
    text = lambda: " ".join(w for _ in range(1000) for w in r.choice(phrases))  # noqa: E731  # over 20,000 code points
    train = spark.createDataFrame([(i, text()) for i in range(8)], "doc_id long, text string")
    inside, broken = " ".join(phrases[7]), " ".join(p[i % 5] for i, p in enumerate(phrases[:5]))
    both = spark.createDataFrame([(0, inside), (1, broken)], "doc_id long, text string")
    a, b = (x["score"] for x in sorted(ngramlm.score(both, train).collect()))
    assert a > b + 4  # equal words, as frequent, but those of the first follow one another in train


def test_best_weights_are_the_most_likely(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    counts = ngramlm.count_ngrams(docs, "text", 64, {1: 1, 2: 2})
    hist = ngramlm.histogram(counts)
    bloom, unit = ngramlm.build_filter(counts, hist, 64, 64 << 20), ngramlm.mass(hist, 1)
    some = [x["text"] for x in docs.orderBy("doc_id").limit(12).collect()]
    every = ngramlm.Tokens(some)
    levels = bloom.lookup([(1, every.words), (2, every.pairs)])
    found = ngramlm.evidence(every.n, every.which, every.pair, every.end, *levels)
    for t, k in zip(some, ngramlm.best_weights(*found, bloom.least, unit)):
        tokens = ngramlm.token_hashes(t)
        pairs, before = ngramlm.bigram_hashes(tokens), np.r_[np.uint64(ngramlm.END), tokens[:-1]]
        one, first = bloom.counts(1, tokens), bloom.counts(1, before)
        both = np.minimum(bloom.counts(2, pairs), np.minimum(one, first))
        p1, p2, w = (one + 1) / unit, np.maximum(both - 1, 0) / np.maximum(first - 1, 1), np.arange(ngramlm.STEPS) / ngramlm.STEPS
        likely = [np.log(x * p2 + (1 - x) * p1).sum() for x in w]
        assert abs(int(np.argmax(likely)) - k) <= 1


def test_lm_on_odd_rows(odd, empty):
    df = odd("score")
    rows = ngramlm.score(df, df).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["n_tokens"]) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, len(tokens_of(r["text"]))) for r in df.collect())
    untrained = ngramlm.score(df, empty).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in untrained)
    assert ngramlm.score(empty, df).collect() == []


# ---- near duplicates


def plain_classes(rows, least=neardup.LEAST):
    """Union of equal texts and of all pairs whose shingle sets are similar enough."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = []
    for _, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = Counter((a, b) for v in where.values() for i, b in enumerate(v) for a in v[:i])
    by_text = {}
    links = [(by_text.setdefault(t or "", i), i) for i, (_, t) in enumerate(rows)]
    links += [(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= least]
    for a, b in links:
        parent[find(b)] = find(a)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return sorted(sorted(rows[i][0] for i in v) for v in out.values())


def grouped(found):
    out = defaultdict(list)
    for r in found:
        out[r["class_id"]].append(r["id"])
    assert all(k == min(v) for k, v in out.items())
    return sorted(map(sorted, out.values()))


def test_op3_against_brute_force(spark, small_dir, texts):
    got = [{"id": r["doc_id"], "class_id": r["class_id"]} for r in registry.QUERIES["op3_near_duplicates"](spark, small_dir).collect()]
    rows = [(r["doc_id"], r["text"]) for r in texts if (r["text"] or "").split()]
    known = {i for i, _ in rows}
    assert grouped([r for r in got if r["id"] in known]) == plain_classes(rows)


def edited(words, r, share):
    return [f"{w}{r.randrange(10**6)}" if r.random() < share else w for w in words]


@pytest.mark.parametrize(("rounds", "most", "levels"), [(0, 2000, 8), (1, 2000, 8), (3, 2000, 8), (0, 3, 8), (1, 3, 2)])
def test_large_groups_lose_no_link(spark, rounds, most, levels):
    """Copies of a text with few to many edits, copies of copies, truncated ones: with pivots, and by differences alone; where large groups
    become buckets of their own, until none is left and until the levels end."""
    r = random.Random(7)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    copies = [base] + [edited(base, r, r.choice([0.005, 0.015, 0.03, 0.06])) for _ in range(60)]
    copies += [edited(copies[r.randrange(1, 60)], r, 0.01) for _ in range(20)] + [base[: 150 - k] for k in range(5, 60, 7)] + [base + base[:k] for k in (3, 9)]
    other = [f"v{r.randrange(4000)}" for _ in range(150)]
    copies += [edited(other, r, 0.01) for _ in range(10)] + [base[:75] + other[:75]]
    rows = [(i, " ".join(w)) for i, w in enumerate(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert grouped(neardup.classes(df, pivot_rounds=rounds, broadcast_rows=10, most=most, levels=levels).collect()) == plain_classes(rows)


def test_texts_with_equal_shingles_are_one_class_however_often_they_repeat_them(spark):
    """60 pairs of texts with the same shingles, one of which one text repeats 5,000 times and the other 5 times."""
    r, rows = random.Random(17), []
    for i in range(60):
        tail, loop = " ".join(f"w{r.randrange(10**6)}" for _ in range(40)), " ".join(["a b c d e"] * 5)
        for times in (5, 5000):
            rows.append((2 * i + (times > 5), " ".join(["a b c d e"] * times) + f" {tail}" if times > 5 else f"{loop} {tail}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert grouped(neardup.classes(df).collect()) == [[2 * i, 2 * i + 1] for i in range(60)]


def test_recall_at_a_larger_scale(spark):
    """Every link of the documents of sf0.01 by brute force, found by classes: recall is 1 there."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(x["doc_id"], x["text"]) for x in docs.collect() if (x["text"] or "").split()]
    got = [x for x in neardup.classes(docs).collect() if x["id"] in dict(rows)]
    assert grouped(got) == plain_classes(rows)


def test_signatures_estimate_probability_jaccard():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:300] + [f"x{r.randrange(10**6)}" for _ in range(100)])
    want = neardup.similarity(neardup.shingles(a)[0], neardup.shingles(b)[0])
    got = []
    for k in range(40):  # other shingles, same similarity
        s, _ = neardup.signatures([a.replace("w", f"y{k}"), b.replace("w", f"y{k}")])
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 0.04
    heavy = " ".join(["p q r s t"] * 50 + ["a b c d e"])
    assert neardup.signatures([heavy, heavy])[0].tolist()[0] == neardup.signatures([heavy])[0].tolist()[0]


def test_copies_that_repeat_a_passage_share_a_band():
    """Of 300 pairs with set Jaccard 0.82 to 0.88, one text of which repeats a passage 50 times, all but 0.02 % should be candidates."""
    r, found = random.Random(11), 0
    for _ in range(300):
        a = [f"w{r.randrange(10**7)}" for _ in range(300)]
        b = list(a)
        for i in (70, 140, 210, 280):
            b[i] = f"x{r.randrange(10**7)}"
        b += a[:60] * 49
        a, b = " ".join(a), " ".join(b)
        assert 0.82 <= neardup.similarity(neardup.shingles(a)[0], neardup.shingles(b)[0]) <= 0.88
        one, two = neardup.bands(neardup.signatures([a, b])[0])
        found += bool((one == two).any())
    assert found >= 299


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(41)} == {"n000"} and got["x"] == got["y"] == "x" and got["z"] == "z"
    assert neardup.components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_near_copies_of_odd_rows(odd, empty):
    df = odd("node")
    rows = neardup.classes(df).collect()
    assert len(rows) == df.count()
    kept = neardup.drop_near_copies(df).collect()
    assert len(kept) == len({r["class_id"] for r in rows}) and set(kept[0].asDict()) == set(df.columns)
    assert neardup.classes(empty).collect() == [] and neardup.drop_near_copies(empty).collect() == []
