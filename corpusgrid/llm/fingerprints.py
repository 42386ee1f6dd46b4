"""Document fingerprints: a canonical exact digest. DataFrame operations only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import cut, documents, small, text_of, wide_hash


#: Ranges of a key in which texts are put side by side.
MOST_RANGES = 20_000


def canonical(text: Column) -> Column:
    """NFC, full Unicode case folding, NFC again (folding may leave decomposed pairs), runs of white space (ASCII's, the
    separators from U+001C to U+001F, U+0085 and Unicode's category Z) as one space, none at the ends.

    The three Unicode steps call the ICU classes that Spark ships; for ASCII they equal lower(), which stays in generated code."""
    nfc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    fold = lambda c: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    cased = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(nfc(fold(nfc(text))))
    return F.btrim(F.regexp_replace(cased, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def hex_digest(a: Column, b: Column) -> Column:
    part = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(part(a), part(b))


def with_digest(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with prefix+'1', prefix+'2' (wide xxhash of the canonical text) and prefix+'s' (its SHA-256, used only to tell texts of a colliding bucket apart)."""
    c = f"{prefix}c"
    df = df.withColumn(c, canonical(text_of(text)))
    h1, h2 = wide_hash(F.col(c))
    return df.withColumns({f"{prefix}1": h1, f"{prefix}2": h2, f"{prefix}s": F.sha2(c, 256)})


def colliding(members: DataFrame) -> DataFrame:
    """(h1, h2) of buckets whose canonical texts aren't byte for byte equal. members: h1, h2, c. Smallest and largest text of a
    bucket are compared, and both are found map-side first, so a large group of copies is never gathered."""
    return members.groupBy("h1", "h2").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("lo") != F.col("hi")).select("h1", "h2", F.lit(True).alias("split"))


def named(df: DataFrame, collisions: DataFrame, prefix: str, out: str) -> DataFrame:
    """df with the fingerprint: 32 hex digits, and for a text in a colliding bucket a dash and its SHA-256."""
    c = collisions.select(F.col("h1").alias(f"{prefix}1"), F.col("h2").alias(f"{prefix}2"), F.col("split").alias("__split"))
    df = df.join(c, [f"{prefix}1", f"{prefix}2"], "left")
    plain = hex_digest(F.col(f"{prefix}1"), F.col(f"{prefix}2"))
    return df.withColumn(out, F.when(F.col("__split"), F.concat_ws("-", plain, F.col(f"{prefix}s"))).otherwise(plain)).drop("__split")


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", broadcast_rows: int = 250_000) -> DataFrame:
    """df with the fingerprint of each row's text: equal exactly for equal canonical texts. Null is the empty text.

    Rows are grouped by wide hash on digests alone; only texts of buckets with several rows are read again and compared."""
    d = with_digest(df, text, "__f")
    repeated = cut(d.groupBy("__f1", "__f2").count().where("count > 1").select("__f1", "__f2"))
    members = d.join(small(repeated, broadcast_rows), ["__f1", "__f2"], "left_semi").select(F.col("__f1").alias("h1"), F.col("__f2").alias("h2"), F.col("__fc").alias("c"))
    return named(d, cut(colliding(members)), "__f", out).drop("__f1", "__f2", "__fs", "__fc")


def ordered_buckets(df: DataFrame, key: str, rows_per_bucket: int = 3000) -> Column:
    """The number of key's range, ranges of about so many rows in ascending order of key (null first); at most MOST_RANGES, beyond
    which ranges grow. Spark's range partitioner draws them from the keys alone; their ends are a sorted constant that each row is
    looked up in by two steps, for about twice the root of their number."""
    n = min(MOST_RANGES, max(1, math.ceil(df.count() / rows_per_bucket)))
    ranges = df.select(key).repartitionByRange(n, F.asc_nulls_first(key)).groupBy(F.spark_partition_id()).agg(F.max(key).alias("end"))
    ends = sorted({r["end"] for r in ranges.where("end is not null").collect()})[:-1] if n > 1 else []
    if not ends:
        return F.lit(0)
    step, kind = max(1, math.isqrt(len(ends))), f"array<{df.schema[key].dataType.simpleString()}>"
    some = lambda xs: F.from_json(F.lit(json.dumps(xs)), kind)  # noqa: E731  # a constant, parsed once
    block = F.size(F.filter(some(ends[step - 1 :: step]), lambda b: b < F.col(key)))
    fine = F.size(F.filter(F.slice(some(ends), block * step + 1, F.lit(step)), lambda b: b < F.col(key)))
    return F.when(F.col(key).isNull(), 0).otherwise(block * step + fine)


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with next_<column> of the following row in ascending order of key (ties by text hash; after the last row: the first).

    Rows are shuffled once, into ranges of key. A range's last row takes the first row of the next one that has rows from a
    table with one row a range."""
    order = [F.asc_nulls_first(key), F.asc("__t1"), F.asc("__t2")]
    df = df.withColumn("__b", ordered_buckets(df.select(key), key))
    w = Window.partitionBy("__b").orderBy(*order)
    first = df.groupBy("__b").agg(F.min_by(F.struct(*columns), F.struct(F.col(key).isNotNull(), key, "__t1", "__t2")).alias("__first"))
    ends = first.select("__b").agg(F.sort_array(F.collect_list("__b")).alias("bs"))  # one number a range
    ends = ends.select(F.explode(F.transform("bs", lambda x, i: F.struct(x.alias("to"), F.when(i == 0, F.element_at("bs", -1)).otherwise(F.get("bs", i - 1)).alias("__b")))).alias("e")).select("e.*")
    first = first.withColumnRenamed("__b", "to").join(ends, "to").select("__b", "__first")
    inside = df.withColumn("__next", F.lead(F.struct(*columns)).over(w)).join(first.hint("shuffle_hash"), "__b", "left")
    nxt = F.coalesce("__next", "__first")
    return inside.withColumns({f"next_{c}": nxt[c] for c in columns}).drop("__b", "__next", "__first")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical digest of every document, of its edited text and their likeness: 1 if equal, else 0, as for any exact digest.

    A row a row of documents: null texts are empty; rows with null or equal ids are rows of their own, in order null first, then by id,
    then by hash of the text; the last row's next is the first, so a table of one row has itself as next. An empty table gives an empty
    one. Only doc_id and text are read, so that other columns can have any name."""
    text = "__text"
    docs = documents(spark, sf_dir).select("doc_id", text_of("text").alias(text))
    raw = wide_hash(F.col(text))
    docs = docs.withColumns({"__t1": raw[0], "__t2": raw[1]})
    dig = with_digest(docs, text, "o").drop("oc")
    keep = ["doc_id", "__t1", "__t2"]
    own = ["o1", "o2", "os"]
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col(text), F.lit(1), n - k), F.substring(F.col("next___text"), F.lit(1), k))
    pairs = with_next(dig, "doc_id", [text, *keep, *own])
    rows = pairs.select(*keep, *own, *[f"next_{c}" for c in keep + own], n.cast("long").alias("n_chars"), edited.alias("__edited"))
    rows = with_digest(rows, "__edited", "e").withColumn("edited_sha256", F.sha2("__edited", 256)).drop("__edited", "ec")
    rows = cut(rows)  # digests only, no text

    both = rows.select(F.col("o1").alias("h1"), F.col("o2").alias("h2")).union(rows.select("e1", "e2"))
    repeated = small(cut(both.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")), 250_000)
    # texts of equal buckets are read again: originals by their digest, edited ones made anew from the two documents
    o = with_digest(docs, text, "h").join(repeated, ["h1", "h2"], "left_semi").select("h1", "h2", F.col("hc").alias("c"))
    again = rows.join(repeated, (F.col("e1") == F.col("h1")) & (F.col("e2") == F.col("h2")), "left_semi").select(*keep, *[f"next_{c}" for c in keep]).distinct()
    wanted = cut(again.select(F.xxhash64(*keep).alias("w")).union(again.select(F.xxhash64(*[f"next_{c}" for c in keep]))).distinct())
    texts = docs.withColumn("w", F.xxhash64(*keep)).join(small(wanted, 1_000_000), "w", "left_semi").dropDuplicates(["w"]).select("w", text)
    e = again.select(F.xxhash64(*keep).alias("w"), F.xxhash64(*[f"next_{c}" for c in keep]).alias("w2")).join(texts, "w")
    e = e.join(texts.select(F.col("w").alias("w2"), F.col(text).alias("next___text")), "w2").withColumn("__edited", edited)
    e = with_digest(e, "__edited", "h").select("h1", "h2", F.col("hc").alias("c"))
    collisions = cut(colliding(o.union(e)))
    rows = named(rows, collisions, "o", "fingerprint")
    rows = named(rows, collisions, "e", "edited_fingerprint")
    rows = named(rows.withColumns({f"n{x[1]}": F.col(f"next_{x}") for x in own}), collisions, "n", "next_fingerprint")
    like = lambda a: F.when(F.col("fingerprint") == F.col(a), 1.0).otherwise(0.0)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
