"""Line dedup: lines that many documents share are dropped from all of them. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.llm.common import LOWER_AZ, SPACES, UPPER_AZ, cut, documents, small, text_of, wide_hash


def line_key(line: Column) -> Column:
    """The line with ASCII white space stripped at both ends and A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER_AZ, LOWER_AZ)


def drop_common_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 10, min_chars: int = 1, broadcast_rows: int = 250_000, out: str = "kept", by_key: bool = False) -> DataFrame:
    """df with three more columns: n_lines, n_dropped and out (the text without its common lines).

    Lines are exploded, normalised and hashed to 128 bits. A row counts once per distinct line (array_distinct inside the
    row, so nothing but (hash, 1) is shuffled, summed map-side first). Hashes in at least min_docs rows are common. The
    common hashes are broadcast if they were counted to be few, else joined by shuffle, where AQE splits a hot line. Only
    positions of dropped lines return to their row, which takes its lines by position.

    Every row is a document, or with by_key every key that isn't null is one, as in OP2_SQL: where keys repeat or are null, (hash, key)
    is made distinct before it is counted. Rows equal in key and text get the same result. Null or empty text is one empty line, which has
    too few code points to be dropped. If all lines go, out is empty. Columns named n_lines, n_dropped or out are replaced.
    An empty table gives an empty table.
    """
    split = F.split(text_of(text), "\n", -1)
    k = ["__k1", "__k2"]
    base = df.withColumns(dict(zip(k, wide_hash(F.col(key), text_of(text)))))
    lines = base.select(*k, F.posexplode(split).alias("__pos", "__line"))
    lines = lines.select(*k, "__pos", line_key(F.col("__line")).alias("__key")).where(F.length("__key") >= min_chars)
    lines = lines.select(*k, "__pos", *[h.alias(f"__h{i}") for i, h in enumerate(wide_hash(F.col("__key")))])
    keyed = by_key and bool(df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).count())
    seen = df.where(F.col(key).isNotNull()) if keyed else df
    seen = seen.select(*([F.col(key).alias("__id")] if keyed else []), F.explode(F.array_distinct(F.transform(split, line_key))).alias("__key")).where(F.length("__key") >= min_chars)
    seen = seen.select(*(["__id"] if keyed else []), *[h.alias(f"__h{i}") for i, h in enumerate(wide_hash(F.col("__key")))])
    seen = seen.distinct() if keyed else seen
    common = cut(seen.groupBy("__h0", "__h1").count().where(F.col("count") >= min_docs).select("__h0", "__h1"))
    dropped = lines.join(small(common, broadcast_rows), ["__h0", "__h1"], "left_semi").groupBy(*k).agg(F.collect_set("__pos").alias("__drop"))
    joined = base.join(dropped.hint("shuffle_hash"), k, "left").withColumn("__drop", F.coalesce("__drop", F.array().cast("array<int>")))
    # a one-element array binds the lines, so that they are split once and not for each kept position
    kept = F.transform(F.array(split), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__drop")), lambda i: F.get(ls, i)), "\n"))[0]
    text_out = F.when(F.size("__drop") == 0, text_of(text)).otherwise(kept)
    return joined.withColumns({"n_lines": F.size(split).cast("long"), "n_dropped": F.size("__drop").cast("long"), out: text_out}).drop(*k, "__drop")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in at least 10 documents go, over all documents."""
    out = drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"), by_key=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos
  from documents),
k as (
  select doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key_
  from l),
hot as (select key_ from k where length(key_) >= 1 group by key_ having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(hot.key_) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where hot.key_ is null), '')) as kept_sha256
from k left join hot using (key_) group by doc_id
"""
