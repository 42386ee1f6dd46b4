"""Mixing sources to target weights by temperature. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import cut, documents, small, text_of


def token_count(text: str):
    """Words of the text: runs without ASCII white space."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def solve_exponent(shares: DataFrame, max_repeats: float | None, target_entropy: float | None, steps: int = 40) -> float:
    """The exponent, bisected in [0, 1]: the smallest (flattest) at which the rarest source isn't repeated more than max_repeats
    times as often as the largest, or the largest at which the weights' entropy, over its maximum, reaches target_entropy.
    shares: p, one row a source. Each step is a small aggregate; the shares stay on the cluster."""
    one = shares.where("p > 0").coalesce(1)
    top = one.agg(F.max("p").alias("hi"), F.min("p").alias("lo"), F.count("*").alias("n")).first()
    if not top["n"] or top["hi"] == top["lo"]:
        return 1.0

    def ok(a: float) -> bool:
        """True on the side of 1 where the bisection keeps its upper end."""
        if target_entropy is None:
            return one.agg(F.max(F.pow(F.col("p") / top["hi"], F.lit(a - 1.0))).alias("r")).first()["r"] <= max_repeats
        z = one.agg(F.sum(F.pow("p", F.lit(a))).alias("z")).first()["z"]
        w = F.pow("p", F.lit(a)) / z
        return one.agg((-F.sum(w * F.log(w)) / F.log(F.lit(float(top["n"])))).alias("h")).first()["h"] < target_entropy

    lo, hi = 0.0, 1.0
    if ok(lo):
        return 0.0
    if not ok(hi):
        return 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi if target_entropy is None else lo


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = 200_000, seed: int = 7) -> DataFrame:
    """The rows of df, each once or several times, with the columns n_tokens, weight, epoch, block and place.

    Source token shares are raised to an exponent (solve_exponent) and normalised to weights. budget is the mixture's number of
    tokens; by default the least with which every source is read whole at least once, so no document is lost. A source with t
    tokens and weight w is read budget * w / t times: whole epochs, then a part. Sources are dealt into blocks of about
    block_tokens by hash; each block has its share of the budget and a permutation for each epoch, by hash, and the last,
    partial epoch takes the permutation's documents that begin within the block's budget. So a hot source is many blocks, and
    no window holds more than one.

    Null sources are one source of their own, apart from the empty name. Rows without words count as one token. Rows equal in
    key and text are interchangeable. Columns of the names above are replaced. An empty table gives an empty table.
    """
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(text_of(text))))
    base = df.withColumns({"__s": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")), "n_tokens": F.greatest(F.lit(1), token_count(text)), "__d": digest})
    sums = cut(base.groupBy("__s").agg(F.sum("n_tokens").alias("t")))
    total = sums.agg(F.sum("t")).first()[0] or 1
    shares = sums.select("__s", "t", (F.col("t") / F.lit(float(total))).alias("p"))
    a = solve_exponent(shares, max_repeats, target_entropy)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    shares = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(z))
    least = shares.agg(F.max(F.col("t") / F.col("weight"))).first()[0] or 0.0
    shares = shares.withColumn("__r", F.round(F.lit(float(budget if budget is not None else least)) * F.col("weight") / F.col("t"), 6))
    shares = shares.withColumns({"__n": F.ceil(F.col("t") / block_tokens), "weight": F.round("weight", 9)})
    rows = base.join(small(shares.select("__s", "weight", "__r", "__n"), 100_000), "__s")
    number = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")
    rows = rows.withColumn("block", (number(F.lit(f"b{seed}"), F.col("__d")) % F.col("__n")).cast("long"))
    place = lambda epoch: F.md5(F.concat_ws(":", F.lit(f"e{seed}"), epoch.cast("string"), F.col("__d")))
    w = Window.partitionBy("__s", "block")
    last = F.floor("__r")
    rows = rows.withColumn("__o", place(last))
    before = F.sum("n_tokens").over(w.orderBy("__o").rowsBetween(Window.unboundedPreceding, -1))
    within = F.coalesce(before, F.lit(0)) < (F.col("__r") - last) * F.sum("n_tokens").over(w)
    rows = rows.withColumn("__c", (last + F.when(within, 1).otherwise(0)).cast("int"))
    rows = rows.where("__c > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__c") - 1)))
    return rows.withColumn("place", place(F.col("epoch"))).drop("__s", "__d", "__r", "__n", "__o", "__c")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per reading of a document, so that the rarest source is read twice as often as the largest at most."""
    rows = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", "n_tokens", "weight", F.col("epoch").cast("long").alias("epoch"), "block", "place")


OP6_SQL = """
with recursive d as (
  select doc_id, source, coalesce('=' || source, '') s,
         greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::bigint n_tokens,
         md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) dg
  from documents),
sums as (select s, sum(n_tokens)::double t from d group by s),
shares as (select s, t, t / (select sum(t) from sums) p from sums),
b(step, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select step + 1,
         case when (select max(pow(p / (select max(p) from shares), (lo + hi) / 2 - 1.0)) from shares) <= 2.0 then lo else (lo + hi) / 2 end,
         case when (select max(pow(p / (select max(p) from shares), (lo + hi) / 2 - 1.0)) from shares) <= 2.0 then (lo + hi) / 2 else hi end
  from b where step < 40),
e as (select case when (select max(p) / min(p) from shares) <= 2.0 then 0.0::double
             else (select hi from b where step = 40) end a0,
      case when (select max(p) = min(p) from shares) then 1.0::double end a1),
wt as (select s, t, pow(p, (select coalesce(a1, a0) from e)) / (select sum(pow(p, (select coalesce(a1, a0) from e))) from shares) w from shares),
r as (select s, t, round(w, 9) weight, round((select max(t / w) from wt) * w / t, 6) rr, ceil(t / 200000)::bigint n from wt),
k as (
  select doc_id, source, n_tokens, dg, r.s, weight, rr, floor(rr)::bigint lst,
         ('0x' || substr(md5('b7:' || dg), 1, 12))::bigint % n as block
  from d join r on d.s = r.s),
c as (
  select *, coalesce(sum(n_tokens) over (partition by s, block order by md5('e7:' || lst::varchar || ':' || dg)
                                         rows between unbounded preceding and 1 preceding), 0) bef,
         sum(n_tokens) over (partition by s, block) tot from k)
select doc_id, source, n_tokens, weight, epoch, block, md5('e7:' || epoch::varchar || ':' || dg) as place
from (select *, unnest(range(0, lst + case when bef < (rr - lst) * tot then 1 else 0 end)) epoch from c)
"""
