"""Interval plans: overlap joins through shared buckets, and merging of touching ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.plans.scale import running


#: Numbers that one row is exploded into at a time.
STEP = 65_536


def explode_range(df: DataFrame, first: Column, last: Column, out: str, spread: bool = False) -> DataFrame:
    """df with a row for each whole number from first to last (none if last < first), in two steps, so that no row ever holds more
    than STEP numbers, or one for each STEP. spread: the rows of a long range are dealt over all tasks between the steps."""
    df = df.withColumns({"__first": first.cast("long"), "__last": last.cast("long")}).where("__first <= __last")
    df = df.withColumn("__g", F.explode(F.expr(f"sequence(0L, (__last - __first) div {STEP})")))
    if spread:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(n, "__first", "__g")
    start = F.expr(f"__first + __g * {STEP}")
    return df.withColumn(out, F.explode(F.sequence(start, F.least(start + (STEP - 1), F.col("__last"))))).drop("__first", "__last", "__g")


def in_buckets(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """df with __bucket, a row for each bucket that [start, end) touches; no row for an empty interval."""
    return explode_range(df.where(F.col(start) < F.col(end)), F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width), "__bucket")


def overlap_join(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs of rows whose half-open intervals overlap, as an equi-join on buckets of so many units: a pair is kept in the first
    bucket that both touch. The nested loop that the plain predicate is planned as never appears. how: inner, or left_semi
    for the left rows that overlap any right one. Empty intervals overlap nothing."""
    lft, rgt = in_buckets(left, l_start, l_end, width), in_buckets(right, r_start, r_end, width)
    hit = (F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end))
    if how == "left_semi":
        bounds = rgt.select(F.col("__bucket").alias("__rb"), F.col(r_start).alias("__rs"), F.col(r_end).alias("__re"))
        semi = lft.join(bounds, (F.col("__bucket") == F.col("__rb")) & (F.col(l_start) < F.col("__re")) & (F.col("__rs") < F.col(l_end)), "left_semi")
        return semi.drop("__bucket").distinct()
    first = F.greatest(F.floor(F.col(l_start) / width), F.floor(F.col(r_start) / width))
    return lft.join(rgt, "__bucket").where(hit & (F.col("__bucket") == first)).drop("__bucket")


def coalesce_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """Touching or overlapping half-open ranges merged: start, end. A range may lie within an earlier one; empty ranges and those
    with a null bound are nothing."""
    rows = df.select(F.col(start).alias("s"), F.col(end).alias("e")).where("e > s").groupBy("s").agg(F.max("e").alias("e"))
    rows = running(rows, [F.col("s")], {}, None, None, {"furthest": "e"})
    rows = running(rows, [F.col("s")], {}, {"reached": "furthest"})
    rows = rows.withColumn("opens", F.when(F.col("reached").isNull() | (F.col("s") > F.col("reached")), 1).otherwise(0))
    rows = running(rows, [F.col("s")], {"island": "opens"})
    return rows.groupBy("island").agg(F.min("s").alias(start), F.max("e").alias(end)).drop("island")
