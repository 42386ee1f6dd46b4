"""Plan builders that keep global order distributed: running sums, lags and sized broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Metadata rows up to which one task may hold a globally ordered window; beyond, two_level() ranges are used.
ONE_TASK_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; only where it is unset and all runs in one process (tests) a local
    folder of its own. On a cluster an unset folder is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = path or "file://" + tempfile.mkdtemp(prefix="corpusgrid-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has been counted to have no more than so many rows; else the planner shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def running(df: DataFrame, order: list[Column], sums: dict[str, str], lags: dict[str, str] | None = None, rows: int | None = None, maxes: dict[str, str] | None = None) -> DataFrame:
    """df with, for each out: column of sums (maxes), the sum (largest) of the rows before and up to this one in global order, and
    for each out: column of lags, the column of the row before (null on the first).

    Up to ONE_TASK_ROWS rows (of metadata: no content is carried) that is one ordered window. More rows are dealt into ranges,
    summed per range, and each range is continued from the totals of the ranges before it, one row a range."""
    lags, maxes = lags or {}, maxes or {}
    if (df.count() if rows is None else rows) <= ONE_TASK_ROWS:
        w = Window.orderBy(*order)
        up = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: F.sum(c).over(up).cast("long") for o, c in sums.items()} | {o: F.max(c).over(up) for o, c in maxes.items()} | {o: F.lag(c).over(w) for o, c in lags.items()})
    return two_level(df, order, sums, lags, maxes)


def two_level(df: DataFrame, order: list[Column], sums: dict[str, str], lags: dict[str, str], maxes: dict[str, str] | None = None) -> DataFrame:
    """running() over ranges of the order."""
    maxes = maxes or {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = checkpointed(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    w = Window.partitionBy("__p").orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    totals = part.groupBy("__p").agg(*[F.sum(c).alias(f"__s_{o}") for o, c in sums.items()], *[F.max(c).alias(f"__m_{o}") for o, c in maxes.items()], *[F.max(F.when(F.col("__last"), F.struct(F.lit(1), F.col(c).alias("v"))))["v"].alias(f"__l_{o}") for o, c in lags.items()])
    across = Window.orderBy("__p")  # a row a range
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__p", *[F.coalesce(F.sum(f"__s_{o}").over(before), F.lit(0)).alias(f"__b_{o}") for o in sums], *[F.max(f"__m_{o}").over(before).alias(f"__h_{o}") for o in maxes], *[F.lag(f"__l_{o}").over(across).alias(f"__k_{o}") for o in lags])
    out = part.join(F.broadcast(starts), "__p")  # as many rows as shuffle partitions
    first = F.row_number().over(w) == 1
    out = out.withColumns({o: (F.sum(c).over(up) + F.col(f"__b_{o}")).cast("long") for o, c in sums.items()} | {o: F.greatest(F.max(c).over(up), F.col(f"__h_{o}")) for o, c in maxes.items()} | {o: F.when(first, F.col(f"__k_{o}")).otherwise(F.lag(c).over(w)) for o, c in lags.items()})
    return out.drop("__p", "__last", *[f"__b_{o}" for o in sums], *[f"__h_{o}" for o in maxes], *[f"__k_{o}" for o in lags])
