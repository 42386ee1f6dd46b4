"""Structured Streaming versions: live rates of progress events, windowed dedup, and the reorder buffer, with state by key."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusgrid.operators.dedup import sized
from corpusgrid.plans.scale import shared_folder
from corpusgrid.sources.corpus import read


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, in whatever store they are."""
    table = read(spark, sf_dir, name)
    first = table.inputFiles()[0]
    folder, _, file = first.rpartition("/")
    reader = spark.readStream.schema(table.schema)
    return (reader.option("pathGlobFilter", file) if file == f"{name}.parquet" else reader).parquet(folder)


def drained(df: DataFrame) -> DataFrame:
    """All that the stream gives for what is there now, by way of files in the shared folder: exactly once, as the sink commits."""
    spark = df.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def keyed(df: DataFrame, key: str, fn, output: str, state: str) -> DataFrame:
    """df grouped by key, with fn(key, rows of the batch in order, state tuple or None) -> (rows, state tuple). State never times out."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        out, new = fn(k[0], pd.concat(list(parts)), group.get if group.exists else None)
        group.update(new)
        yield out

    return df.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def live_rates(events: DataFrame) -> DataFrame:
    """Average, instant and peak rates of each run's progress: events(run_id, event_id, t_us, v_us). The instant rate is the
    average where no time has passed. State: start, last time, bytes, peak."""

    def step(run: int, rows: pd.DataFrame, state):
        rows = rows.sort_values(["t_us", "event_id"])
        start, last, done, peak = state or (int(rows["t_us"].iloc[0]), 0, 0, 0.0)
        out = []
        for event, t, v in zip(rows["event_id"], rows["t_us"], rows["v_us"]):
            elapsed, done = int(t) - start, done + int(v)
            avg = done / max(elapsed / 1e6, 1e-6)
            now = int(v) / ((elapsed - last) / 1e6) if elapsed > last else avg
            peak, last = max(peak, now), elapsed
            out.append((run, event, elapsed, done, avg, now, peak))
        return pd.DataFrame(out, columns=["run_id", "event_id", "elapsed_us", "done", "avg_bps", "instant_bps", "peak_bps"]), (start, last, done, peak)

    return keyed(events, "run_id", step, "run_id long, event_id long, elapsed_us long, done long, avg_bps double, instant_bps double, peak_bps double", "start long, last long, done long, peak double")


def windowed_dedup(blocks: DataFrame, window: int) -> DataFrame:
    """Blocks(source, doc_id, size, digest) with the earlier equal block of their source, of the last `window` first insertions."""

    def step(source: str, rows: pd.DataFrame, state):
        seen = {tuple(k): v for k, v in json.loads(state[0])} if state else {}
        rows, out = rows.sort_values("doc_id"), []
        for i, key in zip(rows["doc_id"].tolist(), zip(rows["size"].tolist(), rows["digest"])):
            out.append(seen.get(key))
            if key not in seen:
                seen[key] = i
                if len(seen) > window:
                    del seen[next(iter(seen))]
        return pd.DataFrame({"source": source, "doc_id": rows["doc_id"], "target": pd.array(out, "Int64")}), (json.dumps([[list(k), v] for k, v in seen.items()]),)

    return keyed(blocks, "source", step, "source string, doc_id long, target long", "seen string")


def reordered(items: DataFrame) -> DataFrame:
    """Items(run_id, id, t_us) given out in order of id, each as soon as all before it have come: run_id, id, arrival, released. A late or
    repeated id is an error."""

    def step(run: int, rows: pd.DataFrame, state):
        nxt, count, pending = (state[0], state[1], {int(k): v for k, v in json.loads(state[2]).items()}) if state else (0, 0, {})
        out = []
        for i in rows.sort_values(["t_us", "id"])["id"].tolist():
            if i < nxt or i in pending:
                raise ValueError(f"run {run}: id {i} is late or comes twice")
            pending[i] = count
            while nxt in pending:
                out.append((run, nxt, pending.pop(nxt), count))
                nxt += 1
            count += 1
        return pd.DataFrame(out, columns=["run_id", "id", "arrival", "released"]), (nxt, count, json.dumps(pending))

    return keyed(items, "run_id", step, "run_id long, id long, arrival long, released long", "next long, count long, pending string")


def q_live_rates_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.round(F.col("value") * 1000).cast("long").alias("v_us"))
    rounded = [F.round(c, 4).alias(c) for c in ("avg_bps", "instant_bps", "peak_bps")]
    return drained(live_rates(e)).select("run_id", "event_id", "elapsed_us", "done", *rounded)


def q_dedup_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stream(spark, sf_dir, "documents").select("source", "doc_id", *sized())
    return drained(windowed_dedup(d, 16))


def q_first_copies_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct text, as the stream first meets it, by Spark's own deduplication."""
    d = stream(spark, sf_dir, "documents").select(*sized())
    return drained(d.dropDuplicates(["size", "digest"]))


def q_reorder_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of four runs, numbered within each, that come in order of their time."""
    e = stream(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("run_id"), F.floor(F.col("event_id") / 4).alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))
    return drained(reordered(e.withColumn("t_us", F.col("t_us") + F.col("id") % 5 * 3_000_000_000)))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
