"""Structured Streaming editions: sessions with a watermark, a stateful counter scan and slot tracks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.streams import Tracks

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of files, with ``at`` as event time and ``t`` in microseconds."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events*.parquet")
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withColumn("t", F.unix_micros("at")).drop("ts")


def stream_sessions(rows: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a key by session windows; rows later than ``late`` behind the watermark are dropped."""
    sessions = rows.withWatermark("at", late).groupBy(key, F.session_window("at", gap)).agg(F.count("*").alias("n"), F.min("t").alias("start_us"), F.max("t").alias("end_us"))
    return sessions.drop("session_window")


def stream_counts(rows: DataFrame, window: str, slide: str, late: str) -> DataFrame:
    """Counts and sums by sliding window and event type."""
    grouped = rows.withWatermark("at", late).groupBy(F.window("at", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "value")


def _scan(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Drops of one counter: the state is the last read, so reads may come in any number of batches."""
    rows = pd.concat(list(batches)).sort_values(["t", "ord"])
    last = state.get[0] if state.exists else None
    before = rows["value"].shift(1)
    if last is not None and len(rows):
        before.iloc[0] = last
    delta = rows["value"] - before
    kind = delta.map(lambda d: "first" if pd.isna(d) else "reload" if d > 0 else "steady" if d == 0 else "event" if d == -1 else "interpolated" if d >= -3 else "skipped")
    if len(rows):
        state.update((float(rows["value"].iloc[-1]),))
    yield pd.DataFrame({"key": key[0], "t": rows["t"], "ord": rows["ord"], "delta": delta.fillna(0.0), "kind": kind})


def stream_counter(reads: DataFrame, key: str, t: str, order: str, value: str) -> DataFrame:
    """``(key, t, ord, delta, kind)`` of a stream of counter reads that come in order: kinds as in the batch operator."""
    rows = reads.select(F.col(key).cast("long").alias("key"), F.col(t).cast("long").alias("t"), F.col(order).cast("long").alias("ord"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(_scan, "key long, t long, ord long, delta double, kind string", "value double", "append", GroupStateTimeout.NoTimeout)


def stream_tracks(items: DataFrame, key: str, frame: str, ident: str, gap: int, **fit) -> DataFrame:
    """``(key, frame, ident, track, nth)`` of a stream of items ``x, y, h``: the tracks of folds.track_slots, by the same machine.

    A key's state is its open tracks, which are few. Frames of a key must come in order, the items of one frame in any
    number of batches by ident; an item of an earlier frame than the last is left out.
    """
    rows = items.select(F.col(key).cast("long").alias("key"), F.col(frame).cast("long").alias("frame"), F.col(ident).cast("long").alias("ident"), *[F.col(c).cast("double").alias(c) for c in "xyh"])

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks = Tracks(gap, state=json.loads(state.get[0]) if state.exists else (), **fit)
        last = max((s[5] for s in tracks.open), default=None)
        given = pd.concat(list(batches)).sort_values(["frame", "ident"])
        found = [x for r in given[["frame", "ident", "x", "y", "h"]].itertuples(index=False, name=None) if last is None or r[0] >= last for x in tracks.feed(int(r[0]), int(r[1]), *map(float, r[2:]))]
        state.update((json.dumps(tracks.open),))
        yield pd.DataFrame([(k[0], *x) for x in found], columns=["key", "frame", "ident", "track", "nth"])

    return rows.groupBy("key").applyInPandasWithState(step, "key long, frame long, ident long, track long, nth long", "open string", "append", GroupStateTimeout.NoTimeout)


def run_to_table(rows: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now into a memory table."""
    rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.table(name)
