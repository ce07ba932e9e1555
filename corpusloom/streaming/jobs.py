"""Streams of results and leases: accepted once, counted by window, loaded in parts, deduplicated against a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_table(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A file stream over a folder of parquet files, so many files in each batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run all that there is, in batches, into a parquet folder; a later call goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def accepted_results(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def progress_windows(rows: DataFrame, ts: str, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Rows of each tumbling window; for a table as for a stream."""
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def stream_dedup(stream: DataFrame, key: str, table: str, checkpoint: str) -> DataFrame:
    """Append the first row of each key to the stream's own table.  The keys seen so far are Spark's state, so a batch costs
    what it holds, however long the table; a batch that comes again adds nothing."""
    return run_to_table(stream.dropDuplicates([key]), table, checkpoint)


def next_lease(held: tuple | None, events: list[tuple[float, str, int]]) -> tuple:
    """(event, client, ts) of a batch after more events of (ts, event, client)."""
    for ts, event, client in sorted(events):
        if event != "none" and (held is None or (ts, event, client) >= (held[2], held[0], held[1])):
            held = (event, client, ts)
    return held or ("none", -1, 0.0)


def lease_states(stream: DataFrame, seconds: int) -> DataFrame:
    """batch_id, client, state, the time ``since`` when and whether it has ``ended``, after each batch of events; a lease
    that hears nothing for so long, in time of events, expires.  The last event counts, ties by event and client."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            event, client, since = state.get
            if event == "assign":
                yield pd.DataFrame({"batch_id": [key[0]], "client": [client], "state": ["expired"], "since": [since], "ended": [True]})
            return
        events = [(float(t.timestamp()), e, int(c)) for part in parts for t, e, c in zip(part["ts"], part["event"], part["client"])]
        held = next_lease(state.get if state.exists else None, events)
        state.update(held)
        state.setTimeoutTimestamp(max(int(held[2] + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        names = {"assign": "assigned", "submit": "completed", "return": "pending", "none": "pending"}
        yield pd.DataFrame({"batch_id": [key[0]], "client": [held[1]], "state": [names[held[0]]], "since": [held[2]], "ended": [False]})

    return stream.withWatermark("ts", "0 seconds").groupBy("batch_id").applyInPandasWithState(
        step, "batch_id long, client long, state string, since double, ended boolean", "event string, client long, ts double", "append", GroupStateTimeout.EventTimeTimeout
    )


def last_states(states: DataFrame) -> DataFrame:
    """The last of the states of each batch that a stream of leases has left in a table."""
    last = states.groupBy("batch_id").agg(F.max_by(F.struct("client", "state"), F.struct("since", "ended", "client")).alias("x"))
    return last.select("batch_id", "x.client", "x.state")
