"""Leases of work batches as a stream: given out, handed in, returned, expired by a sweep and given out again.

Each batch keeps the events that the watermark has not passed in a list of packed arrays, and its lease in a value.  Events
are taken in the order of their time once the watermark passes them, so a log that comes shuffled within the watermark's
delay gives the same transitions as a sorted one; events later than that are dropped by Spark.  One timer wakes a batch at
the next event that waits, or at the sweep at which its lease has run out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SECONDS, SWEEP = 3600, 300
STATES = {"assign": "assigned", "submit": "completed", "return": "pending"}
#: Events are packed by their places here, which is the order that ties are taken in; what is named last has no event.
EVENTS = sorted(STATES)
NAMES = np.array([*(STATES[x] for x in EVENTS), "expired"], dtype=object)
PACKED = np.dtype([("at", "<i8"), ("event", "i1"), ("client", "<i8")])
#: Events in one value of the list state.
CHUNK = 65_536
LOG = "batch_id long, at long, client long, state string, times int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"


def run_out(at, seconds: int, sweep: int):
    """The first sweep, in microseconds, at which a lease of this time has run out; sweep 0: a millisecond after it has."""
    end = at // 1_000_000 + seconds
    return -(-end // sweep) * sweep * 1_000_000 if sweep else end * 1_000_000 + 1000


def transitions(lease: tuple | None, events: np.ndarray, until: int, seconds: int, sweep: int) -> tuple[tuple | None, pd.DataFrame]:
    """The lease (event, client, at, times, expired) after packed events, sorted, and the transitions (at, client, state,
    times) up to a time, in order."""
    if lease:
        events = np.concatenate([np.array([(lease[2], EVENTS.index(lease[0]), lease[1])], PACKED), events])
    at, event, client = (events[x] for x in PACKED.names)
    given = event == EVENTS.index("assign")
    times = np.cumsum(given) + (lease[3] - int(given[0]) if lease else 0)
    end = run_out(at, seconds, sweep)
    over = given & (end <= np.append(at[1:], until)[: len(at)])
    known = int(lease is not None)
    if lease and lease[4]:
        over[0] = False
    out = pd.DataFrame({
        "at": np.concatenate([end[over], at[known:]]), "client": np.concatenate([client[over], client[known:]]),
        "state": NAMES[np.concatenate([np.full(over.sum(), len(EVENTS)), event[known:]])], "times": np.concatenate([times[over], times[known:]]),
    })
    if len(at):
        lease = (EVENTS[event[-1]], int(client[-1]), int(at[-1]), int(times[-1]), bool(over[-1] or (len(at) == known and lease[4])))
    return lease, out.iloc[np.argsort(out["at"].to_numpy(), kind="stable")]  # a lease runs out before an event of that time


def advanced(lease: tuple | None, events: list[tuple[int, str, int]], until: int, seconds: int, sweep: int) -> tuple[tuple | None, list[tuple]]:
    """As transitions, of sorted events of (at, event, client); ties by event and client."""
    packed = np.array([(at, EVENTS.index(e), client) for at, e, client in events if e in STATES], PACKED)
    lease, out = transitions(lease, packed, until, seconds, sweep)
    return lease, list(out.itertuples(index=False, name=None))


class Leases(StatefulProcessor):
    """every: all transitions, else the last that a batch of the stream or a timer brings."""

    def __init__(self, seconds: int, sweep: int, every: bool = True):
        self.seconds, self.sweep, self.every = seconds, sweep, every

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.lease = handle.getValueState("lease", "event string, client long, at long, times int, expired boolean")
        self.next = handle.getValueState("next", "first long, wake long")  # of the events that wait, and of the timer; in milliseconds

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            new.append(np.empty(len(part), PACKED))
            for x in PACKED.names:
                new[-1][x] = part[x].astype("int64")  # a null is an error
        yield from self.step(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.step(key, [], timerValues.getCurrentWatermarkInMs())

    def step(self, key, new, watermark: int) -> Iterator[pd.DataFrame]:
        told = first, wake = tuple(self.next.get()) if self.next.exists() else (None, None)
        if first is not None and first <= watermark:
            new, first = [*(np.frombuffer(x[0], PACKED) for x in self.waiting.get()), *new], None
            self.waiting.clear()
        events = np.concatenate([np.empty(0, PACKED), *new])
        passed = events["at"] // 1000 <= watermark
        ready, rest = events[passed], events[~passed]
        for i in range(0, len(rest), CHUNK):
            self.waiting.appendValue((rest[i : i + CHUNK].tobytes(),))
        if len(rest):
            first = min([int(rest["at"].min()) // 1000] + ([] if first is None else [first]))
        held = tuple(self.lease.get()) if self.lease.exists() else None
        order = np.lexsort((ready["client"], ready["event"], ready["at"]))
        lease, out = transitions(held, ready[order], watermark * 1000, self.seconds, self.sweep)
        if lease != held:
            self.lease.update(lease)
        coming = [] if first is None else [first]
        if lease and lease[0] == "assign" and not lease[4]:
            coming.append(-(-run_out(lease[2], self.seconds, self.sweep) // 1000))
        due = max(min(coming), watermark + 1) if coming else None
        if due != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            if due is not None:
                self.handle.registerTimer(due)
        if (first, due) != told:
            self.next.update((first, due))
        if len(out):
            out = out if self.every else out.tail(1)
            out.insert(0, "batch_id", key[0])
            yield out

    def close(self) -> None:
        pass


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for as long as the block lasts."""
    held = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, held) if held is not None else spark.conf.unset(key)


def lease_log(stream: DataFrame, late: str = "0 seconds", seconds: int = SECONDS, sweep: int = SWEEP, every: bool = True) -> DataFrame:
    """The transitions of each batch, at in microseconds; stream: batch_id, client, event and ts.  It needs Spark's RocksDB
    state, see ``run``.  Without ``every``, only the last that a batch of the stream or a timer brings."""
    place = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event")) - 1
    marked = stream.select("batch_id", "client", place.cast("byte").alias("event"), F.unix_micros("ts").alias("at"), "ts").withWatermark("ts", late)
    # the second half is never true: a filter that reads ts stays above the watermark, which rows without an event move too
    told = marked.where((F.col("event") >= 0) | (F.unix_micros("ts") < F.lit(-(2**63))))
    return told.groupBy("batch_id").transformWithStateInPandas(Leases(seconds, sweep, every), LOG, "append", "eventTime")


def run(log: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run all that there is of a log of leases into a folder, and read it.  Every batch of the stream opens all partitions of
    the state, so there are no more than two for each core, however many the session takes for its tables."""
    spark = log.sparkSession
    partitions = min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism)
    with setting(spark, PROVIDER, ROCKS), setting(spark, PARTITIONS, str(partitions)):
        query = log.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
        query.awaitTermination()
    return spark.read.schema(LOG).parquet(path)


def last_states(batches: DataFrame, log: DataFrame) -> DataFrame:
    """batch_id, client and state of every batch by its last transition; pending without one."""
    place = F.array_position(F.array(*map(F.lit, ["expired", *(STATES[x] for x in EVENTS)])), F.col("state"))  # the order at one time
    last = log.groupBy("batch_id").agg(F.max_by(F.struct("client", "state"), F.struct("at", place, "client")).alias("x"))
    return batches.join(last, "batch_id", "left").select("batch_id", F.coalesce("x.client", F.lit(-1)).alias("client"), F.coalesce("x.state", F.lit("pending")).alias("state"))


def batch_log(events: DataFrame, until, seconds: int = SECONDS, sweep: int = SWEEP) -> DataFrame:
    """The same transitions from a table of events, up to a time in microseconds: windows over each batch's own events."""
    told = events.where(F.col("event").isin(*STATES)).withColumn("at", F.unix_micros("ts")).where(F.col("at") <= until)
    order = W.partitionBy("batch_id").orderBy("at", "event", "client")
    after = told.withColumn("times", F.sum((F.col("event") == "assign").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")).withColumn("next", F.coalesce(F.lead("at").over(order), until))
    end = F.floor(F.col("at") / 1_000_000) + seconds
    end = F.ceil(end / sweep) * sweep * 1_000_000 if sweep else end * 1_000_000 + 1000
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    given = after.select("batch_id", "at", "client", names[F.col("event")].alias("state"), "times")
    expired = after.where((F.col("event") == "assign") & (end <= F.col("next"))).select("batch_id", end.cast("long").alias("at"), "client", F.lit("expired").alias("state"), "times")
    return given.unionByName(expired)
