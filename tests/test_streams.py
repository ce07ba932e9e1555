"""Streams into keyed tables and leases with timers: repeats, late rows, shuffled logs."""

import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import functions as F

from corpusloom.sources import sinks
from corpusloom.sources.keyed import KeyedTable
from corpusloom.streaming import jobs as J
from corpusloom.streaming import leases as E
from corpusloom.streaming import tables as K

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def in_files(spark, parts):
    """A folder with a file for each list of rows, which a stream takes one by one."""
    path = sinks.work_path(spark, "stream")
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(path)
    return path


def test_the_first_row_of_each_key_is_kept_and_batches_may_come_again(spark):
    schema = "k string, n long"
    path = in_files(spark, [spark.createDataFrame(rows, schema) for rows in ([("a", 2), ("a", 1), (None, 5)], [("a", 0), ("b", 9)], [("b", 1), (None, 7)])])
    table = KeyedTable.create(spark.createDataFrame([], schema), sinks.work_path(spark, "keyed"), "k", 4)
    first = K.first_of_each_key(J.stream_table(spark, path), table, sinks.work_path(spark, "progress"), "s", "n")
    assert {(r.k, r.n) for r in first.collect()} == {("a", 1), (None, 5), ("b", 9)}
    version = table.newest()
    again = K.first_of_each_key(J.stream_table(spark, path), table, sinks.work_path(spark, "progress"), "s", "n")  # all batches anew
    assert table.newest() == version and again.count() == 3


def test_a_batch_reads_the_buckets_of_its_keys_alone(spark, monkeypatch):
    table = KeyedTable.create(spark.range(2000).select(F.col("id").cast("string").alias("k")), sinks.work_path(spark, "keyed"), "k", 64)
    read, plain = [], KeyedTable.of_buckets
    monkeypatch.setattr(KeyedTable, "of_buckets", lambda self, manifest, buckets=None: read.append(buckets) or plain(self, manifest, buckets))
    table.insert_new(spark.createDataFrame([("x",), ("y",), ("7",)], "k string"))
    assert len(read) == 1 and len(read[0]) <= 3
    assert len(table.manifest()["files"]) == 64 and table.read().count() == 2002


def test_windows_count_late_rows_apart(spark):
    at = lambda *seconds: spark.createDataFrame([(START + timedelta(seconds=s),) for s in seconds], "ts timestamp")
    path = in_files(spark, [at(1, 2, 11), at(200, 12), at(3, 13, 195, 300)])  # after 200 the windows up to 140 are over
    table = KeyedTable.create(spark.createDataFrame([], "window_start timestamp, n long, late long"), sinks.work_path(spark, "windows"), "window_start", 4)
    progress = sinks.work_path(spark, "progress")
    found = K.counted_windows(J.stream_table(spark, path), "ts", table, progress, "w")
    seconds = lambda rows: {(int(r.s), r.n, r.late) for r in rows.select((F.unix_seconds("window_start") - int(START.timestamp())).alias("s"), "n", "late").collect()}
    want = {(0, 2, 1), (10, 2, 1), (190, 1, 0), (200, 1, 0), (300, 1, 0)}
    assert seconds(found) == want
    assert seconds(K.counted_windows(J.stream_table(spark, path), "ts", table, sinks.work_path(spark, "progress"), "w")) == want  # repeated batches
    at(5, 301).coalesce(1).write.mode("append").parquet(path)
    assert seconds(K.counted_windows(J.stream_table(spark, path), "ts", table, progress, "w")) == {(0, 2, 2), (10, 2, 1), (190, 1, 0), (200, 1, 0), (300, 2, 0)}


def plain_log(events, until, seconds, sweep):
    """Transitions of every batch, event by event; events: (batch_id, at in seconds, event, client)."""
    out = []
    for batch in {e[0] for e in events}:
        mine = sorted((at, e, c) for b, at, e, c in events if b == batch and e != "none" and at <= until)
        times = 0
        for i, (at, e, c) in enumerate(mine):
            times += e == "assign"
            out.append((batch, at, c, E.STATES[e], times))
            end = -(-(at + seconds) // sweep) * sweep
            if e == "assign" and end <= (mine[i + 1][0] if i + 1 < len(mine) else until):
                out.append((batch, end, c, "expired", times))
    return sorted(out)


def test_leases_of_a_shuffled_log_are_those_of_the_sorted_one(spark):
    rng = random.Random(3)
    base = int(START.timestamp())
    events = [(rng.randrange(6), base + rng.randrange(40_000), rng.choice(["assign", "assign", "submit", "return", "none"]), rng.randrange(3)) for _ in range(150)]
    last = (99, base + 60_000, "none", 0)  # moves the watermark past all that waits
    late = 9000
    events.sort(key=lambda e: e[1])
    shuffled = sorted(events, key=lambda e: e[1] + rng.randrange(late))
    files = [[*shuffled[i:i + 50]] for i in range(0, 150, 50)] + [[last]]
    frame = lambda rows: spark.createDataFrame([(b, datetime.fromtimestamp(at, timezone.utc), e, c) for b, at, e, c in rows], "batch_id long, ts timestamp, event string, client long")
    stream = J.stream_table(spark, in_files(spark, [frame(x) for x in files]))
    held = spark.conf.get(E.PROVIDER, None)
    found = E.run(E.lease_log(stream, f"{late} seconds", 3600, 300), sinks.work_path(spark, "leases"), sinks.work_path(spark, "progress"))
    until = base + 60_000 - late
    want = plain_log(events, until, 3600, 300)
    told = lambda rows: sorted((r.batch_id, r["at"] // 1_000_000, r.client, r.state, r.times) for r in rows.collect())
    assert told(found) == want and {s for _, _, _, s, _ in want} == {"assigned", "expired", "completed", "pending"}
    assert told(E.batch_log(frame(events), F.lit(until * 1_000_000))) == want
    assert spark.conf.get(E.PROVIDER, None) == held
    states = {r.batch_id: (r.client, r.state) for r in E.last_states(frame([*events, (50, base, "none", 1)]).select("batch_id").distinct(), found).collect()}
    assert states[50] == (-1, "pending") and len(states) == 7


def test_a_lease_that_ran_out_is_given_out_again():
    second = 1_000_000
    lease, out = E.advanced(None, [(0, "assign", 1)], 100 * second, 3600, 300)
    assert out == [(0, 1, "assigned", 1)] and not lease[4]
    lease, out = E.advanced(lease, [(4000 * second, "assign", 2)], 4000 * second, 3600, 300)
    assert out == [(3600 * second, 1, "expired", 1), (4000 * second, 2, "assigned", 2)]
    lease, out = E.advanced(lease, [], 7800 * second, 3600, 300)
    assert out == [(7800 * second, 2, "expired", 2)] and lease[4] and E.advanced(lease, [], 9999 * second, 3600, 300)[1] == []
    assert E.advanced(lease, [(8000 * second, "submit", 2)], 9999 * second, 3600, 300)[1] == [(8000 * second, 2, "completed", 2)]
    assert E.run_out(1_500_000, 3600, 0) == 3601_001_000 and E.run_out(0, 3600, 300) == 3600 * second


class Held:
    """A lease batch's state in plain values; ``values`` counts what was put into the list, ``reads`` how often it was read."""

    def __init__(self):
        self.list, self.held, self.timers, self.values, self.reads = [], {}, [], 0, 0

    def getListState(self, name, schema):
        top = self

        class List:
            def get(self):
                top.reads += 1
                return iter(top.list)

            def put(self, values):
                top.list, top.values = list(values), top.values + len(values)

            def appendValue(self, value):
                top.list.append(value)
                top.values += 1

            def clear(self):
                top.list = []

        return List()

    def getValueState(self, name, schema):
        held = self.held

        class Value:
            exists = lambda self: name in held
            get = lambda self: held.get(name)
            update = lambda self, value: held.update({name: value})

        return Value()

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_events_that_wait_are_few_values_read_once_with_one_timer(monkeypatch):
    second = 1_000_000
    events = [(at * second, E.EVENTS[at % 3], at % 7) for at in range(1, 3001)]
    monkeypatch.setattr(E, "CHUNK", 400)
    processor, held = E.Leases(100, 0), Held()
    processor.init(held)
    pack = lambda rows: [E.np.array([(at, E.EVENTS.index(e), c) for at, e, c in rows], E.PACKED)]
    told = lambda frames: [tuple(r)[1:] for out in frames for r in out.itertuples(index=False)]
    assert told(processor.step((1,), pack(events[:1000][::-1]), 0)) == [] and held.values == 3 and held.timers == [1000]
    found = told(processor.step((1,), pack(events[1000:2000]), 1_000_000))
    assert held.values == 6 and held.reads == 1 and held.timers == [1_001_000]
    found += told(processor.step((1,), pack(events[2000:]), 1_000_500))  # nothing is ripe, so nothing is read
    assert held.values == 9 and held.reads == 1 and len(found) == 1000
    found += told(processor.step((1,), [], 9_000_000))
    assert held.reads == 2 and held.list == [] and held.timers == []
    lease, want = E.advanced(None, events, 9_000_000_000, 100, 0)
    assert found == want and held.held["lease"] == lease
    last = E.Leases(100, 0, every=False)
    last.init(Held())
    assert told(last.step((1,), pack(events), 9_000_000)) == want[-1:]


def test_packed_events_give_the_transitions_of_single_ones():
    rng = random.Random(5)
    for _ in range(200):
        events = sorted((rng.randrange(40) * 500_000, rng.choice(E.EVENTS), rng.randrange(3)) for _ in range(rng.randrange(12)))
        cut, sweep = rng.randrange(len(events) + 1), rng.choice([0, 2])
        until, whole = 25_000_000, E.advanced(None, events, 25_000_000, 3, sweep)
        lease, first = E.advanced(None, events[:cut], events[cut - 1][0] if cut else 0, 3, sweep)
        parts = E.advanced(lease, events[cut:], until, 3, sweep)
        assert (parts[0], first + parts[1]) == whole
        out, lease = [], None  # one by one
        for at, event, client in [*events, (until, "", 0)]:
            if lease and lease[0] == "assign" and not lease[4] and (end := E.run_out(lease[2], 3, sweep)) <= at:
                out.append((end, lease[1], "expired", lease[3]))
                lease = (*lease[:4], True)
            if event:
                times = (lease[3] if lease else 0) + (event == "assign")
                lease = (event, client, at, times, False)
                out.append((at, client, E.STATES[event], times))
        assert whole == (lease, out)


def test_the_state_of_leases_has_no_more_partitions_than_tasks_run(spark):
    frame = spark.createDataFrame([(b, 1, "assign", START + timedelta(seconds=b)) for b in range(50)], "batch_id long, client long, event string, ts timestamp")
    progress = sinks.work_path(spark, "progress")
    with E.setting(spark, "spark.sql.shuffle.partitions", "60"):
        found = E.run(E.lease_log(J.stream_table(spark, in_files(spark, [frame]))), sinks.work_path(spark, "leases"), progress)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
    state = [x.name for x in Path(progress.removeprefix("file://"), "state", "0").iterdir() if x.name.isdigit()]
    assert len(state) == 2 * spark.sparkContext.defaultParallelism and found.count() == 50


def test_of_one_time_the_last_transition_counts(spark):
    log = spark.createDataFrame([(1, 5, 1, "expired", 1), (1, 5, 2, "assigned", 2), (2, 5, 1, "pending", 1), (2, 5, 0, "completed", 1), (3, 4, 1, "assigned", 1), (3, 5, 1, "expired", 1)], E.LOG)
    found = E.last_states(log.select("batch_id").distinct(), log)
    assert {(r.batch_id, r.client, r.state) for r in found.collect()} == {(1, 2, "assigned"), (2, 0, "completed"), (3, 1, "expired")}
