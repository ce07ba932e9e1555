"""Streams into keyed tables: what was seen lies in the table, not in state, and a batch that comes again changes nothing.

A batch reads the buckets that its keys fall in, so its cost and the memory of a task do not grow with the history.  Spark
numbers the batches of a stream; the table's manifest keeps the last number with the version that it made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable


def drained(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run all that there is through ``batch``; a later call goes on where this one ended."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def first_of_each_key(stream: DataFrame, table: KeyedTable, checkpoint: str, name: str, order: str | None = None) -> DataFrame:
    """The table with the first row of each key that the stream brings; of one batch, the first by order."""
    drained(stream, lambda rows, number: table.insert_new(rows, order, (name, number)), checkpoint)
    return table.read()


def windows(rows: DataFrame, ts: str, width: str) -> DataFrame:
    return rows.withColumn("_w", F.window(ts, width)).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("_end"))


def counted_windows(stream: DataFrame, ts: str, table: KeyedTable, checkpoint: str, name: str, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """window_start, n and late: rows of each tumbling window, and those that came after the watermark had passed its end.

    The watermark is the latest time of the batches before, less ``late``; it is kept in the table's manifest, so that a
    batch that comes again, or a restart, sees the same.  A batch is grouped before it meets the table."""
    spark = stream.sparkSession
    micros = int(spark.range(1).select(F.unix_micros(F.lit("1970-01-01 00:00:00Z").cast("timestamp") + F.expr(f"INTERVAL {late}"))).first()[0])

    def add(rows: DataFrame, number: int) -> None:
        manifest = table.manifest()
        if manifest["marks"].get(name, -1) >= number:
            return
        seen = manifest["marks"].get(f"{name}.seen")
        behind = F.lit(False) if seen is None else F.unix_micros("_end") <= F.lit(seen - micros)
        counts = windows(rows.where(F.col(ts).isNotNull()), ts, width).groupBy("window_start").agg(F.count_if(~behind).alias("n"), F.count_if(behind).alias("late"))
        latest = rows.agg(F.max(F.unix_micros(ts))).first()[0]
        notes = {} if latest is None else {f"{name}.seen": latest if seen is None else max(seen, latest)}
        table.combine(counts, {"n": F.sum, "late": F.sum}, (name, number), notes)

    drained(stream, add, checkpoint)
    return table.read()
