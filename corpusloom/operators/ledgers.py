"""Joins with ledgers and request tables: what is done, what is pending, what may be taken next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import work_path


#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows, else as it is; for a row per group, where the groups are a caller's."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def processed(*ledgers: DataFrame) -> DataFrame:
    """Distinct keys of all ledgers."""
    return reduce(DataFrame.union, ledgers).distinct()


def pending(rows: DataFrame, key: str, *ledgers: DataFrame) -> DataFrame:
    """Rows whose key is in no ledger."""
    return reduce(lambda left, done: left.join(done.select(key), key, "left_anti"), ledgers, rows)


def probe(keys: DataFrame, key: str, **ledgers: DataFrame) -> DataFrame:
    """keys with a flag for each ledger that holds them."""
    for name, held in ledgers.items():
        keys = keys.join(held.select(key, F.lit(True).alias(name)).distinct(), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return keys


def accept_known(results: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return results.join(known.select(key), key, "left_semi")


def upsert_ignore(new: DataFrame, old: DataFrame, key: str, order: str) -> DataFrame:
    """The rows to append: one for each new key, the first by order."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("_row")).select("_row.*")
    return first.join(old.select(key), key, "left_anti").select(*new.columns)


def upsert_flag(new: DataFrame, old: DataFrame, key: str = "hash") -> DataFrame:
    """One row for each key: completed if either says so, with the earliest created_at."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.bool_or("completed").alias("completed"), F.min("created_at").alias("created_at"))


def delete_matched(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def join_responses(responses: DataFrame, requests: DataFrame, key: str = "custom_id") -> DataFrame:
    """Every response with its request; ``failed`` also where no request is known."""
    known = requests.withColumn("_known", F.lit(True))
    joined = responses.join(known, key, "left")
    return joined.withColumn("failed", F.col("failed") | F.col("_known").isNull()).drop("_known")


def lease_state(log: DataFrame, now: Column, seconds: int) -> DataFrame:
    """The last event of each batch: done after submit, pending after return, assigned until the lease ends, else expired."""
    events = log.where(F.col("event").isin("assign", "submit", "return"))
    last = events.groupBy("batch_id").agg(F.max_by(F.struct("event", "client", "ts"), F.struct("ts", "event_id")).alias("x"))
    live = F.unix_timestamp(now) - F.unix_timestamp(F.col("x.ts")) <= seconds
    state = F.when(F.col("x.event") == "submit", "completed").when(F.col("x.event") == "return", "pending").when(live, "assigned").otherwise("expired")
    return last.select("batch_id", F.col("x.client").alias("client"), state.alias("state"))


def next_work(rows: DataFrame, states: DataFrame, key: str, n: int, order: Column) -> DataFrame:
    """Up to n rows that are neither done nor under a living lease."""
    busy = states.where(F.col("state").isin("completed", "assigned")).select(F.col("batch_id").alias(key))
    return rows.join(busy, key, "left_anti").orderBy(order, key).limit(n)


def assign_batches(rows: DataFrame, number: str, size: int) -> DataFrame:
    """``batch_no`` of consecutive chunks; number: from 1."""
    return rows.withColumn("batch_no", F.floor((F.col(number) - 1) / size))


def assign_workers(rows: DataFrame, number: str, workers: int, per_worker: int) -> DataFrame:
    """Round robin, and contiguous ranges whose remainder goes to the last worker."""
    ranged = F.least(F.floor((F.col(number) - 1) / per_worker), F.lit(workers - 1))
    return rows.withColumn("round_robin", F.pmod(F.col(number), F.lit(workers))).withColumn("ranged", ranged)


def row_ids(df: DataFrame, *order: str | Column, name: str = "row_id") -> DataFrame:
    """``name``: numbers from 1 in an order that tells all rows apart: sorted ranges, their counts, and positions within them, so
    that no task holds more than its range.  The ranges are written first, for both readers must see the same."""
    spark = df.sparkSession
    path = work_path(spark, "ranges")
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    numbered = ranged.withColumn("_within", within).join(F.broadcast(before), "_part")  # a row for each range
    return numbered.select(*df.columns, (F.col("_before") + F.col("_within")).alias(name))
