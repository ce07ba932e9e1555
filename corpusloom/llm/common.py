"""Helpers that the operators of this package share: tables, the shared folder, bounded broadcasts, names."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import work_path as shared_dir

#: White space of the contracts: space, tab, LF, VT, FF, CR.  bytes.split() and bytes.strip() use the same set.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a side that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bound the Arrow batches sent to Python by rows and by bytes, so that long texts do not pile up in one batch.

    Spark reads these settings when a job runs, so they stay; tighter ones of the session are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = spark.conf.get(key)
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, most)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of lineage that outlives executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most this many rows; reads no more than one row beyond them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, rows) else df


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in whatever case: for columns beside a caller's own."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame, *without: str) -> list[Column]:
    """The columns of df, whatever their names, but for some, in whatever case."""
    gone = {c.lower() for c in without}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone]


def per_worker(key: str, make: Callable):
    """What ``make`` gives, made once in a Python worker and kept for its later tasks; few and small things only."""
    held = sys.modules.setdefault("_held_by_worker", types.ModuleType("_held_by_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def n_words(text: Column | str) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
