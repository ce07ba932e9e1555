"""Samples and splits: exact sizes, drawn by a seeded digest of the key, so that every run and engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import draw_key
from .ledgers import row_ids, small


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(draw_key(seed, F.col(key)), key).limit(n)


def sample_percent(df: DataFrame, key: str, percent: float, seed: int) -> DataFrame:
    """About this share of the rows: those whose draw, 32 bits of a digest, lies below it."""
    draw = F.conv(F.substring(draw_key(seed, F.col(key)), 1, 8), 16, 10).cast("long")
    return df.where(draw < int(percent / 100 * (1 << 32)))


def placed(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """df with ``_place`` in its group's seeded order, from 1, and ``_size`` of the group.

    All rows are numbered by group and draw over ranges, so a group with most of the rows is spread over many tasks.
    """
    numbered = row_ids(df.withColumn("_draw", draw_key(seed, F.col(key))), *by, "_draw", key, name="_number")
    groups = numbered.groupBy(*by).agg(F.min("_number").alias("_first"), F.count("*").alias("_size"))
    joined = numbered.join(small(groups), by)
    return joined.select(*df.columns, (F.col("_number") - F.col("_first") + 1).alias("_place"), "_size")


def balance_classes(df: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """As many rows of each class as the smallest has."""
    least = df.groupBy(by).count().agg(F.min("count").alias("_least"))
    return placed(df, [by], key, seed).crossJoin(F.broadcast(least)).where("_place <= _least").drop("_place", "_size", "_least")


def stratified_sample(df: DataFrame, by: list[str], key: str, n: int, strata: int, seed: int) -> DataFrame:
    """n // strata rows of each stratum, all if it has fewer."""
    return placed(df, by, key, seed).where(F.col("_place") <= n // strata).drop("_place", "_size")


def split(df: DataFrame, by: str, key: str, share: float, seed: int, name: str = "is_test", size: Column | None = None) -> DataFrame:
    """``name``: whether a row is among the first int(share * n) of its class in seeded order."""
    many = size if size is not None else F.floor(F.lit(share) * F.col("_size"))
    return placed(df, [by], key, seed).withColumn(name, F.col("_place") <= many).drop("_place", "_size")


def balanced_test_split(df: DataFrame, by: str, key: str, share: float, seed: int) -> DataFrame:
    """As split, with equally many test rows of each class: those of the smallest."""
    least = df.groupBy(by).count().agg(F.floor(F.lit(share) * F.min("count")).alias("_least"))
    marked = placed(df, [by], key, seed).crossJoin(F.broadcast(least))
    return marked.withColumn("is_test", F.col("_place") <= F.col("_least")).drop("_place", "_size", "_least")


def balanced_split(df: DataFrame, by: str, key: str, share: float, seed: int) -> DataFrame:
    """Both classes cut to the smaller, then split."""
    return split(balance_classes(df, by, key, seed), by, key, share, seed + 1)
