"""Duplicates, quantile bins, ranks, top-k and gaps in ordered logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ledgers import row_ids, small
from .quantiles import exact_quantiles


def dedup_rows(df: DataFrame, keys: list[str], order: str, keep: str | None = "first") -> DataFrame:
    """One row for each key, the first or last by order; keep None: only rows whose key is theirs alone.

    Nulls equal nulls.  Minima of structs are summed before the shuffle, so a key with very many rows is no burden.
    """
    if missing := set(keys) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    row = F.struct(*df.columns)
    pick = F.max_by(row, order) if keep == "last" else F.min_by(row, order)
    groups = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(pick.alias("_row"), F.count("*").alias("_n"))
    return (groups if keep else groups.where("_n = 1")).select("_row.*")


def dedup_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row by order of each key, found by the key's digest."""
    return df.groupBy(F.sha2(key, 256).alias("_key")).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def quantile_bins(df: DataFrame, value: Column, name: str, q: int = 10, by: list[str] | None = None, duplicates: str = "raise") -> DataFrame:
    """``name``: number of the quantile bin, right-closed, of each row within its group.

    Edges are exact linear quantiles, selected over ranges; equal edges are an error, or merged with duplicates="drop".
    """
    by = by or []
    group = F.lit(0) if not by else F.col(by[0]) if len(by) == 1 else F.to_json(F.struct(*by))
    df = df.withColumn("_group", group)
    bounds = exact_quantiles(df.withColumn("_value", value), "_group", "_value", [i / q for i in range(q + 1)])
    bounds = bounds.select(F.col("_group").alias("_of"), F.col("quantiles").alias("_edges"))
    if duplicates == "drop":
        bounds = bounds.withColumn("_edges", F.array_distinct("_edges"))
    else:
        bounds = bounds.withColumn("_edges", F.when(F.size(F.array_distinct("_edges")) == F.size("_edges"), F.col("_edges")).otherwise(F.raise_error(F.lit("bin edges must be unique"))))
    inner = F.slice(F.col("_edges"), F.lit(2), F.size("_edges") - 2)
    joined = df.join(small(bounds), F.col("_group").eqNullSafe(F.col("_of")))
    return joined.withColumn(name, F.size(F.filter(inner, lambda x: x < value))).drop("_edges", "_group", "_of")


def top_percent(df: DataFrame, score: str, tie: str, percent: float) -> DataFrame:
    """The best int(n * percent / 100) rows; ties keep the earlier.  Numbered over ranges, as k grows with the table."""
    return row_ids(df, F.desc(score), tie, name="_number").where(F.col("_number") <= int(df.count() * percent / 100)).drop("_number")


def top_per_group(df: DataFrame, group: str, order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col(name) <= k)


def rank_of(ranked: DataFrame, query: str, is_original: Column, rank: str) -> DataFrame:
    """Rank of the original of each query, -1 if it is not among its rows."""
    return ranked.groupBy(query).agg(F.coalesce(F.min(F.when(is_original, F.col(rank))), F.lit(-1)).alias("rank"))


def early_stopping(log: DataFrame, trial: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """log with ``best`` so far, epochs ``since`` it rose, and whether training ``stops`` there for the first time."""
    order = W.partitionBy(trial).orderBy(epoch)
    past = F.max(metric).over(order.rowsBetween(W.unboundedPreceding, -1))
    risen = F.when(past.isNull() | (F.col(metric) > past), F.col(epoch))
    marked = log.withColumn("best", F.max(metric).over(order)).withColumn("_risen", risen)
    marked = marked.withColumn("since", F.col(epoch) - F.last("_risen", ignorenulls=True).over(order)).drop("_risen")
    first = F.sum((F.col("since") >= patience).cast("int")).over(order)
    return marked.withColumn("stops", (F.col("since") == patience) & (first == 1))


def best_epoch(log: DataFrame, trial: str, epoch: str, metric: str) -> DataFrame:
    """The earliest epoch with the best metric of each trial."""
    return log.groupBy(trial).agg(F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"), F.max(metric).alias("best"))


def rung_promotions(log: DataFrame, bracket: str, epoch: str, trial: str, metric: str, milestones: list[int], eta: int) -> DataFrame:
    """At each milestone the best ceil(n / eta) trials of a bracket.  Numbered over ranges, as a group grows with the table."""
    rows = log.where(F.col(epoch).isin(milestones))
    numbered = row_ids(rows, bracket, epoch, F.desc(metric), trial, name="_number")
    groups = numbered.groupBy(F.col(bracket).alias("_b"), F.col(epoch).alias("_e")).agg(F.min("_number").alias("_first"), F.count("*").alias("_n"))
    same = F.col(bracket).eqNullSafe(F.col("_b")) & (F.col(epoch) == F.col("_e"))
    ranked = numbered.join(small(groups), same).withColumn("rank", (F.col("_number") - F.col("_first") + 1).cast("int"))
    return ranked.where(F.col("rank") <= F.ceil(F.col("_n") / eta)).select(*log.columns, "rank")
