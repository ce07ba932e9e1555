"""Exact quantiles of groups by selection over ranges.

The ranks that a quantile lies between are looked for in equal ranges between a group's smallest and largest value: rows are
counted by range, the range that holds the rank is taken, and the next pass reads its rows alone, until they are few or all
alike.  A pass sends a count for each range and task; no task holds a group's values, however many are distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import work_path, write_parquet
from .ledgers import small

#: Ranges of a pass, and rows of a range that are put in order.
RANGES, FEW = 1024, 100_000


def exact_quantiles(rows: DataFrame, group: str, value: str, shares: list[float], few: int = FEW) -> DataFrame:
    """A row for each group, nulls too: the group's column, ``n`` and ``quantiles``, an array of doubles in the order of the
    shares; values between two ranks are interpolated between them.  Null and NaN values take no part; groups without values
    are left out.  Where no group has more than ``few`` values, Spark puts each in order in one task."""
    spark = rows.sparkSession
    told = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    if told.groupBy("g").count().where(F.col("count") > few).limit(1).count() == 0:
        exact = F.percentile("x", F.array(*[F.lit(float(p)) for p in shares])).alias("quantiles")
        return told.groupBy("g").agg(F.count("*").alias("n"), exact).withColumnRenamed("g", group)
    told = write_parquet(told, work_path(spark, "values"))
    groups = write_parquet(told.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), work_path(spark, "groups"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(shares)]))
    # a target: the value of a rank, from 0, which is looked for between lo and hi, with ``before`` values below lo
    targets = groups.select("g", "lo", "hi", wanted.alias("w")).select("g", "lo", "hi", F.explode(F.array(F.floor("w.at"), F.ceil("w.at"))).alias("rank")).distinct()
    open_ = write_parquet(targets.withColumn("before", F.lit(0).cast("long")), work_path(spark, "targets"))
    found = None
    while True:
        done, open_ = one_pass(told, open_, few)
        found = done if found is None else found.unionByName(done)
        if open_.limit(1).count() == 0:
            break
        ends = open_.select("g", "lo", "hi").distinct()
        told = write_parquet(told.join(small(ends), told.g.eqNullSafe(ends.g) & (told.x >= ends.lo) & (told.x <= ends.hi), "left_semi"), work_path(spark, "values"))
    ranked = found.select(F.col("g").alias("h"), F.col("rank").alias("r"), F.col("x").alias("v"))
    asked = groups.select("g", "n", wanted.alias("w")).select("g", "n", "w.i", "w.at")
    same = F.col("g").eqNullSafe(F.col("h"))
    low = asked.join(ranked, same & (F.floor("at") == F.col("r"))).select("g", "n", "i", "at", F.col("v").alias("low"))
    both = low.join(ranked, same & (F.ceil("at") == F.col("r"))).withColumn("q", F.col("low") + (F.col("at") - F.floor("at")) * (F.col("v") - F.col("low")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"])  # one for each share
    return both.groupBy("g", "n").agg(listed.alias("quantiles")).withColumnRenamed("g", group)


def one_pass(told: DataFrame, targets: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """(found, open): targets whose value this pass tells, as g, rank and x, and the others with the range that holds theirs."""
    spark = told.sparkSession
    width = (F.col("hi") - F.col("lo")) / RANGES
    aims = targets.select(F.col("g").alias("h"), "lo", "hi", "before", "rank")
    met = told.join(small(aims), told.g.eqNullSafe(aims.h) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    bin_ = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(RANGES - 1))).otherwise(F.lit(0)).cast("int")
    counts = met.groupBy(F.col("h").alias("g"), "rank", "before", bin_.alias("bin")).agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    order = W.partitionBy("g", "rank").orderBy("bin")  # at most RANGES rows
    summed = counts.withColumn("up", F.col("before") + F.sum("m").over(order))
    held = summed.where((F.col("up") > F.col("rank")) & (F.col("up") - F.col("m") <= F.col("rank"))).select("g", "rank", "lo", "hi", "m", (F.col("up") - F.col("m")).alias("before"))
    held = write_parquet(held, work_path(spark, "ranges"))
    alike, rest = held.where("lo = hi"), held.where("lo < hi")
    short, long = rest.where(F.col("m") <= few), rest.where(F.col("m") > few)
    aims = short.select(F.col("g").alias("h"), "lo", "hi", "before", "rank")
    near = told.join(small(aims), told.g.eqNullSafe(aims.h) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    values = near.groupBy(F.col("h").alias("g"), "rank", "before", "x").agg(F.count("*").alias("m"))
    up = values.withColumn("up", F.col("before") + F.sum("m").over(W.partitionBy("g", "rank").orderBy("x")))  # at most ``few`` rows
    told_here = up.where((F.col("up") > F.col("rank")) & (F.col("up") - F.col("m") <= F.col("rank"))).select("g", "rank", "x")
    found = write_parquet(alike.select("g", "rank", F.col("lo").alias("x")).unionByName(told_here), work_path(spark, "found"))
    return found, long.select("g", "lo", "hi", "rank", "before")
