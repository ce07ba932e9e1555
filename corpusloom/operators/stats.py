"""Statistics: lengths, duplicates, skips, work, classification, retrieval and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ledgers import small
from .quantiles import exact_quantiles


def length_stats(corpus: DataFrame, code: str = "code", by: str = "class", low: int = 100, high: int = 5000) -> DataFrame:
    """Count, mean, median and deviation of code lengths of each class, before and after the length filter; medians are
    selected over ranges, so that no task holds a class's lengths."""
    sized = corpus.where(F.col(code).isNotNull()).select(by, F.length(code).alias("x"))
    sized = sized.withColumn("y", F.when(F.col("x").between(low, high), F.col("x")))
    stats = lambda c, name: [F.count(c).alias(f"n_{name}"), F.avg(c).alias(f"mean_{name}"), F.stddev_samp(c).alias(f"std_{name}")]
    found = sized.groupBy(by).agg(*stats("x", "all"), *stats("y", "kept"))
    for c, name in (("x", "all"), ("y", "kept")):
        medians = exact_quantiles(sized, by, c, [0.5]).select(F.col(by).alias("_of"), F.col("quantiles")[0].alias(f"median_{name}"))
        found = found.join(small(medians), F.col(by).eqNullSafe(F.col("_of")), "left").drop("_of")
    return found.select(by, *[f"{x}_{name}" for name in ("all", "kept") for x in ("n", "mean", "median", "std")])


def length_histogram(corpus: DataFrame, code: str = "code", by: str = "class", bins: int = 50) -> DataFrame:
    """Equal-width bins of each class between its shortest and longest code: bin from 0, count and density."""
    sized = corpus.where(F.col(code).isNotNull()).select(by, F.length(code).alias("x"))
    ends = sized.groupBy(by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = sized.join(small(ends), by)
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    counted = binned.groupBy(by, at.cast("int").alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    return counted.select(by, "bin", "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def dup_group_stats(df: DataFrame, key: Column) -> DataFrame:
    """Groups of equal keys: their number, mean and largest size, and the rows beyond the first of each."""
    groups = df.groupBy(key.alias("_key")).agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("groups"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))


def dedup_report(df: DataFrame, key: Column) -> DataFrame:
    groups = df.groupBy(key.alias("_key")).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("original"), F.count("*").alias("kept")).withColumn("removed", F.col("original") - F.col("kept"))


def complexity_summary(metrics: DataFrame) -> DataFrame:
    """metrics: depth, node_types, constructs, complex."""
    return metrics.agg(
        F.count("*").alias("n"), F.count_if("complex").alias("n_complex"), (F.count_if("complex") * 100 / F.count("*")).alias("percent_complex"),
        F.avg("depth").alias("mean_depth"), F.avg("node_types").alias("mean_types"), F.avg("constructs").alias("mean_constructs"),
    )


def token_totals(prompt: Column, answer: Column) -> list[Column]:
    """Sums of words and marks; a stand-in for a model's tokenizer, which callers may pass as their own column."""
    count = lambda c: F.coalesce(F.sum(F.regexp_count(c, F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"))), F.lit(0))
    return [count(prompt).alias("prompt_tokens"), count(answer).alias("answer_tokens")]


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "pred").agg(F.count("*").alias("n"))


def class_metrics(predictions: DataFrame, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and specificity of each class; a zero denominator gives 0."""
    each = F.explode(F.array(*map(F.lit, classes))).alias("class")
    rows = predictions.select(each, "label", "pred")
    hit, own = F.col("pred") == F.col("class"), F.col("label") == F.col("class")
    sums = rows.groupBy("class").agg(F.count_if(hit & own).alias("tp"), F.count_if(hit & ~own).alias("fp"), F.count_if(~hit & own).alias("fn"), F.count_if(~hit & ~own).alias("tn"))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return sums.select(
        "class", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(tn, tn + fp).alias("specificity")
    )


def macro_f1_accuracy(predictions: DataFrame) -> DataFrame:
    accuracy = predictions.agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))
    return class_metrics(predictions).agg(F.avg("f1").alias("macro_f1")).crossJoin(accuracy)  # one row each


def class_weights(predictions: DataFrame) -> DataFrame:
    """Total over the class's own count."""
    counts = predictions.groupBy("label").agg(F.count("*").alias("n"))
    return counts.select("label", (F.sum("n").over(W.partitionBy(F.lit(0))) / F.col("n")).alias("weight"))


def retrieval_stats(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """ranks of the originals, -1 if not found: found, mean and median rank, and percent of the found within 1, 5, 10."""
    found = F.when(F.col(rank) > 0, F.col(rank))
    within = [F.coalesce(F.try_divide(F.count_if(found <= k) * 100, F.count(found)), F.lit(0.0)).alias(f"top_{k}") for k in (1, 5, 10)]
    return ranks.agg(F.count(found).alias("found"), F.count_if(F.col(rank) <= 0).alias("not_found"), F.avg(found).alias("mean_rank"), F.median(found).alias("median_rank"), *within)


def rank_histogram(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    return ranks.where(F.col(rank) > 0).groupBy(rank).agg(F.count("*").alias("n"))


def encoding_stats(encoded: DataFrame, column: str = "trees", trees: int = 70, nodes: int = 150) -> DataFrame:
    """Nodes and subtrees of each sample: mean and population deviation, and the share of the padded matrix in use."""
    used = encoded.select(F.size(F.filter(F.flatten(column), lambda x: x != 0)).alias("n"), F.size(column).alias("trees"))
    return used.agg(F.avg("n").alias("mean_nodes"), F.stddev_pop("n").alias("std_nodes"), F.avg("trees").alias("mean_trees"), (F.avg("n") / (trees * nodes)).alias("fill"))


def node_type_topk(sequences: DataFrame, column: str = "nodes", k: int = 10) -> DataFrame:
    counts = sequences.select(F.explode(column).alias("node_type")).groupBy("node_type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "node_type").limit(k)


def id_kinds(ids: Column) -> list[Column]:
    text = ids.cast("string")
    uuid = text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return [F.count_if(text.rlike("^[0-9]+$")).alias("numeric_ids"), F.count_if(uuid).alias("uuid_ids")]


def work_status(states: DataFrame, total: Column) -> DataFrame:
    """Counts of lease_state's states, and what remains of a total."""
    count = lambda x: F.count_if(F.col("state") == x)
    return states.agg(total.alias("total"), count("completed").alias("completed"), count("assigned").alias("active"), (total - count("completed")).alias("remaining"))


def success_rate(responses: DataFrame) -> DataFrame:
    return responses.agg(F.count("*").alias("processed"), F.count_if("failed").alias("failed"), (F.count_if(~F.col("failed")) / F.count("*")).alias("rate"))
