"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, a water level turns weights into targets, targets into repetition rates, and every
document is emitted floor(rate) times plus one more copy with probability equal to the fraction.  The draw is a seeded
md5 of the document's id, so reruns and lost executors give the same mix.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own and ranks last; rows that repeat
a doc_id share one draw; rows without doc_id draw by their text; an empty table gives an empty result; a source of size
0 has target 0.  ``with_copies`` takes the name of the column that it adds, in place of a caller's column of that name;
other columns pass through both functions unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ledgers import row_ids
from .common import free, is_small, materialise, n_words, own, table

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
#: Sources that may be broadcast and that one window may hold; with more of them the join is salted and the level is
#: found by sums.
MAX_BROADCAST_SOURCES, SALTS = 100_000, 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, few: int = MAX_BROADCAST_SOURCES) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target, rate.

    Targets are min(weight * level, cap * size) with the one level at which they sum to share * total.  Up to ``few``
    sources are ranked and their level is found in windows; more are ranked over ranges and their level is found by sums.
    """
    per_source = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    by_source, small = F.col("source").asc_nulls_last(), is_small(per_source, few)
    ranked = per_source.withColumn("rank", F.row_number().over(W.orderBy(by_source))) if small else row_ids(per_source, by_source, name="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight).withColumn("limit", F.lit(cap) * F.col("source_size"))
    weighed = windowed_level(weighed, share) if small else weighed.withColumn("level", F.lit(summed_level(materialise(weighed, "mix-weighed"), share)))
    targets = weighed.withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("limit")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return targets.select("source", "source_size", "target", rate.alias("rate"))


def windowed_level(weighed: DataFrame, share: float) -> DataFrame:
    """With the sources in order of limit / weight and those before k at their limit, k's level is (budget - limits before
    k) / (weights from k on); it rises up to the true level and falls after it, so the maximum is the level."""
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = weighed.withColumn("own", (F.lit(share) * F.sum("source_size").over(every) - before) / left)
    return levels.withColumn("level", F.max("own").over(every))


def summed_level(weighed: DataFrame, share: float) -> float:
    """The same level: the excess of sources at their limit is shared anew among the others until no more of these reach theirs."""
    budget, left = weighed.agg(F.lit(share) * F.sum("source_size"), F.sum("weight")).first()
    capped, level = 0.0, 0.0
    while left and (budget - capped) / left > level:
        level = (budget - capped) / left
        over = F.col("weight") * level > F.col("limit")
        capped, left = weighed.agg(F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0.0)), F.sum(F.when(~over, F.col("weight")))).first()
    return level if left or budget is None else float("inf")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone: 52 bits of an md5."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double")
    return bits / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, seed: str = SEED, salted: bool | None = None, into: str = "_mix", **mix) -> DataFrame:
    """docs with a struct column ``into`` of size, source_size, target and copies.

    The targets are broadcast while there are at most MAX_BROADCAST_SOURCES; otherwise the join is salted, so that one
    source with a third of all rows still spreads over SALTS partitions.
    """
    size, (aim, salt) = n_words("text"), free(docs, "_target", "_salt")
    targets = materialise(source_targets(docs.select("source", size.alias("size")), **mix), "mix-targets")
    targets = targets.select(F.struct("source", "source_size", "target", "rate").alias(aim))
    if salted is None:
        salted = not is_small(targets, MAX_BROADCAST_SOURCES)
    same = F.col("source").eqNullSafe(F.col(f"{aim}.source"))
    if salted:
        targets = targets.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = docs.join(targets, same & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)) == F.col(salt)))
    else:
        joined = docs.join(F.broadcast(targets), same)
    rate = F.col(f"{aim}.rate")
    whole = F.floor(rate)
    extra = (draw(F.col("doc_id"), F.col("text"), seed) < rate - whole).cast("long")
    mixed = F.struct(size.alias("size"), F.col(f"{aim}.source_size"), F.col(f"{aim}.target"), (whole + extra).cast("long").alias("copies"))
    return joined.select(*own(docs, into), mixed.alias(into))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as the mix takes it."""
    mixed, copy = free(docs, "_mix", "_copy")
    taken = with_copies(docs, into=mixed, **options).where(F.col(f"{mixed}.copies") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{mixed}.copies"))).alias(copy)
    return taken.select(*own(docs), copies).drop(copy)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_copies(docs).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.copies") * F.col("_mix.size")).alias("taken"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT *, least(weight * max(level) OVER (), cap) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target, (d.size * (floor(r.rate) + CASE WHEN
  ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'text:' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
  < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
