"""SimHash near-duplicates by tiled exact comparison.

Every document gets a 64-bit fingerprint of its 3-word shingles.  Distinct fingerprints are dealt by the population
counts of their two halves into cells, and each cell into tiles of about TILE fingerprints.  Two tiles whose counts
differ by more than the radius hold no linked pair and never meet; the others are compared exactly with exclusive-or
and bit counts.  A tile pair returns a spanning forest of its links, not all pairs, so a group of many near copies
costs as many rows as it has fingerprints; connected components then follow by alternating star contraction, each round
a few grouped minima and joins written to the shared folder.

The comparisons grow with the square of the number of distinct fingerprints, about a tenth of all pairs.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; rows without doc_id are linked
but never the id of a component that has an id; a component without any id has component_id null; repeated rows share a
fingerprint and a component.  ``keep_one`` passes extra columns through unchanged.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import bound_batches, broadcast_if_small, free, is_small, materialise, own, table

RADIUS, SHINGLE, SEED, TILE = 2, 3, 42, 4096
STRIP, BLOCK = 64, 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        spans = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = map(joined.__getitem__, map(slice, starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x) for x in texts.to_pylist()], np.uint64).view(np.int64))


def spanning_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of fingerprints, or within one: (member, its root) pairs."""
    nodes = a if same else np.concatenate([a, b])
    labels, shift = np.arange(len(nodes)), 0 if same else len(a)
    for top in range(0, len(a), STRIP):
        rows, cols = np.nonzero(np.bitwise_count(a[top:top + STRIP, None] ^ b[None, :]) <= radius)
        rows, cols = rows + top, cols + shift
        apart = labels[rows] != labels[cols]
        rows, cols = rows[apart], cols[apart]
        for row, own in zip(*np.unique(rows, return_index=True)) if len(rows) else ():
            own = cols[own:own + np.searchsorted(rows[own:], row, "right")]
            found = np.unique(np.append(labels[own], labels[row]))
            if len(found) > 1:
                labels[np.isin(labels, found[1:])] = found[0]
    moved = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[moved], nodes[labels[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v) pairs of linked fingerprints that span every component of the links; distinct: one row per ``fp``."""
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)))
    celled = distinct.select("fp", high.cast("int").alias("hi"), low.cast("int").alias("lo"))
    cells = celled.groupBy("hi", "lo").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    cells = F.broadcast(materialise(cells, "simhash-cells"))  # at most 33 * 33 rows
    dealt = celled.join(cells, ["hi", "lo"]).withColumn("no", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiles = materialise(dealt.groupBy("hi", "lo", "no").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("step")
    near = tiles.select(F.col("hi").alias("hi_a"), F.col("lo").alias("lo_a"), F.col("no").alias("no_a"), F.col("fps").alias("a"), step)
    near = near.withColumn("hi", F.col("hi_a") + F.col("step.i")).withColumn("lo", F.col("lo_a") + F.col("step.j")).join(cells, ["hi", "lo"])
    near = near.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    own = (F.col("hi") == F.col("hi_a")) & (F.col("lo") == F.col("lo_a"))
    near = near.where(~own | (F.col("no") >= F.col("no_a"))).withColumn("same", own & (F.col("no") == F.col("no_a")))
    pairs = near.select("hi", "lo", "no", "a", "same").join(tiles.withColumnRenamed("fps", "b"), ["hi", "lo", "no"]).select("a", "b", "same")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(k)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
                u, v = spanning_links(a, b, batch.column(2)[i].as_py(), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every node of the edges (u, v): the smallest node of its connected component.

    Alternating large-star and small-star steps: every node's larger neighbours move to its smallest one, then every
    node's smaller neighbours do, until nothing moves.  Minima are summed before the shuffle and written, so that the
    joins on a hub can be broadcast while small and split by Spark beyond that.
    """

    def moved(pairs: DataFrame, minima: DataFrame) -> DataFrame:
        return pairs.join(broadcast_if_small(materialise(minima, "star-minima")), "u")

    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialise(moved(both.where("v > u"), lowest).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = moved(large, lowest).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        edges = materialise(small.select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct(), "star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select("u", F.col("v").alias("root"))
        state = now


def classes(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fp, root and component_id of every row of docs(doc_id, text)."""
    bound_batches(docs.sparkSession)
    prints = materialise(docs.select("doc_id", fingerprints("text").alias("fp")), "simhash")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius, tile)).withColumnRenamed("u", "fp")
    known = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    known = materialise(known, "simhash-roots")
    lowest = materialise(known.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-lowest")
    known = materialise(known.join(lowest, "root").select("fp", "root", "component_id"), "simhash-classes")
    return prints.join(known, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row with the smallest doc_id of every component; one of those that repeat an id there or have none."""
    name, print_, root, first = free(docs, "_id", "_fp", "_root", "_first")
    found = materialise(classes(docs.select("doc_id", "text"), **options), "simhash-found")
    gone = broadcast_if_small(found.where("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("torn")).where("n > 1")
    repeated = materialise(repeated.select(F.col("doc_id").alias(name), "torn"), "simhash-repeated")
    named, torn, same = docs.where("doc_id IS NOT NULL"), repeated.where("torn").select(name), F.col("doc_id") == F.col(name)
    split = not is_small(torn, 0)  # torn ids have rows in several components
    whole = named.join(broadcast_if_small(torn), same, "left_anti") if split else named
    kept = whole.join(gone, same, "left_anti")
    if not is_small(repeated, 0):
        kept = kept.dropDuplicates(["doc_id"])
    if split:
        roots = found.select(F.col("fp").alias(print_), F.col("root").alias(root), F.col("component_id").alias(first)).where(F.col(first).isNotNull()).distinct()
        rows = named.join(broadcast_if_small(torn), same, "left_semi").withColumn(print_, fingerprints("text"))
        kept = kept.unionByName(rows.join(roots, print_).where(F.col("doc_id") == F.col(first)).dropDuplicates([root]).select(*own(docs)))
    nameless = found.where("component_id IS NULL").select(F.col("fp").alias(print_), F.col("root").alias(root)).distinct()
    if not is_small(nameless, 0):
        alone = docs.where("doc_id IS NULL").withColumn(print_, fingerprints("text")).join(nameless, print_)
        kept = kept.unionByName(alone.dropDuplicates([root]).select(*own(docs)))
    return kept


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
