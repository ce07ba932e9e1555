"""Exact top-k inner products by MaxScore over shards of postings.

A vector's components become integer term weights: dimension d is the terms d+ and d-, whose postings hold the positive
and the negated negative components, each as sorted positions and weights.  A vector is in at most one of the two, so
dimension d adds at most the query's weight times the largest posting of the one that has its sign: d's bound.

A shard is dealt into blocks.  In a block each query's dimensions are sorted by bound; the non-essential ones are the
longest run of smallest bounds whose sum stays below PRUNE of the score to beat, the k-th best so far.  The postings of
the essential ones are traversed and give candidates; the others are probed in falling order of bound, only for
candidates that are still competitive.  A block whose bounds all together do not reach the score to beat is skipped.

All vectors are shuffled once, into tasks that build shards of at most MAX_SHARD rows.  The queries are written to the
shared folder, with the k-th best score that each has among a few vectors as the first score to beat; every task reads
them in parts of QUERIES.  So a shard returns few rows, those that beat it, and the shards are merged.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without vec_id take no part; a
shorter vector counts as zero in the missing dimensions; ties go to the smaller vec_id; all rows that share the query's
vec_id count as its own; a repeated query row is one query, two vectors of one query_id are two; scores beyond 64 bits
are held at the largest or smallest long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, materialise, shared_dir, table

K, SCALE, EVERY = 5, 256, 50
#: Rows of a shard at most, of a block within it, of the pilot that sets the first scores to beat; queries of a part and
#: of a step.  They bound memory; results do not depend on them.
MAX_SHARD, BLOCK, PILOT, QUERIES, STEP = 32_768, 2048, 4096, 1024, 128
#: Share of the score to beat that the non-essential bounds may reach; the lower, the fewer candidates are probed.
PRUNE = 0.5
#: Sums of these sizes are exact in floats of single and double precision.
SINGLE, DOUBLE = float(1 << 24), float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(vectors: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of each row, padded with zeros: floats while these are exact, else Python integers."""
    sizes = np.diff(vectors.offsets.to_numpy(zero_copy_only=False))
    width, values = int(sizes.max(initial=0)), vectors.flatten().to_numpy(zero_copy_only=False)
    padded = np.zeros((len(vectors), width))
    padded[np.arange(width) < sizes[:, None]] = values
    with np.errstate(over="ignore"):
        scaled = np.floor(padded * SCALE)
    if np.abs(scaled).max(initial=0) < DOUBLE:
        return scaled
    exact = [[SCALE * int(x) if abs(x) > DOUBLE else math.floor(SCALE * x) for x in row] for row in padded.tolist()]
    return np.array(exact, object).reshape(len(vectors), width)


def exact_type(a: np.ndarray, b: np.ndarray):
    """The narrowest type in which all inner products of the rows of a and b are exact."""
    most = max(1, a.shape[1], b.shape[1]) * max(1, np.abs(a).max(initial=0)) * max(1, np.abs(b).max(initial=0))
    return np.float32 if most < SINGLE else np.float64 if most < DOUBLE else object


def fitted(m: np.ndarray, width: int, kind) -> np.ndarray:
    """m in a type, cut or padded with zeros to a width."""
    m = m[:, :width]
    if kind is object and m.dtype != object:
        m = np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    out = np.zeros((len(m), width), kind)
    out[:, : m.shape[1]] = m
    return out


class Block:
    """Vectors in order of id, the postings of every signed term, and the largest weight of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.postings = ids, vectors, []
        for column in vectors.T:
            plus, minus = np.flatnonzero(column > 0), np.flatnonzero(column < 0)
            self.postings.append((plus, column[plus], minus, -column[minus]))
        self.most = tuple(np.array([w.max() if len(w) else 0 for w in weights], vectors.dtype) for weights in ([p[1] for p in self.postings], [p[3] for p in self.postings]))

    def candidates(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, position and exact score of all vectors that score at least what is to beat; least: -inf for none yet."""
        bounds = np.where(queries > 0, queries * self.most[0], -queries * self.most[1])
        order = np.argsort(bounds, axis=1, kind="stable")
        rising = np.take_along_axis(bounds, order, 1)
        sums = np.cumsum(rising, axis=1)
        reach = least * PRUNE if least.dtype != object else np.array([x if x == -np.inf else x // 2 for x in least], object)
        split = (sums < reach[:, None]).sum(1)
        rest = np.where(split > 0, np.take_along_axis(sums, np.maximum(split - 1, 0)[:, None], 1)[:, 0], 0)
        essential = np.zeros(queries.shape, bool)
        np.put_along_axis(essential, order, np.arange(queries.shape[1]) >= split[:, None], 1)
        weights = np.where(essential, queries, 0)
        scores = np.zeros((len(self.ids), len(queries)), queries.dtype)
        for d in np.flatnonzero(weights.any(0)):
            plus, more, minus, less = self.postings[d]
            scores[plus] += more[:, None] * weights[:, d]
            scores[minus] -= less[:, None] * weights[:, d]
        at, who = np.nonzero((scores + rest >= least) & (self.ids[:, None] != own))
        found = scores[at, who]
        for j in range(int(split.max(initial=0)) - 1, -1, -1):
            open_, d = split[who] > j, order[who, j]
            found = found + np.where(open_, self.vectors[at, d] * queries[who, d], 0)
            # what the terms not yet probed can add at most
            left = np.where(open_, sums[who, j - 1] if j else 0, rest[who])
            still = found + left >= least[who]
            at, who, found = at[still], who[still], found[still]
        return who, at, found


class Shard:
    """Vectors in order of id, dealt into blocks, which are built in the types that queries need."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.size, self.blocks = ids[order], vectors[order], block, {}

    def made(self, kind, width: int) -> list[Block]:
        if kind not in self.blocks:
            rows = fitted(self.vectors, width, kind)
            self.blocks[kind] = [Block(self.ids[i:i + self.size], rows[i:i + self.size]) for i in range(0, len(rows), self.size)]
        return self.blocks[kind]

    def search(self, queries: np.ndarray, own: np.ndarray, floors: list, k: int):
        """(query, id, score) of each query's k best, none below its floor (None: no floor)."""
        kind, width = exact_type(queries, self.vectors), max(1, self.vectors.shape[1])
        queries, blocks = fitted(queries, width, kind), self.made(kind, width)
        for first in range(0, len(queries), STEP):
            last = first + STEP
            for q, name, score in self.step(blocks, queries[first:last], own[first:last], floors[first:last], k):
                yield first + q, name, score

    @staticmethod
    def step(blocks: list[Block], queries: np.ndarray, own: np.ndarray, floors: list, k: int):
        least = np.array([-np.inf if x is None else x for x in floors], queries.dtype)
        top: list[list[tuple]] = [[] for _ in queries]
        for block in blocks:
            most = (np.where(queries > 0, queries * block.most[0], -queries * block.most[1])).sum(1)
            alive = np.flatnonzero(most >= least)
            who, at, scores = block.candidates(queries[alive], own[alive], least[alive])
            ids = block.ids[at]
            order = np.lexsort((ids, -scores, who)) if scores.dtype != object else np.array(sorted(range(len(who)), key=lambda i: (who[i], -scores[i], ids[i])), np.int64)
            who, scores, ids = who[order], scores[order], ids[order]
            starts = np.flatnonzero(np.diff(who, prepend=-1))
            for start, end in zip(starts.tolist(), [*starts.tolist()[1:], len(who)]):
                q, end = alive[who[start]], min(end, start + k)
                top[q] = sorted([*top[q], *zip((-scores[start:end]).tolist(), ids[start:end].tolist())])[:k]
                if len(top[q]) == k:
                    least[q] = max(least[q], -top[q][-1][0])
        for q, found in enumerate(top):
            for score, name in found:
                yield q, name, -int(score)


def found_in(rows: DataFrame, path: str, k: int) -> DataFrame:
    """query_id, key, vec_id and score: each query's k best of every shard of rows; path: the written queries."""

    def parts():
        store, folder = pyarrow.fs.FileSystem.from_uri(path)
        for batch in pyarrow.dataset.dataset(folder, filesystem=store, format="parquet").to_batches(batch_size=QUERIES, batch_readahead=1, fragment_readahead=1):
            if batch.num_rows:
                yield (*(batch.column(c) for c in ("query_id", "key", "v", "floor")),)

    def answers(held: list[pa.RecordBatch]):
        vectors = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        shard = Shard(vectors.column(0).to_numpy(), integers(vectors.column(1)))
        for names, keys, asked, floors in parts():
            rows = list(shard.search(integers(asked), names.to_numpy(), floors.to_pylist(), k))
            if rows:
                who, ids, scores = zip(*rows)
                at = pa.array(who, pa.int64())
                scores = pa.array([min(max(x, LONG[0]), LONG[1]) for x in scores], pa.int64())
                yield pa.RecordBatch.from_arrays([names.take(at), keys.take(at), pa.array(ids, pa.int64()), scores], ["query_id", "key", "vec_id", "score"])

    def search(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= MAX_SHARD:
                yield from answers(held)
                held, n = [], 0
        if held:
            yield from answers(held)

    return rows.mapInArrow(search, "query_id long, key long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def floors_of(asked: DataFrame, pilot: DataFrame, k: int) -> DataFrame:
    """q, h and floor: a score that the k-th best of all reaches, as the k-th best of any rows does, for each query of asked
    that has k others among the pilot's bounded rows, which are sent to the tasks that hold the queries."""
    held = pilot.toArrow()  # at most PILOT vectors
    ids, vectors = held.column("vec_id").to_numpy(), held.column("v").combine_chunks()
    sent = pilot.sparkSession.sparkContext.broadcast((ids, integers(vectors)))

    def scored(batches):
        ids, base = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                queries = integers(part.column("v"))
                kind, width = exact_type(queries, base), max(queries.shape[1], base.shape[1])
                scores = fitted(queries, width, kind) @ fitted(base, width, kind).T
                own = part.column("query_id").to_numpy(zero_copy_only=False)[:, None] == ids
                names, keys, found = [], [], []
                for row, mine, q, h in zip(scores, own, part.column("query_id").to_pylist(), part.column("key").to_pylist()):
                    rest = row[~mine]
                    if len(rest) >= k:
                        least = int(np.sort(rest)[len(rest) - k] if kind is object else np.partition(rest, len(rest) - k)[len(rest) - k])
                        if LONG[0] < least <= LONG[1]:
                            names, keys, found = [*names, q], [*keys, h], [*found, least]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, keys, found)], ["q", "h", "floor"])

    return asked.select("query_id", "key", "v").mapInArrow(scored, "q long, h long, floor long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, shards: int | None = None, pilot: int = PILOT) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best among all rows of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asked"))
    n = rows.count()
    asked = materialise(rows.where("asked").select(F.col("vec_id").alias("query_id"), "v").distinct().withColumn("key", F.xxhash64("v")), "maxscore-asked")
    rows = rows.select("vec_id", "v")
    floors = floors_of(asked, rows.limit(pilot), k)
    path = shared_dir(spark, "maxscore-queries")
    same = (F.col("query_id") == F.col("q")) & (F.col("key") == F.col("h"))
    asked.join(floors, same, "left").select("query_id", "key", "v", "floor").write.parquet(path)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / MAX_SHARD))
    return best(found_in(rows.repartition(shards), path, k), k).select("query_id", "rank", "vec_id", "score")


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


OP4_SQL = f"""
WITH e AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]), 0)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
