"""An inverted file of vectors with quantised residuals, and approximate neighbours by it.

Vectors are of length one, so a product is a cosine.  Their number gives the number of cells, its root; centres and code
books are fitted on bounded samples, every row is indexed.  A row is its cell and a code: its distance from the centre in
parts of a few components, each the number of the nearest of at most 256 words.  A search reads codes only: tasks hold
ranges of cells, so that a hot cell is split, read the queries that probe their cells from the shared folder in blocks and
look the codes up in the books.  The best by codes are rated again by their vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import work_path, write_parquet

#: Words of a book, rows that books are fitted on, rows for each centre that the centres are fitted on, rounds of a fit.
WORDS, SAMPLE, PER_CELL, ROUNDS = 256, 20_000, 40, 10
#: Components that one word stands for.
PART = 4
#: Queries that a task holds at a time, and rows that it multiplies at a time.
BLOCK, ROWS = 256, 8192


def normalised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors of length one; null, empty and zero vectors take no part."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select(F.col(key).alias("id"), v.alias("v"), norm.alias("n")).where("n > 0").select("id", F.transform("v", lambda x: x / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).alias("v"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list array, padded with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy(zero_copy_only=False))
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The number of the nearest word of each row, in blocks."""
    half = (words * words).sum(1) / 2
    found = [np.argmax(rows[i:i + ROWS] @ words.T - half, axis=1) for i in range(0, len(rows), ROWS)]
    return np.concatenate([*found, np.zeros(0, np.int64)])


def fitted_words(rows: np.ndarray, many: int, seed: int = 7) -> np.ndarray:
    """At most so many words near the rows, by rounds of assigning rows and averaging them; few distinct rows are their own words."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= many:
        return distinct
    words = distinct[np.random.default_rng(seed).choice(len(distinct), many, replace=False)]
    for _ in range(ROUNDS):
        at = nearest(rows, words)
        sizes = np.bincount(at, minlength=many)
        sums = np.stack([np.bincount(at, weights=rows[:, j], minlength=many) for j in range(rows.shape[1])], axis=1)
        words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], words)
    return words


@dataclass
class VectorIndex:
    """Written tables of vectors (id, v) and codes (id, cell, code), with the centres and the words of each part."""

    vectors: DataFrame
    codes: DataFrame
    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def decoded(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, looked up part by part."""
        return self.centres[cells] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)


def build(vectors: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """An index of all vectors that are not null, empty or zero; cells: as many as the root of their number unless given.

    Centres are fitted on the PER_CELL * cells, at least ``sample``, rows with the smallest digests, by Spark; the books on
    ``sample`` of these, on the driver."""
    spark = vectors.sparkSession
    base = write_parquet(normalised(vectors, key, vector), work_path(spark, "vectors"))
    rows, width = base.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    many = max(1, cells or round(rows**0.5))
    padded = base.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))).alias("v"))
    drawn = write_parquet(padded.orderBy(F.xxhash64("id"), "id").limit(max(sample, PER_CELL * many)), work_path(spark, "drawn"))
    centres = np.zeros((1, width))
    if many > 1 and rows > 1:
        centres = np.array(KMeans(k=many, seed=7, maxIter=ROUNDS).fit(drawn.select(array_to_vector("v").alias("features"))).clusterCenters())
    few = matrix(drawn.select("v").limit(sample).toArrow().column("v").combine_chunks())  # at most sample rows
    few = widened(few, width)
    apart = few - centres[nearest(few, centres)]
    books = [fitted_words(apart[:, i:i + PART], WORDS) if rows else np.zeros((1, PART)) for i in range(0, width, PART)]
    held = spark.sparkContext.broadcast((centres, books))

    @F.arrow_udf("struct<cell: int, code: binary>")
    def coded(vectors: pa.Array) -> pa.Array:
        centres, books = held.value
        rows = widened(matrix(vectors), centres.shape[1])
        cells = nearest(rows, centres)
        apart = rows - centres[cells]
        codes = np.stack([nearest(apart[:, i * PART:(i + 1) * PART], book) for i, book in enumerate(books)], axis=1).astype(np.uint8)
        return pa.StructArray.from_arrays([pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "code"])

    codes = write_parquet(base.select("id", coded("v").alias("x")).select("id", "x.cell", "x.code"), work_path(spark, "codes"))
    return VectorIndex(base, codes, centres, books)


def search(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int, share: float, candidates: int, shard: int = 65_536) -> DataFrame:
    """query_id, vec_id, cosine and rank of the k nearest, without the query's own id, ties to the smaller id.

    share: of the cells, the nearest of which a query probes, one at least; candidates: rows for each query that are rated
    by their vectors after the codes have chosen them.  All cells and as many candidates as rows make the search exact."""
    spark = index.vectors.sparkSession
    asked = write_parquet(normalised(queries, key, vector), work_path(spark, "asked"))
    held, path = spark.sparkContext.broadcast((index.centres, index.books)), work_path(spark, "probes")
    probes = max(1, round(share * len(index.centres)))
    kind, width = index.vectors.schema["id"].dataType.simpleString(), index.width

    @F.arrow_udf("array<int>")
    def probed(rows: pa.Array) -> pa.Array:
        centres = held.value[0]
        near = widened(matrix(rows)[:, :width], width) @ centres.T
        return pa.array(np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32).tolist(), pa.list_(pa.int32()))

    asked.select("id", "v", F.explode(probed("v")).alias("cell")).repartitionByRange("cell", "id").sortWithinPartitions("id", "cell").write.parquet(path)

    def scored(batches):
        held_rows, n = [], 0
        for batch in batches:
            held_rows.append(batch)
            n += batch.num_rows
            if n >= shard:
                yield from answers(held_rows)
                held_rows, n = [], 0
        if n:
            yield from answers(held_rows)

    def answers(batches):
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids, cells = rows.column("id").to_numpy(), rows.column("cell").to_numpy()
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        decoded = VectorIndex(None, None, *held.value).decoded(cells, codes)
        store, folder = pyarrow.fs.FileSystem.from_uri(path)
        mine = (pc.field("cell") >= int(cells.min())) & (pc.field("cell") <= int(cells.max()))
        files = pyarrow.dataset.dataset(folder, filesystem=store, format="parquet")
        for batch in files.to_batches(filter=mine, batch_size=BLOCK):
            if not batch.num_rows:
                continue
            probing, names, asked = batch.column("cell").to_numpy(), batch.column("id").to_numpy(zero_copy_only=False), widened(matrix(batch.column("v"))[:, :width], width)
            met = []
            for cell in np.unique(probing):
                own, at = np.flatnonzero(probing == cell), np.flatnonzero(cells == cell)
                if len(at):
                    met.append((np.repeat(names[own], len(at)), np.tile(ids[at], len(own)), (asked[own] @ decoded[at].T).ravel()))
            if met:
                yield best_of(*map(np.concatenate, zip(*met)))

    def best_of(who, ids, scores):
        """The candidates among a block's pairs; a query's probes lie together in the files."""
        order = np.lexsort((ids, -scores, who))
        order = order[who[order] != ids[order]]
        starts = np.flatnonzero(np.diff(who[order], prepend=who[order][:1] - 1))
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        order = order[nth < candidates]
        return pa.RecordBatch.from_arrays([pa.array(who[order]), pa.array(ids[order]), pa.array(scores[order])], ["query_id", "vec_id", "near"])

    ranged = index.codes.repartitionByRange("cell", "id").sortWithinPartitions("cell")
    near = ranged.mapInArrow(scored, f"query_id {kind}, vec_id {kind}, near double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))
    chosen = near.withColumn("at", best).where(F.col("at") <= candidates).select("query_id", "vec_id")
    return rated(chosen, asked, index.vectors, k)


def rated(pairs: DataFrame, asked: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k of the chosen pairs of each query with the largest cosines, by their vectors."""

    @F.arrow_udf("double")
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        one, two = matrix(a), matrix(b)
        width = max(one.shape[1], two.shape[1])
        return pa.array(np.round(np.einsum("ij,ij->i", widened(one, width), widened(two, width)), 9))

    met = pairs.join(base.select(F.col("id").alias("vec_id"), F.col("v").alias("b")), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("a")), "query_id")
    found = met.select("query_id", "vec_id", cosine("a", "b").alias("cosine"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_cosine_approx(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, share: float = 0.8, candidates: int | None = None, cells: int | None = None) -> DataFrame:
    """As knn_cosine, by an index built for these vectors; three candidates for each neighbour unless given."""
    return search(build(vectors, key, vector, cells), queries, key, vector, k, share, candidates or 3 * k)
