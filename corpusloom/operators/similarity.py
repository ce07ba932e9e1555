"""Nearest neighbours, tree-edit re-ranking and uniqueness of code."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.syntax import Trees, ratio_of, sequence_ratio
from ..functions.text import draw_key
from ..functions.trees import Known, most_similar, rank_among
from ..sources.sinks import work_path, write_parquet
from .ledgers import row_ids
from .vector_index import matrix, normalised, widened

#: Partners of each code in a uniqueness score, or all if there are fewer.
PARTNERS = 1000
#: Row numbers, node sequences and nodes in these that may be broadcast; more are joined by a shuffle.
NUMBERS, SEQUENCES, NODES = 2_000_000, 10_000, 4_000_000
#: Row numbers of which a task may hold the sequence, two bytes each.
PLACES = 100_000_000
#: Ratios that a task remembers.
KNOWN = 1_000_000
#: Queries that are read at a time, and that give back their pairs at a time.
BLOCK, PAIR_BLOCK = 256, 128


def knn_cosine(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, shard: int = 65_536, own: bool = False) -> DataFrame:
    """query_id, vec_id, cosine and rank of each query's k nearest vectors, ties to the smaller id; own: with the vector of
    the query's id, else without.  Shorter vectors count as zero in the missing dimensions.

    The vectors are shuffled once, into tasks that take at most so many at a time; each reads the written queries in
    blocks from the shared folder, multiplies two matrices and keeps its k best for each query, and the tasks are merged.
    """
    spark, path = vectors.sparkSession, work_path(vectors.sparkSession, "queries")
    base = normalised(vectors, key, vector)
    normalised(queries, key, vector).write.parquet(path)
    kind = base.schema["id"].dataType.simpleString()

    def nearest(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= shard:
                yield from answers(held)
                held, n = [], 0
        if n:
            yield from answers(held)

    def answers(held):
        rows = pa.Table.from_batches(held).sort_by("id").combine_chunks()
        ids, base = rows.column("id").to_numpy(), matrix(rows.column("v").combine_chunks())
        store, folder = pyarrow.fs.FileSystem.from_uri(path)
        for batch in pyarrow.dataset.dataset(folder, filesystem=store, format="parquet").to_batches(batch_size=BLOCK):
            asked, names = matrix(batch.column("v")), batch.column("id").to_numpy(zero_copy_only=False)
            width = max(asked.shape[1], base.shape[1])
            scores = np.round(widened(asked, width) @ widened(base, width).T, 9)
            for i in range(0, len(scores), PAIR_BLOCK):
                part = scores[i:i + PAIR_BLOCK]
                if not own:
                    part[ids == names[i:i + PAIR_BLOCK, None]] = -np.inf
                yield best_of(part, names[i:i + PAIR_BLOCK], ids)

    def best_of(part, names, ids):
        rows, found = [], []
        for i, row in enumerate(part):
            floor = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            at = np.flatnonzero((row >= floor) & (row > -np.inf))
            at = at[np.argsort(-row[at], kind="stable")][:k]  # ids rise
            rows.append(np.full(len(at), i))
            found.append(at)
        rows, found = np.concatenate(rows), np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(ids[found]), pa.array(part[rows, found])], ["query_id", "vec_id", "cosine"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // shard))
    found = base.repartition(tasks).mapInArrow(nearest, f"query_id {kind}, vec_id {kind}, cosine double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_of_copies(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, own: bool = False) -> DataFrame:
    """As ``knn_cosine``, for tables in which many vectors are equal: each is searched for once.

    Of equal vectors no more than the k + 1 smallest ids can be among a query's k nearest, as one may be its own; so these are
    the base, and each distinct vector asks once for its k + 1 nearest."""
    spark = vectors.sparkSession
    told = lambda df: df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    first = F.row_number().over(W.partitionBy("v").orderBy("id"))
    base = write_parquet(told(vectors).withColumn("no", first).where(F.col("no") <= k + 1).drop("no"), work_path(spark, "base"))
    asked = write_parquet(told(queries).withColumn("seq", F.sha2(F.to_json(F.struct("v")), 256)), work_path(spark, "asked"))
    kinds = asked.groupBy("seq").agg(F.min("id").alias("id"))
    each = kinds.join(asked.select("id", "v"), "id").select("id", "v")
    near = knn_cosine(base, each, "id", "v", k + 1, own=True).drop("rank").withColumnRenamed("query_id", "kind")
    met = asked.select(F.col("id").alias("query_id"), "seq").join(kinds.withColumnRenamed("id", "kind"), "seq").join(near, "kind")
    met = met if own else met.where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return met.select("query_id", "vec_id", "cosine").withColumn("rank", rank).where(F.col("rank") <= k)


def pair_ratios(codes: DataFrame, queries: DataFrame, key: str, nodes: str, shard: int = 4096) -> DataFrame:
    """query_id, match_id and ratio of the node sequences of every query and every code, a row for each pair.

    The codes are shuffled once, equal sequences side by side, into tasks that take about so many at a time; each reads the
    written queries in blocks from the shared folder, and compares sequences that are equal once while it remembers them.  Ids of
    equal sequences leave it as lists, from which Spark makes the pairs."""
    spark, path = codes.sparkSession, work_path(codes.sparkSession, "queries")
    base, asked = (x.select(F.col(key).alias("id"), F.coalesce(F.concat_ws("\n", nodes), F.lit("")).alias("text")) for x in (codes, queries))
    asked.write.parquet(path)
    kind = base.schema["id"].dataType.simpleString()
    ratios: dict[tuple[str, str], float] = {}

    def met(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= shard:
                yield from answers(held)
                held, n = [], 0
        if n:
            yield from answers(held)

    def answers(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        own, ids = by_kind(rows.column("text").combine_chunks(), rows.column("id").combine_chunks())
        store, folder = pyarrow.fs.FileSystem.from_uri(path)
        for batch in pyarrow.dataset.dataset(folder, filesystem=store, format="parquet").to_batches(batch_size=PAIR_BLOCK):
            others, names = by_kind(batch.column("text"), batch.column("id"))
            left, right = np.repeat(np.arange(len(others)), len(own)), np.tile(np.arange(len(own)), len(others))
            found = pa.array([ratio(x, y) for x in others for y in own], pa.float64())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(left)), ids.take(pa.array(right)), found], ["queries", "matches", "ratio"])

    def by_kind(texts, ids):
        """The distinct texts, and a list of the ids of each."""
        coded = texts.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.bincount(at, minlength=len(coded.dictionary)))
        return coded.dictionary.to_pylist(), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), ids.take(pa.array(np.argsort(at, kind="stable"))))

    def ratio(x: str, y: str) -> float:
        if (x, y) not in ratios:
            if len(ratios) >= KNOWN:
                ratios.clear()
            ratios[x, y] = ratio_of(*(t.split("\n") if t else () for t in (x, y)))
        return ratios[x, y]

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // shard))
    dealt = base.withColumn("seq", F.xxhash64("text")).repartitionByRange(tasks, "seq", "id").select("id", "text")
    found = dealt.mapInArrow(met, f"queries array<{kind}>, matches array<{kind}>, ratio double")
    return found.select(F.explode("queries").alias("query_id"), "matches", "ratio").select("query_id", F.explode("matches").alias("match_id"), "ratio")


def class_ratios(codes: DataFrame, queries: DataFrame, key: str, nodes: str) -> tuple[DataFrame, DataFrame]:
    """Codes with equal node sequences are a class, under the smallest id of it; without a sequence: one class too.  Gives
    id and class_id of every code, and query_id, match_id and ratio of every class that holds a query and every class.

    That is each query's ratio to each code, without a row for each two copies: classes alone are compared."""
    spark = codes.sparkSession
    told = lambda df: df.select(F.col(key).alias("id"), F.coalesce(F.concat_ws("\n", nodes), F.lit("")).alias("text"))
    classes = told(codes).groupBy("text").agg(F.min("id").alias("class_id"))
    classes = write_parquet(classes.withColumn("seq", F.sha2("text", 256)), work_path(spark, "classes"))
    members = told(codes).select("id", F.sha2("text", 256).alias("seq")).join(classes.select("seq", "class_id"), "seq").select("id", "class_id")
    asked = told(queries).select(F.sha2("text", 256).alias("seq")).distinct()
    kinds = classes.select("class_id", F.when(F.col("text") != "", F.split("text", "\n")).alias("nodes"), "seq")
    return members, pair_ratios(kinds, kinds.join(asked, "seq", "left_semi"), "class_id", "nodes")


def similar_pairs(codes: DataFrame, queries: DataFrame, key: str, nodes: str, at_least: float, k: int) -> DataFrame:
    """query_id, match_id, ratio and rank: the k codes of other ids most similar to each query by their node sequences, ties
    to the smaller id, among those with a ratio of ``at_least``.

    Equal sequences are compared once.  A sequence is a bag of node types, each with a number for its occurrence; a ratio
    of t needs t / (2 - t) of a bag in common, so two bags with that ratio share one of the rarest of each: these are the
    index that sequences are joined on.  Pairs whose sizes or whole bags do not allow the ratio are dropped before they
    are compared.  Every query's rows are at most k, however many codes are alike."""
    spark = codes.sparkSession
    told = lambda df: df.select(F.col(key).alias("id"), F.col(nodes).alias("nodes")).where(F.size("nodes") > 0).withColumn("seq", F.sha2(F.concat_ws("\n", "nodes"), 256))
    base, asked = write_parquet(told(codes), work_path(spark, "sequences")), write_parquet(told(queries), work_path(spark, "asked"))
    number = F.row_number().over(W.partitionBy("seq").orderBy("id"))
    # of each sequence the k + 1 smallest ids: one of them may be the query's own
    ids = base.select("seq", "id").withColumn("no", number).where(F.col("no") <= k + 1)
    kinds = base.unionByName(asked).groupBy("seq").agg(F.first("nodes").alias("nodes"))
    kinds = write_parquet(kinds.withColumn("bag", bagged("nodes")), work_path(spark, "bags"))
    shares = kinds.select(F.explode("bag").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    spelled = kinds.select("seq", F.size("bag").alias("size"), F.explode("bag").alias("token")).join(shares, "token")
    prefix = F.col("size") - F.ceil(F.lit(at_least / (2 - at_least)) * F.col("size") - 1e-9) + 1
    rarest = spelled.withColumn("at", F.row_number().over(W.partitionBy("seq").orderBy("n", "token"))).where(F.col("at") <= prefix).select("seq", "size", "token")
    left = rarest.join(asked.select("seq").distinct(), "seq").withColumnsRenamed({"seq": "a", "size": "n"})
    right = rarest.join(base.select("seq").distinct(), "seq").withColumnsRenamed({"seq": "b", "size": "m"})
    within = F.lit(2.0) * F.least("n", "m") >= F.lit(at_least - 1e-9) * (F.col("n") + F.col("m"))
    pairs = left.join(right, "token").where(within).select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(kinds.select(F.col("seq").alias(side), F.col("nodes").alias(f"{side}_nodes"), F.col("bag").alias(f"{side}_bag")), side)
    shared = F.lit(2.0) * F.size(F.array_intersect("a_bag", "b_bag")) / (F.size("a_bag") + F.size("b_bag"))
    rated = pairs.where(shared >= at_least - 1e-9).select("a", "b", sequence_ratio("a_nodes", "b_nodes").alias("ratio")).where(F.col("ratio") >= at_least)
    order = W.partitionBy("a").orderBy(F.desc("ratio"), "id")
    best = rated.join(ids, rated.b == ids.seq).select("a", "id", "ratio").withColumn("no", F.row_number().over(order)).where(F.col("no") <= k + 1)
    met = asked.select(F.col("id").alias("query_id"), F.col("seq").alias("a")).join(best.withColumnRenamed("id", "match_id"), "a").where("query_id <> match_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("ratio"), "match_id"))
    return met.select("query_id", "match_id", "ratio").withColumn("rank", rank).where(F.col("rank") <= k)


@F.arrow_udf(ArrayType(StringType()))
def bagged(nodes: pa.Array) -> pa.Array:
    """Each type of a sequence with the number of its occurrence."""
    out = []
    for names in nodes.to_pylist():
        met = Counter()
        out.append([f"{x}#{met.update((x,)) or met[x]}" for x in names or ()])
    return pa.array(out, pa.list_(pa.string()))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def compared(found: DataFrame, asked: DataFrame, held: DataFrame, answer, fields: str) -> DataFrame:
    """answer(query_id, its tree, other trees, ids, ranks, memory) as rows after query_id, for each query with a tree.

    found: query_id, match_id and rank, in bounded number for each query; asked and held: id and code.  A query's code comes
    once to its neighbours; those without a tree are left out."""
    kind = found.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, {fields}"
    near = found.join(held.select(F.col("id").alias("match_id"), F.col("code").alias("match_code")), "match_id").select("query_id", "match_id", "match_code", "rank")
    known, trees = Known(), Trees()

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = zip(*((x.name, x.type) for x in kinds))
        tree = trees[right.column("code")[0].as_py()] if right.num_rows else None
        others = [(trees[code], i, rank) for code, i, rank in zip(*(left.column(c).to_pylist() for c in ("match_code", "match_id", "rank")))]
        others = sorted((x for x in others if x[0]), key=lambda x: x[2])
        query = right.column("id")[0].as_py() if right.num_rows else None
        out = answer(query, tree, *map(list, zip(*others)), known) if tree and others else []
        return pa.Table.from_arrays([pa.array([query] * len(out), types[0]), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types[1:]))], names)

    kinds = found.sparkSession.createDataFrame([], schema).toArrow().schema
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work: not to be put together
    left, right = near.repartition(tasks, "query_id"), asked.select("id", "code").repartition(tasks, "id")
    return left.groupBy("query_id").cogroup(right.groupBy("id")).applyInArrow(rows, schema)


def ted_rerank(found: DataFrame, asked: DataFrame, held: DataFrame, k: int | None = None) -> DataFrame:
    """The neighbours of each query re-ordered by tree similarity, ties by rank; with k the best k alone, whose bounds leave
    most of the others uncompared.  found, asked, held: as for ``compared``."""

    def ordered(query, tree, others, ids, ranks, known):
        best, _ = most_similar(tree, others, k or len(others), known)
        return [(ids[i], ted, ranks[i], no) for no, (i, ted) in enumerate(best, 1)]

    kind = found.schema["match_id"].dataType.simpleString()
    return compared(found, asked, held, ordered, f"match_id {kind}, ted double, original_ranking int, rank int")


def rank_by_trees(found: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """query_id and the rank that the code of the query's own id has among its neighbours by tree similarity, ties by rank,
    for queries that have it among them; others are compared only while their bounds allow a better place."""

    def placed(query, tree, others, ids, ranks, known):
        return [(rank_among(tree, others, ids.index(query), known)[0],)] if query in ids else []

    return compared(found, asked, held, placed, "rank int")


def uniqueness_score(codes: DataFrame, key: str, nodes: str, k: int, seed: int) -> DataFrame:
    """1 - mean similarity of each node sequence to min(k, n) of all n, drawn without replacement; a row may draw itself.

    Rows are numbered in the order of a seeded digest, and each draws its partners' numbers by its own digest.  While the
    distinct sequences are few enough to broadcast, a row is rated in one step: a task reads the sequence of each number, two
    bytes each, partners with equal sequences are counted, and each of these is compared once in a task.  Beyond that numbers
    and sequences are joined.
    """
    spark = codes.sparkSession
    order = codes.select(F.col(key).alias("id"), F.col(nodes).alias("nodes"), draw_key(seed, F.col(key)).alias("draw"))
    order = order.withColumn("seq", F.unhex(F.md5(F.concat_ws("\n", "nodes"))))
    order = write_parquet(order, work_path(spark, "drawn"))  # ranges are sampled before they are made
    kinds = write_parquet(order.select("seq", "nodes").distinct().dropDuplicates(["seq"]), work_path(spark, "sequences"))
    numbered = row_ids(order.select("id", "draw", "seq"), "draw", "id").select("id", "draw", "seq", (F.col("row_id") - 1).alias("no"))
    n_kinds, size = kinds.agg(F.count("*"), F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()
    total = order.count()
    if total <= PLACES and n_kinds <= SEQUENCES and size <= NODES:
        return rated_at_once(numbered, kinds, total, min(k, total))
    return rated_by_joins(write_parquet(numbered, work_path(spark, "numbered")), kinds, total, min(k, total))


def partners(draw: str, total: int, many: int) -> np.ndarray:
    return np.random.default_rng(int(draw, 16)).choice(total, many, replace=False, shuffle=False)


def rated_at_once(numbered: DataFrame, kinds: DataFrame, total: int, many: int) -> DataFrame:
    spark = numbered.sparkSession
    held = kinds.collect()  # at most SEQUENCES of NODES nodes in all
    names: dict[str, int] = {}
    sequences = spark.sparkContext.broadcast([[names.setdefault(x, len(names)) for x in r.nodes] for r in held])
    kind = F.broadcast(spark.createDataFrame([(r.seq, i) for i, r in enumerate(held)], "seq binary, kind short"))
    path = work_path(spark, "numbered")
    numbered = write_parquet(numbered.join(kind, "seq").select("id", "draw", "no", "kind"), path)
    kind_of = []

    def kinds_by_number() -> np.ndarray:
        """Read once by a task from the shared folder."""
        if not kind_of:
            kind_of.append(np.zeros(total, np.int16))
            store, folder = pyarrow.fs.FileSystem.from_uri(path)
            for batch in pyarrow.dataset.dataset(folder, filesystem=store, format="parquet").to_batches(columns=["no", "kind"]):
                kind_of[0][batch.column("no").to_numpy()] = batch.column("kind").to_numpy()
        return kind_of[0]

    ratios: dict[tuple[int, int], float] = {}

    def ratio(a: int, b: int) -> float:
        if (a, b) not in ratios:
            if len(ratios) >= KNOWN:
                ratios.clear()
            ratios[a, b] = ratio_of(sequences.value[a], sequences.value[b])
        return ratios[a, b]

    @F.arrow_udf("double")
    def uniqueness(draws: pa.Array, numbers: pa.Array) -> pa.Array:
        out, kind_of = [], kinds_by_number()
        for draw, no in zip(draws.to_pylist(), numbers.to_pylist()):
            times = np.bincount(kind_of[partners(draw, total, many)])
            own, met = int(kind_of[no]), np.flatnonzero(times)
            out.append(1 - sum(n * ratio(own, x) for x, n in zip(met.tolist(), times[met].tolist())) / many)
        return pa.array(out, pa.float64())

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return numbered.select("id", "draw", "no").repartition(tasks, "id").select("id", F.round(uniqueness("draw", "no"), 12).alias("uniqueness"))


def rated_by_joins(numbered: DataFrame, kinds: DataFrame, total: int, many: int) -> DataFrame:
    @F.arrow_udf("array<long>")
    def drawn_by(draws: pa.Array) -> pa.Array:
        return pa.array([partners(x, total, many) for x in draws.to_pylist()], pa.list_(pa.int64()))

    small = lambda df, rows: F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    drawn = numbered.repartition("id").select("id", F.col("seq").alias("a"), F.explode(drawn_by("draw")).alias("no"))
    met = drawn.join(small(numbered.select("no", F.col("seq").alias("b")), NUMBERS), "no").groupBy("id", "a", "b").agg(F.count("*").alias("times"))
    pairs = met
    for side in ("a", "b"):
        pairs = pairs.join(small(kinds.select(F.col("seq").alias(side), F.col("nodes").alias(f"{side}_nodes")), SEQUENCES), side)
    rated = pairs.select("id", "times", sequence_ratio("a_nodes", "b_nodes").alias("ratio"))
    mean = F.sum(F.col("times") * F.col("ratio")) / F.sum("times")
    return rated.groupBy("id").agg(F.round(1 - mean, 12).alias("uniqueness"))  # sums in any order are alike


def bag_embedding(width: int = 64):
    """A column function: a hashed bag of the node types of a sequence, of length one."""

    @F.arrow_udf("array<float>")
    def embedded(nodes: pa.Array) -> pa.Array:
        rows = []
        for names in nodes.to_pylist():
            row = np.bincount([zlib.crc32(x.encode()) % width for x in names or ()], minlength=width).astype(float)
            rows.append((row / max(1e-9, np.linalg.norm(row))).tolist())
        return pa.array(rows, pa.list_(pa.float32()))

    return embedded
