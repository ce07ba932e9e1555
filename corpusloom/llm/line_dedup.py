"""Reversible line dedup: exact reference counts of line keys, with a cuckoo filter per shard in front.

``LineStore`` keeps, in a folder that the cluster shares, how many inserted documents hold each line key, and one cuckoo
filter per shard of the keys that n >= min_docs makes common.  Counts lie in a folder for each shard and change; a key's
count is the sum over the changes.  ``insert`` and ``delete`` group the lines of their own documents only, look up the
old counts of these keys in the shards that they touch (without a shuffle of the counts while the keys of the change may
be broadcast), and add their folder.  The filters of shards in which keys crossed min_docs gain and lose those keys; one
that grows too full is built anew from the counts.  Deleting what was inserted restores counts and filters, so the dedup
is reversible.  Nothing is overwritten; after MAX_PARTS changes they are written together, and there are twice as many
shards when these hold over twice SHARD_KEYS keys on average.  ``open`` goes on with a store that another session left.

``clean`` drops the common lines of documents: the filters, where small enough to broadcast, pass a line on to the exact
keys; these are broadcast while few, else joined by a shuffle.  A filter's false positives are cleared there.

A line's key is the line without blanks at both ends, A-Z lower-cased; it is stored as the XXH64 of its bytes and its
SHA-256.  Defined cases: null and empty texts are one empty line, which has no key and always stays; a line repeated in
one document counts once for it; repeated rows count as so many documents; deleting documents that were never inserted
leaves their counts at zero at least.  ``clean`` takes the name of the column that it adds, in place of a caller's column of
that name; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, bound_batches, free, is_small, own, shared_dir, table

MIN_DOCS, MIN_CHARS = 10, 1
#: Shards at least, keys of a shard, and changes before they are written together.
SHARDS, SHARD_KEYS, MAX_PARTS = 32, 4_000_000, 8
#: Common keys, bytes of filters, and keys of a change that may be broadcast.
MAX_BROADCAST_KEYS, MAX_BROADCAST_FILTERS, MAX_BROADCAST_CHANGE = 500_000, 64 << 20, 500_000
SLOTS, MAX_KICKS, FULL = 4, 500, 0.9
COUNTS = "h long, key binary, old long, by long, shard int"


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: buckets of SLOTS 16-bit fingerprints, two candidate buckets for each hash."""

    def __init__(self, buckets: int = 16, data: bytes | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if data is None else np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        self.turn = 0

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (hashes >> np.uint64(16) & np.uint64(len(self.table) - 1)).astype(np.int64)  # the lowest bits tell the shard
        return prints, first, self.other(first, prints)

    def other(self, bucket, prints):
        return bucket ^ (np.asarray(prints).astype(np.int64) * 0x5BD1E995 & (len(self.table) - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(hashes)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def swap(self, bucket: np.ndarray, sought: np.ndarray, put: np.ndarray) -> np.ndarray:
        """Put each value in place of the one sought in its bucket; whether there was one.  Equal wishes take turns."""
        group = bucket * 65536 + sought
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        rank = np.empty(len(group), np.int64)
        rank[order] = np.arange(len(group)) - np.repeat(starts, np.diff(starts, append=len(group)))
        fits = self.table[bucket] == sought[:, None]
        done = rank < fits.sum(1)
        slot = np.argsort(~fits, axis=1, kind="stable")[np.arange(len(group)), np.minimum(rank, SLOTS - 1)]
        self.table[bucket[done], slot[done]] = put[done]
        return done

    def add(self, hashes: np.ndarray) -> bool:
        """False if the filter is too full to take all; it must then be rebuilt larger."""
        prints, a, b = self.places(hashes)
        for side in (0, 1):
            done = self.swap((a, b)[side], np.zeros_like(prints), prints)
            prints, a, b = prints[~done], a[~done], b[~done]
        return all(self.kick(mark, at) for mark, at in zip(prints, b.tolist()))

    def kick(self, mark, at: int) -> bool:
        """Move fingerprints to their other buckets until one finds room."""
        for _ in range(MAX_KICKS):
            if len(room := np.flatnonzero(self.table[at] == 0)):
                self.table[at, room[0]] = mark
                return True
            self.turn = (self.turn + 1) % SLOTS
            mark, self.table[at, self.turn] = self.table[at, self.turn], mark
            at = int(self.other(at, mark))
        return False

    def remove(self, hashes: np.ndarray) -> bool:
        """Whether all were held."""
        prints, a, b = self.places(hashes)
        for side in (0, 1):
            done = self.swap((a, b)[side], prints, np.zeros_like(prints))
            prints, a, b = prints[~done], a[~done], b[~done]
        return not len(prints)


def rebuilt(hashes: np.ndarray, buckets: int = 16) -> Cuckoo:
    while buckets * SLOTS * 0.8 < len(hashes):
        buckets *= 2
    while not (new := Cuckoo(buckets)).add(hashes):
        buckets *= 2
    return new


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hash(key: bytes) -> int:
    """The XXH64 of Spark's xxhash64 function, unsigned."""
    return xxhash.xxh64_intdigest(key, 42)


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h, key): the distinct line keys of each row's text."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key))
    lines = docs.select(F.explode(F.filter(keys, lambda x: F.length(x) >= min_chars)).alias("line"))
    return lines.select(F.xxhash64("line").alias("h"), F.unhex(F.sha2("line", 256)).alias("key"))


class LineStore:
    """shards: how many, if not to follow from the size of the first change.  The state, which the driver holds and writes
    with each change, names the folders of counts in force and, for each shard, that of its filter, its entries and buckets."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None):
        self.spark, self.path, self.few = spark, path, MAX_BROADCAST_CHANGE
        self.state = {"version": 0, "min_docs": min_docs, "min_chars": min_chars, "shards": shards, "keys": 0, "parts": [], "filters": {}}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineStore:
        store = cls(spark, path)
        found = (json.loads(r[0]) for r in spark.read.text(f"{path}/state-*").collect())  # a short line for each change
        store.state = max(found, key=lambda x: x["version"])
        store.state["filters"] = {int(k): v for k, v in store.state["filters"].items()}
        return store

    def stored(self) -> DataFrame:
        """All changes in force, with their shard."""
        if not self.state["parts"]:
            return self.spark.createDataFrame([], COUNTS)
        folders = [f"{self.path}/counts/part={x}" for x in self.state["parts"]]
        return self.spark.read.schema(f"{COUNTS}, part string").option("basePath", f"{self.path}/counts").parquet(*folders)

    def counts(self) -> DataFrame:
        """shard, h, key and n of all keys that inserted documents hold."""
        rows = self.stored().select("shard", "h", "key", F.col("by").alias("n"))
        if len(self.state["parts"]) > 1:
            rows = rows.groupBy("shard", "h", "key").agg(F.sum("n").alias("n"))
        return rows.where("n > 0")

    def common(self) -> DataFrame:
        return self.counts().where(F.col("n") >= self.state["min_docs"])

    def filters(self) -> DataFrame:
        """shard and data of every filter."""
        out = self.spark.createDataFrame([], "shard int, data binary")
        for name in {x[0] for x in self.state["filters"].values()}:
            mine = [s for s, x in self.state["filters"].items() if x[0] == name]
            out = out.unionByName(self.spark.read.parquet(f"{self.path}/filters-{name}").where(F.col("shard").isin(mine)).select("shard", "data"))
        return out

    def insert(self, docs: DataFrame) -> LineStore:
        return self.change(docs, 1)

    def delete(self, docs: DataFrame) -> LineStore:
        return self.change(docs, -1)

    def change(self, docs: DataFrame, sign: int) -> LineStore:
        name, low = uuid.uuid4().hex, self.state["min_docs"]
        lines = document_keys(docs, self.state["min_chars"]).groupBy("h", "key").agg((F.count("*") * sign).alias("change"))
        lines.write.parquet(f"{self.path}/change-{name}")
        lines = self.spark.read.schema("h long, key binary, change long").parquet(f"{self.path}/change-{name}")
        if self.state["shards"] is None:
            self.state["shards"] = max(SHARDS, math.ceil(lines.count() / SHARD_KEYS))
        lines = lines.withColumn("shard", F.pmod("h", F.lit(self.state["shards"])).cast("int"))
        known = self.with_old(lines).withColumn("by", F.greatest(F.col("old") + F.col("change"), F.lit(0)) - F.col("old"))
        known.where("by <> 0").select("h", "key", "old", "by", "shard").repartition("shard").write.partitionBy("shard").parquet(f"{self.path}/counts/part={name}")
        done = self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts/part={name}")
        was, now = F.col("old") >= low, F.col("old") + F.col("by") >= low
        new = F.count_if((F.col("old") == 0) & (F.col("by") > 0)) - F.count_if((F.col("old") > 0) & (F.col("old") + F.col("by") == 0))
        crossed = done.groupBy("shard").agg(F.count_if(~was & now).alias("up"), F.count_if(was & ~now).alias("down"), new.alias("new")).collect()  # a row for each shard
        self.state["parts"].append(name)
        self.state["keys"] += sum(r.new for r in crossed)
        self.update_filters({r.shard: (r.up, r.down) for r in crossed if r.up or r.down}, done.where(was != now).select("shard", "h", now.alias("up")))
        if len(self.state["parts"]) > MAX_PARTS or self.state["keys"] > 2 * SHARD_KEYS * self.state["shards"]:
            self.rewrite()
        self.state["version"] += 1
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").write.text(f"{self.path}/state-{self.state['version']}-{name}")
        return self

    def with_old(self, lines: DataFrame) -> DataFrame:
        """lines with the old counts of their keys, read from the shards that they touch."""
        if not self.state["parts"]:
            return lines.withColumn("old", F.lit(0).cast("long"))
        touched = [r[0] for r in lines.select("shard").distinct().collect()]
        held = self.stored() if len(touched) == self.state["shards"] else self.stored().where(F.col("shard").isin(touched))
        if is_small(lines, self.few):
            held = held.join(F.broadcast(lines.select("h", "key")), ["h", "key"], "left_semi")
        sums = held.groupBy("h", "key").agg(F.sum("by").alias("old"))
        return lines.join(sums, ["h", "key"], "left").withColumn("old", F.coalesce("old", F.lit(0).cast("long")))

    def update_filters(self, crossed: dict[int, tuple[int, int]], keys: DataFrame) -> None:
        """Let the filters of these shards gain and lose keys (shard, h, up); build those anew that are missing or too full."""

        def updated(key: tuple, filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            hashes, up, mine = keys["h"].to_numpy().view(np.uint64), keys["up"].to_numpy(bool), Cuckoo(data=filters["data"][0])
            good = mine.remove(hashes[~up]) and mine.add(hashes[up])
            return pd.DataFrame({"shard": [key[0]], "data": [mine.table.tobytes() if good else None], "buckets": [len(mine.table)]})

        def fresh(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
            mine = rebuilt(keys["h"].to_numpy().view(np.uint64))
            return pd.DataFrame({"shard": [key[0]], "data": [mine.table.tobytes()], "buckets": [len(mine.table)]})

        held, result = self.state["filters"], "shard int, data binary, buckets long"
        entries = {s: held.get(s, ("", 0, 0))[1] + up - down for s, (up, down) in crossed.items()}
        grown = [s for s in crossed if s in held and entries[s] <= FULL * SLOTS * held[s][2]]
        if grown:
            both = self.filters().where(F.col("shard").isin(grown)).groupBy("shard").cogroup(keys.where(F.col("shard").isin(grown)).groupBy("shard"))
            self.write_filters(both.applyInPandas(updated, result), entries)
        if rest := [s for s in crossed if held.get(s, ("", -1))[1] != entries[s] or s not in grown]:
            self.write_filters(self.common().where(F.col("shard").isin(rest)).select("shard", "h").groupBy("shard").applyInPandas(fresh, result), entries)
            for s in rest:
                if not entries[s]:
                    held.pop(s, None)

    def write_filters(self, filters: DataFrame, entries: dict[int, int]) -> None:
        name = uuid.uuid4().hex
        filters.write.parquet(f"{self.path}/filters-{name}")
        for r in self.spark.read.parquet(f"{self.path}/filters-{name}").where("data IS NOT NULL").select("shard", "buckets").collect():
            self.state["filters"][r.shard] = [name, entries[r.shard], r.buckets]

    def rewrite(self) -> None:
        """All changes as one, in more shards if these have grown."""
        name, old = uuid.uuid4().hex, self.state["shards"]
        while self.state["keys"] > 2 * SHARD_KEYS * self.state["shards"]:
            self.state["shards"] *= 2
        rows = self.counts().select("h", "key", F.lit(0).cast("long").alias("old"), F.col("n").alias("by"), F.pmod("h", F.lit(self.state["shards"])).cast("int").alias("shard"))
        rows.repartition("shard").write.partitionBy("shard").parquet(f"{self.path}/counts/part={name}")
        self.state["parts"] = [name]
        if self.state["shards"] != old:
            self.state["filters"] = {}
            sizes = self.common().groupBy("shard").count().collect()  # a row for each shard
            self.update_filters({r.shard: (r["count"], 0) for r in sizes}, rows)

    def clean(self, docs: DataFrame, max_keys: int = MAX_BROADCAST_KEYS, max_filters: int = MAX_BROADCAST_FILTERS, into: str = "_lines") -> DataFrame:
        """docs with a struct column ``into`` of kept (the text without common lines), n_lines and n_dropped."""
        bound_batches(self.spark)
        size = sum(2 * SLOTS * x[2] for x in self.state["filters"].values())
        probe = self.probe() if size <= max_filters else lambda hashes: np.ones(len(hashes), bool)
        few = self.common().limit(max_keys + 1).count() <= max_keys
        (known_keys,) = free(docs, "_common")
        if few:
            exact = self.spark.sparkContext.broadcast(frozenset(bytes(x[0]) for x in self.common().select("key").collect()))
            held = docs.withColumn(known_keys, F.lit(None).cast("array<binary>"))
        else:
            exact, held = None, self.marked(docs, probe, known_keys)
        chars = self.state["min_chars"]

        @F.arrow_udf("struct<kept: string, n_lines: long, n_dropped: long>")
        def without(texts: pa.Array, common: pa.Array) -> pa.Array:
            rows = []
            for text, own in zip(texts.to_pylist(), common.to_pylist()):
                known = exact.value if exact else frozenset(own or ())
                lines = (text or "").split("\n")
                drop = dropped(lines, probe, known, chars) if known else ()
                rows.append(("\n".join(x for i, x in enumerate(lines) if i not in drop), len(lines), len(drop)))
            kept, n, gone = zip(*rows) if rows else ((), (), ())
            return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["kept", "n_lines", "n_dropped"])

        return held.select(*own(docs, into), without("text", known_keys).alias(into))

    def probe(self):
        """A function that tells which hashes the shards' filters may hold; the filters are broadcast."""
        blobs = self.spark.sparkContext.broadcast({s: bytes(d) for s, d in self.filters().collect()})
        shards, cache = self.state["shards"], {}

        def may_hold(hashes: np.ndarray) -> np.ndarray:
            if not cache:
                cache.update({s: Cuckoo(data=d) for s, d in blobs.value.items()})
            shard = hashes.view(np.int64) % shards
            out = np.zeros(len(hashes), bool)
            for s in np.unique(shard).tolist():
                if s in cache:
                    mine = shard == s
                    out[mine] = cache[s].contains(hashes[mine])
            return out

        return may_hold

    def marked(self, docs: DataFrame, probe, into: str) -> DataFrame:
        """docs with ``into``, the common keys of each row: lines that the filters pass, joined with the counts.

        Rows of equal text share their lines, found by the text's digest; the joins are left to Spark's skew handling.
        """
        chars = self.state["min_chars"]

        @F.arrow_udf("array<binary>")
        def candidates(texts: pa.Array) -> pa.Array:
            out = []
            for text in texts.to_pylist():
                keys = list({k for k in map(key_bytes, (text or "").split("\n")) if len(k.decode("utf-8", "surrogatepass")) >= chars})
                seen = probe(np.array([line_hash(k) for k in keys], np.uint64)) if keys else ()
                out.append([hashlib.sha256(k).digest() for k, s in zip(keys, seen) if s])
            return pa.array(out, pa.list_(pa.binary()))

        digest, other = free(docs, "_text", "_found")
        keyed = docs.withColumn(digest, F.md5("text"))
        lines = keyed.select(F.col(digest).alias(other), F.explode(candidates("text")).alias("key")).distinct()
        found = lines.join(self.common().select("key"), "key", "left_semi").groupBy(other).agg(F.collect_set("key").alias(into))
        return keyed.join(found, F.col(digest) == F.col(other), "left")


def key_bytes(line: str) -> bytes:
    """A line's key in UTF-8; bytes.strip and bytes.lower know blanks and A-Z only."""
    return line.encode("utf-8", "surrogatepass").strip().lower()


def dropped(lines: list[str], probe, known, chars: int) -> set[int]:
    """Numbers of the lines that are common: passed by the filters and among the known keys."""
    keys = [key_bytes(x) for x in lines]
    at = [i for i, k in enumerate(keys) if k and len(k.decode("utf-8", "surrogatepass")) >= chars]
    if not at:
        return set()
    passed = probe(np.array([line_hash(keys[i]) for i in at], np.uint64))
    return {i for i, p in zip(at, passed) if p and hashlib.sha256(keys[i]).digest() in known}


def drop_common_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with text and n_chars after the corpus's common lines are gone; the other columns unchanged."""
    store = LineStore(docs.sparkSession, shared_dir(docs.sparkSession, "line-counts"), **options).insert(docs)
    (lines,) = free(docs, "_lines")
    new = {"text": F.col(f"{lines}.kept"), "n_chars": F.length(f"{lines}.kept").cast("long")}
    return store.clean(docs, into=lines).select(*[new[c].alias(c) if c in new else held for c, held in zip(docs.columns, own(docs))])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = LineStore(spark, shared_dir(spark, "line-counts")).insert(docs)
    return store.clean(docs).select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT r, doc_id, lines, [translate(trim(x, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR x IN lines] AS keys FROM d),
u AS (SELECT unnest(list_distinct(keys)) AS key FROM k),
c AS (SELECT key FROM u WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
e AS (SELECT r, doc_id, unnest(lines) AS line, unnest(keys) AS key, generate_subscripts(lines, 1) AS pos FROM k),
m AS (SELECT e.*, c.key IS NOT NULL AS gone FROM e LEFT JOIN c ON e.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
