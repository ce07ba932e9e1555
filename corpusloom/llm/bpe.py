"""Byte-level BPE encoding and decoding of whole texts by a public rank file.

Every text is cut into overlapping chunks of WITHIN code points, which are pre-tokenised each by itself.  Two neighbours are
stitched at the first position in their overlap that is a pre-token boundary of both: the pattern never looks back, so from
there on both streams agree.  The pieces between the stitches are encoded and their ids joined in order.  A text of more than
CHUNK code points is first dealt over tasks the same way, as chunks of that size whose pieces are encoded in parallel; a
shorter one stays where it lies.  A piece alone must be pre-tokenised as it is within
the text; the pattern looks ahead only behind white space, so stitches lie behind letters and numbers alone.  A text whose
chunks never agree, such as one endless word, is one piece.  The merges within a pre-token are the tokenizer library's;
decoding concatenates the tokens' raw bytes.

The rank file is a parameter; the driver reads it once and broadcasts it (its size is that of the vocabulary).

Defined cases: null and empty texts have no tokens and decode to no bytes; texts that only hold the strings of special
tokens are ordinary text; repeated rows are encoded alike.  ``encode`` and ``encode_decode`` take the names of the columns
that they add, which take the place of a caller's column of that name; other columns pass through, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, free, materialise, own, per_worker, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points of a chunk within a task and of its overlap, and of a chunk that texts are dealt over tasks by and of its overlap.
WITHIN, MEET, CHUNK, OVERLAP = 2048, 128, 32_768, 512
#: Code points at a chunk's end that a boundary must keep clear of: a match may look so far ahead, and more.
MARGIN = 8


def kind(c: str) -> str | None:
    """L for letters, N for numbers, else another mark; None if editions of Unicode differ, as the two libraries' may."""
    old = unicodedata.ucd_3_2_0.category(c)[0]
    return old if old == unicodedata.category(c)[0] else None


class Encoder:
    """One vocabulary: boundaries of pre-tokens, ids of a piece of text, bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.split = regex.compile(pattern)
        self.merges = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = sorted(ranks, key=ranks.__getitem__)

    def boundaries(self, text: str) -> list[int]:
        """Starts of pre-tokens at which a text may be cut: behind a letter or number, before a character of another kind."""
        found = (m.start() for m in self.split.finditer(text))
        return [at for at in found if at and (before := kind(text[at - 1])) in ("L", "N") and kind(text[at]) not in (before, None)]

    def streams(self, text: str, chunk: int, overlap: int) -> Iterator[tuple[int, list[int], list[int]]]:
        """Start of each chunk of a text, and the boundaries that its stream has in the overlap with the chunk before and in
        that with the chunk behind; a stream over the latter begins an overlap before it."""
        for at in range(0, max(1, len(text)), chunk):
            head = [at + x for x in self.boundaries(text[at:at + overlap + MARGIN]) if x <= overlap] if at else []
            warm = at + max(0, chunk - overlap)
            tail = [warm + x for x in self.boundaries(text[warm:at + chunk + overlap])] if at + chunk < len(text) else []
            yield at, head, [x for x in tail if at + chunk <= x <= min(at + chunk + overlap, len(text)) - MARGIN]

    def cuts(self, text: str, chunk: int, overlap: int) -> list[int]:
        """Where the pieces of a text begin: 0, and the first boundary that two neighbouring streams agree on."""
        out, behind = [0], set()
        for at, head, tail in self.streams(text, chunk, overlap):
            if at and (met := next((x for x in head if x in behind), None)) is not None:
                out.append(met)
            behind = set(tail)
        return out

    def encode(self, text: str | None, chunk: int = WITHIN, overlap: int = MEET) -> np.ndarray:
        """Ids of a text, or of a part of one between two boundaries, by its pieces; chunks whose streams never agree are one piece."""
        text = text or ""
        cuts = [*self.cuts(text, chunk, overlap), len(text)]
        return np.array([i for a, b in zip(cuts, cuts[1:]) for i in self.merges.encode_ordinary(text[a:b])], np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))


class Tokenizer:
    """The functions of one vocabulary on Spark; workers build their tables from the broadcast file once."""

    def __init__(self, spark: SparkSession, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP):
        with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
            self.file = spark.sparkContext.broadcast(file.read())
        self.name = f"ranks-{hashlib.sha256(self.file.value).hexdigest()}"
        self.spark, self.chunk, self.overlap = spark, chunk, overlap
        bound_batches(spark)

    def made(self):
        """A function that returns the worker's encoder."""
        file, name = self.file, self.name
        return lambda: per_worker(name, lambda: Encoder(parse_ranks(file.value)))

    def ids_of(self, text):
        """Column of the ids of whole texts."""
        encoder = self.made()

        @F.arrow_udf("array<int>")
        def ids(texts: pa.Array) -> pa.Array:
            return id_lists([encoder().encode(x) for x in texts.to_pylist()])

        return ids(text)

    def bytes_of(self, ids):
        """Column of the bytes that ids stand for."""
        encoder = self.made()

        @F.arrow_udf("binary")
        def raw(rows: pa.Array) -> pa.Array:
            return pa.array([encoder().decode(x or ()) for x in rows.to_pylist()], pa.binary())

        return raw(ids)

    def both_of(self, text):
        """Column of the ids of whole texts and of the bytes that these decode to, in one pass."""
        encoder = self.made()

        @F.arrow_udf("struct<ids: array<int>, raw: binary>")
        def both(texts: pa.Array) -> pa.Array:
            rows = [encoder().encode(x) for x in texts.to_pylist()]
            raw = pa.array([encoder().decode(x.tolist()) for x in rows], pa.binary())
            return pa.StructArray.from_arrays([id_lists(rows), raw], ["ids", "raw"])

        return both(text)

    def encode(self, docs: DataFrame, into: str = "_ids") -> DataFrame:
        """docs with the token ids of each row's text in the column ``into``."""
        is_long, kept = self.is_long(), own(docs, into)
        short = docs.where(~is_long).select(*kept, self.ids_of("text").alias(into))
        return short.unionByName(self.with_long_ids(docs.where(is_long), kept, into))

    def encode_decode(self, docs: DataFrame, into: str = "_ids", raw: str = "_raw") -> DataFrame:
        """As encode, and in the column ``raw`` the bytes that the ids decode to."""
        is_long, kept = self.is_long(), own(docs, into, raw)
        (both,) = free(docs, "_both")
        short = docs.where(~is_long).select(*kept, self.both_of("text").alias(both)).select(*kept, F.col(f"{both}.ids").alias(into), F.col(f"{both}.raw").alias(raw))
        return short.unionByName(self.with_long_ids(docs.where(is_long), kept, into).withColumn(raw, self.bytes_of(into)))

    def is_long(self) -> Column:
        return F.coalesce(F.length("text"), F.lit(0)) > self.chunk

    def with_long_ids(self, docs: DataFrame, kept: list[Column], into: str) -> DataFrame:
        """The kept columns of docs, whose texts are longer than a chunk, and their ids, found by the text's digest."""
        key, found = free(docs, "_text", "_found")
        ids = self.long_ids(docs.select(F.sha2("text", 256).alias("_text"), "text")).select(F.col("_text").alias(found), F.col("_ids").alias(into))
        texts = docs.select(*kept, F.sha2("text", 256).alias(key))
        return texts.join(ids, F.col(key) == F.col(found)).select(*kept, into)

    def long_ids(self, texts: DataFrame) -> DataFrame:
        """(_text, _ids) of texts longer than a chunk; texts: _text, their digest, and text; equal texts are encoded once.

        The text itself is shuffled once, as chunks; what follows reads these where they were written.
        """
        size, overlap, encoder = self.chunk, self.overlap, self.made()

        def chunked(batches):
            for batch in batches:
                for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                    for no, at in enumerate(range(0, len(text), size)):
                        row = [[key], [no], [at], [text[at:at + size + overlap]]]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["_text", "no", "at", "part"])

        @F.arrow_udf("struct<head: array<long>, tail: array<long>>")
        def edges(parts: pa.Array, starts: pa.Array) -> pa.Array:
            rows = []
            for part, at in zip(parts.to_pylist(), starts.to_pylist()):
                found = encoder().boundaries(part)
                head = [at + x for x in found if 0 < x <= overlap]
                rows.append({"head": head, "tail": [at + x for x in found if size <= x <= len(part) - MARGIN]})
            return pa.array(rows, pa.struct([("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))]))

        @F.arrow_udf("array<int>")
        def piece_ids(parts: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
            rows = zip(parts.to_pylist(), first.to_pylist(), last.to_pylist())
            return id_lists([encoder().encode(p[a:b]) for p, a, b in rows])

        chunks = texts.mapInArrow(chunked, "_text string, no long, at long, part string").dropDuplicates(["_text", "no"])
        chunks = materialise(chunks.withColumn("_edges", edges("part", "at")), "bpe-chunks")
        by_text, whole = W.partitionBy("_text").orderBy("no"), W.partitionBy("_text")
        both = F.array_intersect(F.lag("_edges.tail").over(by_text), F.col("_edges.head"))
        cuts = chunks.select("_text", "no", F.when(F.col("no") == 0, F.lit(0).cast("long")).otherwise(F.array_min(both)).alias("cut"))
        cuts = cuts.select("_text", "no", "cut", F.lead("cut").over(by_text).alias("next"), F.max(F.col("cut").isNull()).over(whole).alias("torn"))
        cuts = materialise(cuts, "bpe-cuts")
        pieces = chunks.join(broadcast_if_small(cuts.where("NOT torn")), ["_text", "no"])
        last = F.coalesce(F.col("next") - F.col("at"), F.length("part").cast("long"))
        pieces = pieces.select("_text", "no", piece_ids("part", F.col("cut") - F.col("at"), last).alias("ids"))
        torn = chunks.join(broadcast_if_small(cuts.where("torn").select("_text").distinct()), "_text").select("_text", F.struct("no", F.substring("part", 1, size).alias("part")).alias("x"))
        torn = torn.groupBy("_text").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("text"))
        stitched = pieces.groupBy("_text").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("_ids"))
        return stitched.unionByName(torn.select("_text", self.ids_of("text").alias("_ids")))


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes of every row."""
    coded = Tokenizer(docs.sparkSession, **options).encode_decode(docs.select("doc_id", "text"))
    ids = F.sha2(F.array_join("_ids", " "), 256)
    return coded.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("_raw", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
