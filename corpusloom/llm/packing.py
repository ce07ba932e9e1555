"""Packing of token pieces into sequences of bounded length, by exact complements and then best fit.

Texts are encoded with a public word vocabulary and closed with an end id; only what is longer than a sequence is cut.  What
a plan depends on is the number of pieces of each length, at most as many numbers as a sequence has tokens, whatever the
corpus.  The plan is made from these counts: from the longest length down, the gap that a length leaves is looked up in
tables of the sums of one, two and three lengths that are still there, and combinations that fill it exactly are consumed
as often as the counts allow.  What is left is packed best fit: the longest piece opens a sequence, an exact complement of
its gap is taken where there is one, else the longest piece that fits, until nothing fits.  A plan is a list of patterns,
each with the number of sequences that it makes.

Pieces are then numbered within their length and dealt to the places of the patterns by number.  Numbers are counted in
buckets of a digest, so that a length shared by a third of all pieces is sorted by many tasks; no text and no id passes
the driver.

Defined cases: a null text is an empty one and has the end id alone; the strings of special tokens in a text get the ids
that the vocabulary's file gives them, as in the library; repeated rows are packed each; an empty table gives no rows.
``pieces`` adds columns that take the place of a caller's of the same names; other columns pass through.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, free, materialise, own, per_worker, table

VOCABULARY, ROOM, END = "word_bpe_49k.json", 4096, 1
#: Pieces that a task numbers, about.
BUCKET = 500_000
#: Words, and parts of words in small letters, met of late whose ids a worker remembers; as many met before these stay too.
KNOWN = (250_000, 350_000)
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: The marks that PLAIN has behind letters.
MARKS = bytes(x for x in range(33, 127) if chr(x) != "'" and not chr(x).isalnum())


class Remembered(dict):
    """Values by key, made when first asked for; at most twice so many of the keys asked for of late stay."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        found = self[key] = self.before[key] if key in self.before else self.make(key)
        return found

    def age(self) -> None:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()


class WordEncoder:
    """Ids of texts by a vocabulary that drops white space: the ids of a text are those of its words, which are remembered."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.as_bytes = Tokenizer.from_buffer(data), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = self.library.model
        self.words, self.parts = Remembered(self.word, KNOWN[0]), Remembered(self.part, KNOWN[1])

    def word(self, word: bytes) -> bytes:
        """Letters that lower to one letter each and compose with nothing, and marks behind them, are pre-tokens as they
        stand: these go to the library's merges directly, all else through its whole chain."""
        stem = word.rstrip(MARKS)
        if stem.isalpha():  # of ASCII
            marks = word[len(stem):]
            own = self.parts[stem.decode().lower()]
            return own + self.parts[marks.decode()] if marks else own
        text = word.decode("utf-8", "replace")
        plain = PLAIN.fullmatch(text)
        if plain:
            return self.parts[plain[1].lower()] + (self.parts[plain[2]] if plain[2] else b"")
        return raw(self.library.encode(text, add_special_tokens=False).ids)

    def part(self, text: str) -> bytes:
        shown = text if text.isascii() else self.as_bytes.pre_tokenize_str(text)[0][0]
        return raw([x.id for x in self.model.tokenize(shown)])

    def encode(self, text: bytes | None) -> np.ndarray:
        """Ids of a text in UTF-8."""
        self.words.age()
        self.parts.age()
        return np.frombuffer(b"".join(map(self.words.__getitem__, (text or b"").split())), "<u4")


def cut(length: int, room: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of so many ids."""
    return [(at, min(at + room, length)) for at in range(0, length, room)]


def pieces(docs: DataFrame, room: int = ROOM, path: str | None = None, end: int = END, with_ids: bool = True) -> DataFrame:
    """docs with a row for each piece: piece, start, length, ids_crc32 and the ids themselves, instead of the text."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        held = spark.sparkContext.broadcast(file.read())
    name = f"words-{hashlib.sha256(held.value).hexdigest()}"
    (column,) = free(docs, "_pieces")
    kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    @F.arrow_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long" + ", ids: array<int>" * with_ids + ">>")
    def cut_up(texts: pa.Array) -> pa.Array:
        encoder, rows = per_worker(name, lambda: WordEncoder(held.value)), []
        for text in texts.to_pylist():
            ids = np.append(encoder.encode(text), np.uint32(end)).astype("<u4")
            parts = [(ids[a:b], a) for a, b in cut(len(ids), room)]
            rows.append([{"piece": i, "start": a, "length": len(x), "ids_crc32": zlib.crc32(x.tobytes())} | ({"ids": x.astype(np.int32)} if with_ids else {}) for i, (x, a) in enumerate(parts)])
        return pa.array(rows, pa.list_(kind))

    dealt = docs.select(*own(docs, "text", *kind.names), F.explode(cut_up(F.col("text").cast("binary"))).alias(column))
    return dealt.select(*own(dealt, column), f"{column}.*")


class Sums:
    """Tables of the sums of one, two and three of the lengths that are left, by presence; counts may have fallen since a
    table was made, so what it names is looked for among the counts."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.room = counts, len(counts) - 1
        self.refresh()

    def refresh(self) -> None:
        self.lengths = np.flatnonzero(self.counts)
        self.two, self.three = np.zeros(self.room + 1, bool), np.zeros(self.room + 1, bool)
        for x in self.lengths:
            self.two[x + self.lengths[self.lengths <= self.room - x]] = True
        for x in self.lengths:
            self.three[x:] |= self.two[:self.room + 1 - x]
        self.left = len(self.lengths)

    def one(self, gap: int, used: dict[int, int]) -> list[int] | None:
        return [gap] if self.counts[gap] > used.get(gap, 0) else None

    def pair(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """The pair of this sum with the longest length, that the counts have beside what is used."""
        if not self.two[gap]:
            return None
        long = np.arange(gap - 1, (gap - 1) // 2, -1)
        free = self.counts.copy() if used else self.counts
        for x, n in used.items():
            free[x] -= n
        short = gap - long
        good = np.flatnonzero((free[long] > (long == short)) & (free[short] > 0))
        return [int(long[good[0]]), int(short[good[0]])] if len(good) else None

    def triple(self, gap: int, used: dict[int, int]) -> list[int] | None:
        if not self.three[gap]:
            return None
        lengths = self.lengths[self.lengths < gap]
        for x in lengths[self.two[gap - lengths]][::-1].tolist():
            if self.counts[x] > used.get(x, 0):
                rest = self.pair(gap - x, {**used, x: used.get(x, 0) + 1})
                if rest:
                    return [x, *rest]
        return None

    def filling(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly."""
        return self.one(gap, used) or self.pair(gap, used) or self.triple(gap, used)

    def take(self, pattern: list[int]) -> int:
        """Consume a pattern as often as the counts allow."""
        lengths, many = np.unique(pattern, return_counts=True)
        times = int((self.counts[lengths] // many).min())
        self.counts[lengths] -= times * many
        if 8 * int(np.count_nonzero(self.counts)) < 7 * self.left:
            self.refresh()
        return times


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences each makes; counts: pieces of each length from 0 to the room, none of 0."""
    sums, room, out = Sums(counts.astype(np.int64).copy()), len(counts) - 1, []
    if sums.counts[room]:
        out.append(([room], sums.take([room])))
    for length in range(room - 1, 0, -1):
        while sums.counts[length]:
            rest = sums.filling(room - length, {length: 1})
            if rest is None:
                break
            out.append(([length, *rest], sums.take([length, *rest])))
    while (left := np.flatnonzero(sums.counts)).size:
        pattern, used, gap = [], {}, room
        fill = [int(left[-1])]
        while fill:
            pattern += fill
            for x in fill:
                used[x] = used.get(x, 0) + 1
            gap -= sum(fill)
            fill = sums.filling(gap, used) if gap else None
            if gap and not fill:
                fits = [int(x) for x in left[:np.searchsorted(left, gap, "right")][::-1] if sums.counts[x] > used.get(int(x), 0)][:1]
                fill = fits
        out.append((pattern, sums.take(pattern)))
    return out


def places(patterns: list[tuple[list[int], int]], room: int) -> tuple[np.ndarray, ...]:
    """first, many, sequence, offset, length of each place, by length and number: pieces of a length are numbered on end,
    the lengths one after another; the pieces from ``first`` on fill ``many`` equal parts from ``offset`` on of the
    sequences from ``sequence`` on."""
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            many = pattern.count(length)
            rows.append((length, sequence, many, offset, times))
            offset += many * length
        sequence += times
    rows.sort()
    length, sequence, many, offset, times = np.array(rows, np.int64).reshape(-1, 5).T
    first = np.concatenate([[0], np.cumsum(many * times)[:-1]]) if len(rows) else np.zeros(0, np.int64)
    return first.astype(np.int64), many, sequence, offset, length


def pack(cut_up: DataFrame, room: int = ROOM, bucket: int = BUCKET) -> DataFrame:
    """Pieces with sequence_id and offset; cut_up has doc_id, piece, start, length and ids_crc32, and is written once."""
    spark = cut_up.sparkSession
    held = materialise(cut_up, "pieces")
    number, group, before = free(held, "_number", "_group", "_before")
    counts = np.zeros(room + 1, np.int64)
    for length, n in held.groupBy("length").count().collect():  # at most room rows
        counts[length] = n
    laid = spark.sparkContext.broadcast(places(plan(counts), room))
    buckets = max(1, -(-int(counts.sum()) // bucket))
    grouped = held.withColumn(group, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = materialise(grouped.groupBy("length", group).agg(F.count("*").alias(before)), "piece-counts")
    shorter = spark.createDataFrame(list(enumerate(np.concatenate([[0], np.cumsum(counts)[:-1]]).tolist())), "length long, shorter long")  # room rows
    within = F.sum(before).over(W.partitionBy("length").orderBy(group).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.withColumn(before, F.coalesce(within, F.lit(0))).join(F.broadcast(shorter), "length").select("length", group, (F.col(before) + F.col("shorter")).alias(before))
    order = W.partitionBy("length", group).orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = grouped.withColumn(number, F.row_number().over(order) - 1)
    joined = numbered.join(broadcast_if_small(starts), ["length", group]).withColumn(number, F.col(before) + F.col(number))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def placed(numbers: pa.Array) -> pa.Array:
        first, many, sequence, offset, length = laid.value
        at = numbers.to_numpy(zero_copy_only=False)
        place = np.searchsorted(first, at, "right") - 1
        nth = at - first[place]
        ids, offsets = sequence[place] + nth // many[place], offset[place] + nth % many[place] * length[place]
        return pa.StructArray.from_arrays([pa.array(ids), pa.array(offsets)], ["sequence_id", "offset"])

    kept = own(held, "sequence_id", "offset")
    return joined.select(*kept, placed(number).alias(before)).select(*kept, f"{before}.*")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, at most a sequence's room, of packed pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(pieces(docs, with_ids=False)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
