"""Quality rules: a length-normalised log-likelihood ratio of hashed n-grams, and plain rules of a text.

Words and word pairs are hashed into BUCKETS buckets.  Two multinomials are counted: of the trusted documents (those
that ``labels`` calls good) and of the whole raw corpus, both over all their documents and whole texts.  A document's
score is the mean over its n-grams of log p(trusted) - log p(raw); it is kept if no plain rule rejects it and the score
reaches a threshold.  That follows from the scores of all trusted documents that pass the plain rules: their median, less
SPREADS times its distance to their LOW quantile, and at most 0, the score of a document that is no more like one side
than like the other.  It is one number for every document.  Counts and the histogram of scores are vectors of bounded
size whatever the corpus, so they may pass the driver.

Defined cases: null and empty texts have no words and fail the word-count rule; documents without doc_id are never
trusted; repeated rows are judged alike and count as often as they occur; without trusted documents every score is 0 and
the threshold 0.  ``judge`` takes the name of the column that it adds, in place of a caller's column of that name; other
columns pass through it and ``keep_good`` unchanged, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, bound_batches, broadcast_if_small, free, own, table

BUCKETS = 1 << 14
#: Counts added to both sides of a bucket, at the scale of the trusted counts: rare buckets of a small corpus say little.
SMOOTHING = 20.0
#: The fence below the trusted scores: so many times as far below their median as this quantile; and bins of a score of 1.
SPREADS, LOW, BINS = 6.0, 0.05, 4096
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "llr": "double", "base_failed": "boolean", "kept": "boolean",
}


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of all words and of all pairs of neighbours: a multiplicative hash of their checksums."""
    odd, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BUCKETS.bit_length() + 1)
    pairs = (hashes[:-1] * odd + hashes[1:]) * odd
    return np.concatenate([(hashes * odd) >> shift, pairs >> shift]).astype(np.int64)


def same_windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Exact class numbers of all windows of this many ids, by doubling the width."""
    n, have = len(ids) - width + 1, 1
    classes = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while have < width:
        step = min(have, width - have)
        classes = classes[: len(classes) - step] * len(ids) + classes[step:]
        classes = np.unique(classes, return_inverse=True)[1].astype(np.int64)
        have += step
    return classes[:n]


def repeated_words(words: list[bytes], hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of this width that occur twice or more, the first included.

    Windows are compared by a hash first; only where hashes repeat are the words themselves compared.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x100000001B3) + hashes[i:i + n]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    numbers: dict[bytes, int] = {}
    classes = same_windows(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)), width)
    often = (np.bincount(classes) > 1)[classes]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def measures(text: str | None, ratios: np.ndarray) -> tuple:
    """The values of MEASURES but for the last."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    hashes = word_hashes(words)
    n = len(words)
    chars = len(text or "") - (len(data) - len(data.translate(None, BLANKS.encode())))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words, hashes)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    return n, chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, score(hashes, ratios), failed


def score(hashes: np.ndarray, ratios: np.ndarray) -> float:
    return float(ratios[buckets(hashes)].mean()) if len(hashes) else 0.0


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, good) of every row; trusted: rows of doc_id, broadcast while few, else joined by a shuffle."""
    good = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_good")).distinct()
    texts = docs.select("doc_id", "text")
    return texts.join(broadcast_if_small(good), F.col("doc_id") == F.col("_good"), "left").select("text", F.col("_good").isNotNull().alias("good"))


def ngram_ratios(texts: DataFrame) -> np.ndarray:
    """log p(trusted) - log p(raw) of every bucket; each task sums its documents before anything is shuffled."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(buckets(word_hashes((text or "").encode("utf-8", "surrogatepass").split())), minlength=BUCKETS)
                raw += found
                if is_good:
                    target += found
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])

    sums = texts.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in sums:  # at most BUCKETS rows
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTHING) / (raw * (target.sum() / raw.sum()) + SMOOTHING))


def fence(histogram: dict[int, int]) -> float:
    """The threshold from numbers of trusted scores by bin, exact to a bin; 0 without any."""
    bins, n = sorted(histogram.items()), sum(histogram.values())
    if not n:
        return 0.0

    def quantile(q: float) -> float:
        left = math.ceil(q * n)
        for at, many in bins:
            left -= many
            if left <= 0:
                return at / BINS

    return min(0.0, quantile(0.5) - SPREADS * (quantile(0.5) - quantile(LOW)))


def threshold(texts: DataFrame, ratios) -> float:
    """The fence below the scores of all trusted documents that pass the plain rules; ratios: broadcast."""

    def binned(batches):
        found: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                *_, own, failed = measures(text, ratios.value)
                if not failed:
                    at = math.floor(own * BINS)
                    found[at] = found.get(at, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["at", "n"])

    return fence(dict(map(tuple, texts.where("good").select("text").mapInArrow(binned, "at long, n long").groupBy("at").agg(F.sum("n")).collect())))


def judge(docs: DataFrame, trusted: DataFrame, into: str = "_quality") -> DataFrame:
    """docs with a struct column ``into`` of all measures and the verdict."""
    bound_batches(docs.sparkSession)
    texts = marked(docs, trusted)
    ratios = docs.sparkSession.sparkContext.broadcast(ngram_ratios(texts))
    least = threshold(texts, ratios)
    kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.bool_()] * 2

    @F.arrow_udf(f"struct<{', '.join(f'{k}: {v}' for k, v in MEASURES.items())}>")
    def measured(texts: pa.Array) -> pa.Array:
        rows = (measures(t, ratios.value) for t in texts.to_pylist())
        found = list(zip(*((*m, not m[-1] and m[-2] >= least) for m in rows))) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(found, kinds)], list(MEASURES))

    return docs.select(*own(docs, into), measured("text").alias(into))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects."""
    (found,) = free(docs, "_quality")
    return judge(docs, trusted, found).where(F.col(f"{found}.kept")).select(*own(docs))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, trusted_ids(table(spark, sf_dir, "labels"))).select("doc_id", *[F.col(f"_quality.{x}") for x in MEASURES])
