"""Periodic runs of words, found by seeds that are extended along diagonals, and texts without their repetitions.

A run is a stretch of words with smallest period q and at least max(24, 3 q) words that no neighbouring word extends with
that period; the stretch and itself q words on share at least 24 - q and at least 2 q words.  Lags are taken in bands:
one to 16, 17 to 32, 33 to 64 and so on.  A run whose period lies in a band overlaps itself by the band's largest lag at
least, so grams of that many words are indexed: 16 in the first band, twice as many in each that follows.  Gram names are
exact, each made of the pair of names of its halves.  Each occurrence of a gram is paired with the next one in the same
text: within a run a gram at least as long as the period cannot come again sooner than after a period, as both periods
would then have a common divisor that is one, so these pairs, at most one a word and band, meet every run.  A pair is
extended word by word both ways along its diagonal; a table of how far each lag is covered passes over pairs that lie in
a stretch found before.  A text without a repeated gram ends after the first band.

Defined cases: null and empty texts have no words and no runs; a null doc_id is left as it is by ``damaged``; repeated rows
are each a document; runs of different periods may overlap.  ``find_runs`` and ``collapse`` take the name of the column
that they add, in place of a caller's column of that name; other columns pass through.  One text is one task's work, in
memory of a few numbers a word.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, own, table

LEAST, TIMES = 24, 3
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Words that an extension compares first; each further step takes twice as many.
STEP = 32


def word_ids(words: list) -> np.ndarray:
    """A number for each word, equal for equal words."""
    ids: dict = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def doubled(names: np.ndarray, half: int) -> np.ndarray:
    """Names of the grams of 2 * half words, by the names of those of half words."""
    return np.unique(names[:-half] * (int(names.max()) + 1) + names[half:], return_inverse=True)[1]


def next_lags(names: np.ndarray) -> np.ndarray:
    """How far on each gram comes again; 0 if it does not."""
    order = np.argsort(names, kind="stable")
    again = names[order[1:]] == names[order[:-1]]
    lags = np.zeros(len(names), np.int64)
    lags[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return lags


def agreeing(one: np.ndarray, two: np.ndarray) -> int:
    """Length of the common beginning of two arrays of one length."""
    at, step = 0, STEP
    while at < len(one):
        differ = np.flatnonzero(one[at:at + step] != two[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return len(one)


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's word numbers, by start, then period."""
    if times < 3:
        raise ValueError("a run must hold its period three times at least")
    n, found = len(ids), []
    # the overlap at the largest lag of the first band: both max(least, times q) - q >= gram and q <= gram
    gram = 1
    while min(max(least, times * q) - q for q in range(1, 2 * gram + 1)) >= 2 * gram:
        gram *= 2
    names, size, shortest = ids, 1, 1
    while size < gram and len(names) > size:
        names, size = doubled(names, size), 2 * size
    while size == gram and len(names) > 1:
        lags = next_lags(names)
        if not lags.any():
            break
        seeds = (lags >= shortest) & (lags <= gram)
        seeds[1:] &= lags[1:] != lags[:-1]  # the one before lies on the same diagonal
        covered: dict[int, int] = {}
        for at in np.flatnonzero(seeds).tolist():
            lag = int(lags[at])
            if at < covered.get(lag, 0):
                continue
            start = at - agreeing(ids[:at][::-1], ids[lag:at + lag][::-1])
            end = at + lag + agreeing(ids[at:n - lag], ids[at + lag:])
            covered[lag] = end - lag
            if end - start >= max(least, times * lag):
                found.append((start, end - start, lag))
        shortest, gram = gram + 1, 2 * gram
        if len(names) <= size:
            break
        names, size = doubled(names, size), 2 * size
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: it does unless a run contains it after that run's first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] == 0


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def find_runs(docs: DataFrame, into: str = "_runs") -> DataFrame:
    """docs with the runs of each text, (start, length, period) by start, then period."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("array<struct<start: long, length: long, period: long>>")
    def found(texts: pa.Array) -> pa.Array:
        rows = ([dict(zip(("start", "length", "period"), r)) for r in runs_of(word_ids(split(x)))] for x in texts.to_pylist())
        return pa.array(rows, RUNS)

    return docs.select(*own(docs, into), found("text").alias(into))


def collapse(docs: DataFrame, into: str = "_collapsed") -> DataFrame:
    """docs with each text's words joined by one space, but for those that repeat what is a period before them in a run."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def collapsed(texts: pa.Array) -> pa.Array:
        return pa.array([without_runs(words := split(x), runs_of(word_ids(words))).decode("utf-8", "surrogatepass") for x in texts.to_pylist()], pa.string())

    return docs.select(*own(docs, into), collapsed("text").alias(into))


def without_runs(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    stays = kept(len(words), runs).tolist() if runs else [True] * len(words)
    return b" ".join(w for w, keep in zip(words, stays) if keep)


def damaged(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document as the contract of op13 plants runs in a tenth of them, by the digest of doc_id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exponent, ties to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


DIGEST = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def digest(words: list[bytes]) -> tuple:
    runs = runs_of(word_ids(words))
    best = strongest(runs)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *shown, hashlib.sha256(listed).hexdigest(), hashlib.sha256(without_runs(words, runs)).hexdigest())


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, number of runs, the strongest run, and digests of all runs and of the collapsed text, after ``damaged``."""
    bound_batches(docs.sparkSession)
    names = [x for x, _ in DIGEST]

    @F.arrow_udf("struct<n_runs: long, start: long, length: long, period: long, exponent_milli: long, runs_sha256: string, collapsed_sha256: string>")
    def told(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [dict(zip(names, digest(damaged(split(x), i)))) for i, x in zip(ids.to_pylist(), texts.to_pylist())]
        return pa.array(rows, pa.struct(DIGEST))

    return docs.select("doc_id", told("doc_id", "text").alias("x")).select("doc_id", "x.*")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
