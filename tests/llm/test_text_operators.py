"""Quality rules, line dedup, BPE, personal data and mixing against plain re-statements of their definitions."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusloom.llm import bpe, line_dedup, mixing, pii, quality
from corpusloom.llm.common import shared_dir

EDGE = [None, "", " ", "\n\n", "a", "word " * 5000, "x" * 40_000, "é\u00a0漢字 \x1c ok\x0bz", "same line\nsame line\n other", "don't we'll  \t\n x"]


def documents(spark, texts, **more):
    rows = [(i, t, "src%d" % (i % 3) if i % 5 else None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def made_texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "Über", "x1"]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), "  Common FOOTER line ")
        out.append("\n".join(lines))
    return out


def slow_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_measures_are_those_of_the_definition(spark):
    texts = EDGE + made_texts() + ["a b c d e f g h i " * 4 + "z y # % <b>", "one two three four five six seven eight " * 2 + "nine ten eleven twelve thirteen"]
    docs = documents(spark, texts)
    rows = quality.judge(docs, spark.createDataFrame([(i,) for i in range(10, 60)], "doc_id long")).select("doc_id", "_quality.*").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_measures(texts[r.doc_id]), r


def test_quality_ratio_is_the_mean_over_hashed_ngrams(spark):
    texts = made_texts()
    docs = documents(spark, texts)
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    ratios = quality.ngram_ratios(quality.marked(docs, trusted))
    grams = [quality.buckets(quality.word_hashes(t.encode().split())) for t in texts]
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, g in enumerate(grams):
        np.add.at(raw, g, 1)
        if i % 2 == 0:
            np.add.at(target, g, 1)
    want = np.log((target + quality.SMOOTHING) / (raw * target.sum() / raw.sum() + quality.SMOOTHING))
    assert np.allclose(ratios, want)
    assert not quality.ngram_ratios(quality.marked(docs, trusted.limit(0))).any()


def slow_verdicts(texts, trusted):
    """kept of every text, from counts in dictionaries and a sorted list of the trusted scores."""
    import math
    import zlib

    def grams(text):
        h = [zlib.crc32(w) for w in (text or "").encode().split()]
        odd, low = 0x9E3779B97F4A7C15, (1 << 64) - 1
        keys = [x * odd & low for x in h] + [(a * odd + b) * odd & low for a, b in zip(h, h[1:])]
        return [k >> 64 - (quality.BUCKETS.bit_length() - 1) for k in keys]

    raw, good = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        good.update(grams(t) if i in trusted else ())
    share = sum(good.values()) / sum(raw.values())
    ratio = {b: math.log((good[b] + quality.SMOOTHING) / (n * share + quality.SMOOTHING)) if good else 0.0 for b, n in raw.items()}
    scores = [np.mean([ratio[b] for b in grams(t)]) if grams(t) else 0.0 for t in texts]
    failed = [slow_measures(t)[-1] for t in texts]
    known = sorted(math.floor(scores[i] * 4096) / 4096 for i in range(len(texts)) if i in trusted and not failed[i])
    middle, low = (known[math.ceil(q * len(known)) - 1] for q in (0.5, 0.05)) if known else (0.0, 0.0)
    least = min(0.0, middle - 6 * (middle - low))
    return [not f and s >= least for f, s in zip(failed, scores)]


def test_quality_verdicts_equal_a_plain_statement(spark):
    rng = random.Random(15)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words[:200], k=rng.randint(15, 90))) for _ in range(150)] + [" ".join(rng.choices(words[150:], k=60)) for _ in range(60)] + EDGE
    ids = lambda rows: spark.createDataFrame([(i,) for i in rows], "doc_id long")
    for trusted in (range(0, 120), range(0, 6), ()):
        rows = quality.judge(documents(spark, texts), ids(trusted)).select("doc_id", "_quality.kept").collect()
        want = slow_verdicts(texts, set(trusted))
        assert [k for _, k in sorted(map(tuple, rows))] == want and (len(set(want)) == 2)
    assert quality.fence({}) == 0.0 and quality.fence({-8: 1}) == -8 / 4096 and quality.fence({100: 10}) == 0.0


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=60)) for _ in range(300)]
    junk = [" ".join(x + "%%%" for x in t.split()) for t in good[:60]]
    docs = documents(spark, good + junk)
    kept = {r.doc_id for r in quality.keep_good(docs, spark.createDataFrame([(i,) for i in range(150)], "doc_id long")).collect()}
    assert kept == set(range(300))
    assert quality.keep_good(docs, spark.createDataFrame([(1,)], "doc_id long")).columns == docs.columns


def slow_dedup(texts, low):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or count[key(x)] < low]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("limits", [{}, {"max_keys": 0}, {"max_keys": 0, "max_filters": 0}])
def test_line_dedup_equals_brute_force_on_every_path(spark, limits):
    texts = EDGE + made_texts() + ["Common footer LINE"] * 5
    docs = documents(spark, texts)
    store = line_dedup.LineStore(spark, shared_dir(spark, "lines"), min_docs=4, shards=3).insert(docs)
    got = {r.doc_id: tuple(r._lines) for r in store.clean(docs, **limits).collect()}
    assert [got[i] for i in range(len(texts))] == slow_dedup(texts, 4)


def test_line_dedup_is_reversible(spark):
    texts = made_texts(80)
    docs = documents(spark, texts)
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    store = line_dedup.LineStore(spark, shared_dir(spark, "lines"), min_docs=5, shards=3).insert(even)
    before = {(r.h, r.n) for r in store.counts().collect()}
    once = {r.doc_id: r._lines.kept for r in store.clean(docs).collect()}
    store.insert(odd)
    assert {r.doc_id: r._lines.kept for r in store.clean(docs).collect()} == dict(enumerate(x[0] for x in slow_dedup(texts, 5)))
    store.delete(odd)
    assert {(r.h, r.n) for r in store.counts().collect()} == before
    assert {r.doc_id: r._lines.kept for r in store.clean(docs).collect()} == once
    assert store.delete(even).counts().count() == 0


@pytest.mark.parametrize("shards", [1, 32, 1024])
def test_a_filter_of_one_shard_is_filled_to_four_fifths(shards):
    rng = np.random.default_rng(shards)
    hashes = rng.integers(0, 1 << 63, 1 << 22, dtype=np.uint64)
    own = (hashes // np.uint64(shards) * np.uint64(shards) + np.uint64(3 % shards))[:64_000]  # keys of one shard share the lowest bits
    made, held = line_dedup.Cuckoo(1 << 12), 0
    while held < len(own) and made.add(own[held:held + 200]):
        held += 200
    assert held / (len(made.table) * line_dedup.SLOTS) > 0.8  # what refuses a key is rebuilt


def test_columns_in_another_case_are_replaced(spark):
    docs = spark.createDataFrame([(1, "one two three " * 20, "s", 1, 2, 3, 4, 5)], "doc_id long, text string, source string, _IDS int, _QUALITY int, _PII int, _LINES int, _MIX int")
    labels = spark.createDataFrame([(1,)], "doc_id long")
    for found, name in ((bpe.Tokenizer(spark).encode(docs), "_ids"), (quality.judge(docs, labels), "_quality"), (pii.detect(docs), "_pii"), (mixing.with_copies(docs), "_mix")):
        assert [c for c in found.columns if c.lower() == name] == [name] and found.count() == 1
    assert line_dedup.drop_common_lines(docs).columns == docs.columns


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    values = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    values = np.concatenate([values, values[:2]])
    held = line_dedup.rebuilt(values)
    assert held.contains(values).all() and (held.table > 0).sum() == len(values)
    assert held.remove(values[:1000])
    assert held.contains(values[1000:]).all() and held.contains(values[2:1000]).mean() < 0.05
    assert held.remove(values[1000:]) and not held.table.any() and not held.remove(values[:1])
    full = line_dedup.Cuckoo(16)
    assert not full.add(values[:70]) and full.add(values[:0])


def files(path):
    from pathlib import Path

    return {str(p): p.stat().st_mtime_ns for p in Path(path.removeprefix("file:").replace("//", "/", 1)).rglob("*.parquet")}


def test_a_small_change_touches_its_shards_only(spark):
    texts = made_texts(80)
    store = line_dedup.LineStore(spark, shared_dir(spark, "lines"), min_docs=3, shards=16).insert(documents(spark, texts))
    before, filters = files(store.path), dict(store.state["filters"])
    one = documents(spark, ["a line of its own\n\nand a second one"])
    store.insert(one).insert(one).insert(one)
    after = files(store.path)
    new = {p.split("shard=")[1].split("/")[0] for p in after if p not in before and "/counts/" in p}
    lines = [line_dedup.line_hash(x) for x in (b"a line of its own", b"and a second one")]
    touched = {np.array([x], np.uint64).view(np.int64)[0] % 16 for x in lines}
    assert new == {str(s) for s in touched} and all(after[p] == before[p] for p in before)
    assert {s for s in store.state["filters"] if store.state["filters"][s] != filters.get(s)} == touched
    assert {r.doc_id: tuple(r._lines) for r in store.clean(one).collect()} == {0: ("", 3, 2)}
    store.delete(one).delete(one).delete(one)
    for _ in range(3):
        store.insert(one).delete(one)
    assert len(store.state["parts"]) < 9 and store.state["keys"] == store.counts().count()
    again = line_dedup.LineStore.open(spark, store.path)
    assert again.state == store.state
    got = {r.doc_id: tuple(r._lines) for r in again.clean(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == slow_dedup(texts, 3)


def test_a_small_change_shuffles_no_counts(spark):
    texts = made_texts(80)
    store = line_dedup.LineStore(spark, shared_dir(spark, "lines"), min_docs=3, shards=4).insert(documents(spark, texts))
    lines = line_dedup.document_keys(documents(spark, texts[:2]), 1).groupBy("h", "key").agg(F.count("*").alias("change")).withColumn("shard", F.pmod("h", F.lit(4)).cast("int"))
    plan = store.with_old(lines)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [h" in plan and "LeftSemi" in plan
    store.few = 0  # beyond the broadcast: the same counts by a shuffle
    got = store.insert(documents(spark, texts)).delete(documents(spark, texts[:40] + ["never seen"])).counts()
    from collections import Counter
    want = Counter(k for t in texts + texts[40:] for k in {x.strip().lower() for x in t.split("\n")} if k)
    assert sorted(r.n for r in got.collect()) == sorted(want.values())


def test_a_grown_store_gets_more_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 10)
    texts = made_texts(60)
    store = line_dedup.LineStore(spark, shared_dir(spark, "lines"), min_docs=3, shards=2).insert(documents(spark, texts))
    assert store.state["shards"] > 2 and store.state["keys"] <= 20 * store.state["shards"]
    got = {r.doc_id: tuple(r._lines) for r in store.clean(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == slow_dedup(texts, 3)


def test_line_dedup_leaves_other_columns_alone(spark):
    docs = spark.createDataFrame([(i, "same\n%d" % i, 5, i, "c", 1) for i in range(12)], "doc_id int, text string, _lines int, _common int, _text string, `a.b` int")
    out = line_dedup.drop_common_lines(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(i, "%d" % i, 5, i, "c", 1) for i in range(12)]
    store = line_dedup.LineStore(spark, shared_dir(spark, "lines")).insert(docs)
    assert sorted(map(tuple, store.clean(docs, max_keys=0, into="x").select("doc_id", "_common", "_text", "x.kept").collect())) == [(i, i, "c", "%d" % i) for i in range(12)]


@pytest.fixture(scope="module")
def tokenizer_library():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunks", [{}, {"chunk": 50, "overlap": 20}, {"chunk": 64, "overlap": 9}])
def test_bpe_equals_the_tokenizer_library(spark, tokenizer_library, chunks):
    rng = random.Random(2)
    strange = ["".join(rng.choices("ab'sé漢 \n\t12re<|endoftext|>", k=400)) for _ in range(10)]
    texts = EDGE + made_texts(20) + strange + strange[:2]
    got = {r.doc_id: r for r in bpe.digests(documents(spark, texts), **chunks).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer_library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(8, 24), (9, 40), (13, 30), (80, 40), (32_768, 512)])
def test_bpe_stitches_at_every_alignment(spark, tokenizer_library, chunk, overlap):
    """Runs of blanks, newlines and tabs, digits and contractions at every place around a seam."""
    joints = ["\n\n", ".\n\n", "x\n\n", "x \n\n", "\t\t", "  ", " \n", "\x1c\x1d", "12345", "'re'll", "!\x1c", "\u00a0\u00a0", "\u2003 ", "\r\n\r\n", "\u4e00\uff0c"]
    words = "some words here " * (chunk // 8 + 8)
    texts = [words[: chunk - back] + joint + "Next paragraph it's 12 of " * (chunk // 20 + 4) for joint in joints for back in range(-2, 8)]
    for i, r in enumerate(bpe.digests(documents(spark, texts), chunk=chunk, overlap=overlap).orderBy("doc_id").collect()):
        ids = tokenizer_library.encode_ordinary(texts[i])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), texts[i][chunk - 9:chunk + 9]
        assert r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_bpe_pieces_of_any_cut_are_those_of_the_text(tokenizer_library):
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        encoder = bpe.Encoder(bpe.parse_ranks(file.read()))
    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choices("ab'sre 12 \n\n\t\x1c!\u00a0\u6f22\uff0c\u0301", k=60))
        for chunk, overlap in ((5, 4), (16, 12), (40, 16), (2048, 128)):
            assert encoder.encode(text, chunk, overlap).tolist() == tokenizer_library.encode_ordinary(text)
        for at in encoder.boundaries(text):
            assert encoder.encode(text[:at]).tolist() + encoder.encode(text[at:]).tolist() == tokenizer_library.encode_ordinary(text)
            assert at in (m.start() for m in encoder.split.finditer(text))


def test_bpe_leaves_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "a b " * 40, 7, "t", 2, 3.0), (2, None, 8, "u", 3, 4.0)], "doc_id int, text string, _both int, _text string, _found int, `a.b` double")
    got = bpe.Tokenizer(spark, chunk=30, overlap=12).encode_decode(docs, "_ids", "_raw").orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got] == [("a b " * 40 and 1, "a b " * 40, 7, "t", 2, 3.0), (2, None, 8, "u", 3, 4.0)]
    assert bytes(got[0]["_raw"]).decode() == "a b " * 40 and got[1]["_ids"] == []
    replaced = bpe.Tokenizer(spark).encode(docs, "_both").orderBy("doc_id").collect()
    assert replaced[1]["_both"] == [] and replaced[0]["_text"] == "t"


def test_bpe_ids_are_those_of_the_merge_rule():
    """Merge the leftmost pair of least rank in each pre-token until none is left."""
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        ranks = bpe.parse_ranks(file.read())
    encoder, rng = bpe.Encoder(ranks), random.Random(6)
    for text in ["".join(rng.choices("theanrs é'll 12\n漢", k=60)) for _ in range(40)] + EDGE[1:6]:
        want = []
        for piece in encoder.split.findall(text[:300]):
            parts = [bytes([b]) for b in piece.encode()]
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
                if rank == 1 << 30:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            want += [ranks[x] for x in parts]
        assert encoder.encode(text[:300]).tolist() == want and encoder.decode(want).decode() == text[:300]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            fits = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_base_spans_are_those_of_the_definition(spark):
    rng = random.Random(9)
    texts = EDGE[:6] + ["a.b@c.de x@y @z.a me@x..y", "1.2.3.4.5 256.1.1.1 001.002.003.004", "4644348398010899 4644 3483 9801 0899 4644-3483-9801-0898", "+1 (017) 555-7713 +12 +123456789012345678"]
    texts += ["".join(rng.choices("0123456789.@+-() ab", k=200)) for _ in range(150)]
    rows = pii.detect(documents(spark, texts)).select("doc_id", "_pii.*").collect()
    for r in rows:
        want = slow_spans(texts[r.doc_id])
        assert r.base == ",".join(want), texts[r.doc_id]
        assert set(want) <= set(r.spans.split(",")) | {""} and sum(r.counts) == len(want)


def test_pii_trees_hold_on_unseen_examples_and_add_rewritten_data(spark):
    model = pii.trained(spark.createDataFrame([], "text string"))
    rows = pii.made_examples(np.random.default_rng(99))
    texts = [f"{before}{span} and so on" for before, span, _, _ in rows]
    x = np.array([pii.features(t, len(b), len(b) + len(s), k) for t, (b, s, k, _) in zip(texts, rows)])
    chosen, true = model.chance(x) >= np.array(model.limits)[[r[2] for r in rows]], np.array([r[3] for r in rows])
    assert true[chosen].mean() > 0.97 and chosen[true].mean() > 0.8
    for text, kind in (("call (017) 555-7713 now", "phone"), ("write to jon.smith at example dot com now", "email"), ("from 10[.]0[.]0[.]12 today", "ip")):
        assert kind in pii.listed(pii.added_spans(text, [], model))
    for text in ("On 2021-03-04 we sold 1,234.50 of item 12 345 67", "at the end. Then at noon.", "a plain text of 20 words"):
        assert not pii.added_spans(text, [], model)
    masked = pii.redact(documents(spark, ["mail a@b.de or +1 (017) 555-7713!", None]), model).orderBy("doc_id").collect()
    assert masked[0].text == "mail [email] or [phone]!" and masked[1].text is None


CLASH = "doc_id int, text string, source string, n_chars int, _quality string, _pii int, _lines int, _mix int, _copy string, _target int, _salt int, _id int, _fp int, _root int, _first int, _good int, `a.b` int"


def test_columns_of_any_name_pass_through(spark):
    from corpusloom.llm import simhash

    text = "one two three four five six seven eight nine ten eleven twelve a b c d e f g h i"
    rows = [(i, f"{text} {i * 7919}", f"s{i % 2}", 5, "q", 1, 2, 3, "c", 4, 5, 6, 7, 8, 9, 10, 11) for i in range(6)] + [(None, "x", None, 0, *rows) for rows in [("q", 1, 2, 3, "c", 4, 5, 6, 7, 8, 9, 10, 11)]] 
    docs = spark.createDataFrame(rows, CLASH)
    rest = {r[4:] for r in rows}
    ids = spark.createDataFrame([(i,) for i in range(6)], "doc_id int")
    results = (quality.keep_good(docs, ids), pii.redact(docs, pii.trained(docs.limit(0).select("text"))), line_dedup.drop_common_lines(docs), mixing.mix(docs), mixing.mix(docs, salted=True), simhash.keep_one(docs))
    for out in results:
        assert out.columns == docs.columns and {tuple(r)[4:] for r in out.collect()} == rest
    again = spark.createDataFrame([*rows, (3, "other text", *rows[0][2:])], CLASH)
    assert {tuple(r)[4:] for r in simhash.keep_one(again).collect()} == rest
    for found in (quality.judge(docs, ids, "_pii"), mixing.with_copies(docs, into="_pii")):
        assert sorted(found.columns) == sorted(docs.columns) and found.count() == len(rows)


def test_many_sources_are_mixed_alike_by_sums(spark):
    rng = random.Random(3)
    sizes = spark.createDataFrame([(f"s{i:03}" if i else None, rng.choice([0, 1, 5, 1000, 100_000])) for i in range(300)], "source string, size long")
    for share, cap in ((1.5, 2.0), (0.1, 2.0), (3.0, 2.0), (1.99, 2.0)):
        one, many = (sorted(map(tuple, mixing.source_targets(sizes, share=share, cap=cap, few=few).collect()), key=str) for few in (1000, 10))
        assert one == many
        total, target = sum(r[1] for r in one), sum(r[2] for r in one)
        assert target == pytest.approx(min(share, cap) * total)
    assert mixing.source_targets(sizes.limit(0), few=-1).count() == 0


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, " w" * rng.randint(0, 9), ("hot" if i % 3 == 0 else f"s{i % 7}") if i % 11 else None, 1) for i in range(4000)] + [(None, "a b", "hot", 1), (5, None, "s5", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = mixing.with_copies(docs).select("source", "_mix.*").collect()
    assert len(mixed) == len(rows)
    sizes, targets, taken = Counter(), {}, Counter()
    for r in mixed:
        sizes[r.source] += r["size"]
        targets[r.source] = r.target
        taken[r.source] += r["size"] * r.copies
        assert 0 <= r.copies <= 2
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, budget, want = dict(sizes), 1.5 * sum(sizes.values()), {}
    while left:
        share = budget / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * share > 2 * sizes[s]]
        if not over:
            want |= {s: weight[s] * share for s in left}
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            budget -= want[s]
            del left[s]
    for s in order:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) < 0.15 * want[s] + 50
    again = mixing.with_copies(docs, salted=True).select("doc_id", "source", "_mix.*").collect()
    assert Counter((r.source, r["size"], r.copies) for r in again) == Counter((r.source, r["size"], r.copies) for r in mixed)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixed)


def test_empty_tables(spark):
    none = documents(spark, [])
    ids = spark.createDataFrame([], "doc_id long")
    assert quality.keep_good(none, ids).count() == 0
    assert line_dedup.drop_common_lines(none.withColumn("n_chars", F.lit(0))).count() == 0
    assert bpe.digests(none).count() == 0 and pii.detect(none).count() == 0 and mixing.mix(none).count() == 0


def test_registered_queries(spark, tokenizer_library, tmp_path):
    import duckdb

    texts = EDGE + made_texts() + ["mail a@b.de and +1 (017) 555-7713 from 1.2.3.4 by 4644348398010899"]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for r in quality.op1_quality_rules(spark, str(tmp_path)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_measures(texts[r.doc_id])
    for r in bpe.op8_byte_bpe(spark, str(tmp_path)).collect():
        ids = tokenizer_library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    for r in pii.op9_pii(spark, str(tmp_path)).collect():
        want = slow_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and r.n_email + r.n_ip + r.n_card + r.n_phone == len(want)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for function, sql in ((line_dedup.op2_line_dedup, line_dedup.OP2_SQL), (mixing.op10_mix_sources, mixing.OP10_SQL)):
        found = function(spark, str(tmp_path))
        rows = duck.sql(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, found.collect())) == Counter(rows), function.__name__


def test_candidates_have_every_start_and_end_of_a_run(spark):
    spans = lambda text, k: {text[s:e] for s, e, kind in pii.candidates(text) if kind == k}
    for before in ("2024-05-01 ", "room 12 ", "1 22 333 44 55 66 77 88 99 "):
        assert "555-123-4567" in spans(before + "555-123-4567 and 8", 3)
        assert "4111/1111/1111/1111" in spans(before + "4111/1111/1111/1111", 2)
    assert {"(555) 123-4567", "+49 30 1234567", "00 49 30 1234567"} <= spans("at (555) 123-4567, +49 30 1234567; 00 49 30 1234567", 3)
    assert {"1.2.3.4", "2.3.4.5"} == spans("1.2.3.4.5", 1)
    local = "a" * 70
    assert {f"{local} at b.c.d.e.f.g.com", f"{local} at b.c"} <= spans(f"{local} at b.c.d.e.f.g.com", 0)
    assert {"x.bob [at] y.com", "bob [at] y.com"} <= spans("x.bob [at] y.com", 0)
    assert sum(1 for _ in pii.candidates("1 " * 20_000)) < 20 * 20_000
    address = "a." * 70 + "b at c" + ".d" * 70  # 71 starts and 70 ends
    assert len({c for c in pii.candidates(address) if c[2] == 0}) == 71 * 70
    found = pii.added_spans(address, [], pii.trained(spark.createDataFrame([], "text string")))
    assert all(not (s < f and b < e) for s, e, _ in found for b, f, _ in found if (s, e) != (b, f))


def test_spans_rated_in_blocks_are_those_rated_at_once(spark, monkeypatch):
    model = pii.trained(spark.createDataFrame([], "text string"))
    text = "mail x.bob [at] y.com or a.b.c at d.e.com; tel 2024-05-01 (555) 123-4567, card 4111/1111/1111/1111; " * 3
    whole = pii.added_spans(text, [], model)
    cs = list(pii.candidates(text))
    chance = {c: p for c, p in zip(cs, model.chance(np.array([pii.features(text, *c) for c in cs])))}
    want, taken = [], set()
    for c in sorted((c for c in chance if chance[c] >= model.limits[c[2]]), key=lambda c: (-chance[c], cs.index(c))):
        if not taken & set(range(c[0], c[1])):
            taken |= set(range(c[0], c[1]))
            want.append(c)
    monkeypatch.setattr(pii, "RATED", 7)
    assert whole == want == pii.added_spans(text, [], model) and len(whole) >= 9


def test_unchecked_candidates_of_the_sample_are_unknown():
    for text, kind, fails in (("1.2.3.999", 1, True), ("4111 1111 1111 1112", 2, True), ("+1 23", 3, True), ("555-123-4567", 3, False), ("bob at x.com", 0, False), ("4111/1111/1111/1111", 2, False)):
        assert pii.fails_base(text, 0, len(text), kind) is fails


def test_a_phone_after_a_date_is_found(spark):
    model = pii.trained(spark.createDataFrame([], "text string"))
    for before in ("phone 2024-05-01 ", "tel room 12 "):
        text = f"{before}(555) 123-4567 and so on"
        assert f"phone:{len(before)}:{len(before) + 14}" in pii.listed(pii.added_spans(text, [], model))
