"""Packing, repair of conversations and periodic runs against plain re-statements of their definitions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import conversations as C
from corpusloom.llm import packing as P
from corpusloom.llm import runs as R

ODD = [None, "", " \n\t", "a", "áb ́c Ünï, çà!", "Σας ΣΑΣ x", "<|endoftext|> a<|startoftext|>b", "a\x1cb\x85c d", "ＡＢ １２ ⅷ", "it's don't we'RE İI", "한글 漢字 1234", "x" * 3000, "--- *** _x_ (a) b.c@d.e"]


# Packing


def test_words_get_the_ids_of_the_library():
    with open(public_tokenizers.path(P.VOCABULARY), "rb") as file:
        data = file.read()
    encoder, library = P.WordEncoder(data), Tokenizer.from_buffer(data)
    for text in [x or "" for x in ODD] + [" ".join(x or "" for x in ODD)]:
        for _ in range(2):  # met for the first time, and remembered
            assert encoder.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids, text


def counts_of(lengths, room):
    return np.bincount(np.array(lengths, int), minlength=room + 1)


@pytest.mark.parametrize("seed", range(8))
def test_a_plan_packs_every_piece_once_and_no_worse_than_best_fit(seed):
    rng, room = random.Random(seed), 64
    lengths = [min(room, max(1, int(rng.lognormvariate(2.5, 1)))) for _ in range(rng.randint(1, 600))]
    plan = P.plan(counts_of(lengths, room))
    packed = Counter()
    for pattern, times in plan:
        assert 0 < sum(pattern) <= room and times > 0
        packed.update({x: n * times for x, n in Counter(pattern).items()})
    assert packed == Counter(lengths)
    gaps = []  # best fit, longest first, piece by piece
    for x in sorted(lengths, reverse=True):
        fits = [i for i, gap in enumerate(gaps) if gap >= x]
        if fits:
            best = min(fits, key=gaps.__getitem__)
            gaps[best] -= x
        else:
            gaps.append(room - x)
    assert -(-sum(lengths) // room) <= sum(n for _, n in plan) <= len(gaps)


def test_exact_complements_of_one_two_and_three_lengths_fill_sequences():
    for lengths, sequences in ([[60, 40] * 5, 5], [[70, 20, 10] * 4, 4], [[55, 21, 14, 10] * 3, 3], [[50] * 4, 2], [[100] * 3, 3], [[34] * 3, 2]):
        assert sum(n for _, n in P.plan(counts_of(lengths, 100))) == sequences
    assert P.plan(counts_of([], 100)) == []


def packed_documents(spark, texts, room, bucket=P.BUCKET):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, LENGTH string, offset int")
    return P.pack(P.pieces(docs.drop("LENGTH"), room), room, bucket)


@pytest.mark.parametrize("bucket", [5, 1000])
def test_sequences_are_gapless_and_hold_all_ids(spark, bucket):
    room, rng = 40, random.Random(2)
    texts = ODD[:11] + [" ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 90))) for _ in range(60)] + ["same text"] * 40
    with open(public_tokenizers.path(P.VOCABULARY), "rb") as file:
        library = Tokenizer.from_buffer(file.read())
    expected = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    packed = packed_documents(spark, texts, room, bucket)
    rows = packed.collect()
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids == expected[r.doc_id][r.start:r.start + r.length] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.start == r.piece * room and (r.length == room or r.start + r.length == len(expected[r.doc_id]))
        by_document[r.doc_id].append((r.start, r.ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert {d: sum((x for _, x in sorted(parts)), []) for d, parts in by_document.items()} == dict(enumerate(expected))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    joined = {r.sequence_id: r.ids for r in P.sequences(packed).collect()}
    for r in rows:
        assert joined[r.sequence_id][r.offset:r.offset + r.length] == r.ids


def test_packing_of_an_empty_table_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(P.pieces(empty)).collect() == []
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, Piece string, _number int")
    row = P.pack(P.pieces(docs)).first()
    assert (row.piece, row["_number"], row.length, row.offset) == (0, 2, 3, 0)


# Conversations


def plain_repair(rows):
    """Forward search; rows: (role, text, must, cut)."""
    follows, roles = {0: 2, 1: 2, 3: 2, 2: 3}, {2: "user", 3: "assistant"}

    def with_inserts(found):
        for _ in range(3):
            for x, (cost, audit, made) in list(found.items()):
                y = follows[x]
                new = (cost + 3, audit + "I", made + [(roles[y], "")])
                if y not in found or new[:2] < found[y][:2]:
                    found[y] = new
        return found

    found = with_inserts({0: (0, "", [])})
    for role, text, must, cut in rows:
        after = {}
        for x, (cost, audit, made) in found.items():
            y = follows[x]
            options = [(x, (cost + 4, audit + "D", made))]
            if not must:
                options.append((y, (cost + 3 + 3 * cut, audit + "R", made + [(roles[y], text)])))
                if role[:1] == roles[y][0]:
                    options.append((y, (cost + 3 * cut, audit + "K", made + [(role, text)])))
                if x == 0 and role[:1] == "s":
                    options.append((1, (cost + 3 * cut, audit + "K", made + [(role, text)])))
            for y, new in options:
                if y not in after or new[:2] < after[y][:2]:
                    after[y] = new
        found = with_inserts(after)
    return min((found[x] for x in (0, 3) if x in found), key=lambda z: z[:2])


def some_rows(rng, n):
    odd = ["user", "assistant", "system", "tool", ""]
    return [(rng.choice(odd) if rng.random() < 0.4 else odd[i % 2], f"t{i}", rng.random() < 0.15, rng.random() < 0.2) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_bidirectional_search_finds_the_cheapest_and_least_audit_whole_and_in_blocks(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(400):
        rows = some_rows(rng, rng.randint(0, 13))
        cost, audit, made = plain_repair(rows)
        steps = [C.steps_of(role[:1], must, cut) for role, _, must, cut in rows]
        found = C.least_path(steps, C.INSERTS, C.NOTHING, C.ENDS)
        assert (found[0], found[1].replace("L", "K")) == (cost, audit), rows
        assert [(m["role"], m["text"]) for m in C.repaired([r[:2] for r in rows], found[1])] == made
        monkeypatch.setattr(C, "JOINED", rng.randint(2, 3))
        size = rng.randint(1, 4)
        parts = [steps[i:i + size] for i in range(0, len(steps), size)] or [[]]
        assert C.joined_path([C.table_of(p, C.INSERTS) for p in parts]) == found


def plain_report(rows, original):
    """The contract of one conversation; rows: (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        told = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, made = plain_repair([(r, t, f in ("blank", "duplicate"), f == "truncated") for (_, r, t), f in zip(rows, faults)])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    told = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (original, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, told)


def plain_damage(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        code, role, text = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        out[conv_id] += []
        text = "" if code == 1 else text.translate(str.maketrans("", "", ".!?")) if code == 2 else text
        out[conv_id] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return [plain_report(rows, conv_id) for conv_id, rows in out.items()]


def conversation_rows(rng):
    rows = []
    for conv_id in [None, *range(60)]:
        texts = ["Yes.", "No!", "cut", " ", "", None, "What?\n", "é."]
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", None, ""]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv_id, None if rng.random() < 0.1 else turn + (turn > 4), role, rng.choice(texts) if rng.random() < 0.4 else f"text {turn} of {conv_id}."))
    rows += [(99, turn, ["user", "assistant"][turn % 2], f"long {turn % 50}.") for turn in range(300)]  # a hot conversation
    return rows + [(7, None, "user", "tie a."), (7, None, "user", "tie b."), (7, None, "user", "tie a.")]


@pytest.mark.parametrize("block", [3, 256])
def test_repair_reports_what_the_contract_says(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "JOINED", 2)
    rows = conversation_rows(random.Random(4))
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, gone string").repartition(3)
    found = C.reports(C.repair(C.damaged(table), F.col("gone"))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, found), key=key) == sorted(plain_damage(rows), key=key)


def test_messages_of_repaired_conversations_alternate(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "assistant", "Again."), (2, 5, "system", "Rules."), (2, 6, "user", "Hi.")]
    blocks = C.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    made = C.messages(blocks).orderBy("conv_id", "part", "no", "at").select("conv_id", "role", "text").collect()
    assert [tuple(r) for r in made] == [(1, "user", "Hello."), (1, "assistant", "Again."), (2, "system", "Rules."), (2, "user", "Hi."), (2, "assistant", "")]
    empty = C.repair(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert C.reports(empty).collect() == [] and C.messages(empty).collect() == []


# Periodic runs


def plain_runs(words):
    """Every maximal stretch of every period, by comparison of all words at all lags."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            whole = words[i:j + q]
            if j > i and len(whole) >= max(24, 3 * q) and not any(whole[d:] == whole[:-d] for d in range(1, q)):
                out.append((i, len(whole), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n = rng.randint(0, 240)
    words = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            a, length = rng.randrange(n), rng.randint(0, n)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(min(length, n - a)):
                words[a + i] = words[a + i % p]
    if rng.random() < 0.2:  # every short gram comes twice in a period
        s = [rng.randrange(9) for _ in range(rng.randint(10, 20))]
        words = (s + [1] * 3 + s + [1] * 3 + s + [2] * 3 + s + [2] * 3) * 4
    return words


@pytest.mark.parametrize("seed", range(6))
def test_seeds_and_diagonals_find_every_run(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = periodic_words(rng)
        assert R.runs_of(R.word_ids(words)) == plain_runs(words), words


def test_runs_of_one_word_and_of_long_periods_are_found_in_time():
    assert R.runs_of(R.word_ids([b"a"] * 300_000)) == [(0, 300_000, 1)]
    period = list(range(50_000))
    assert R.runs_of(R.word_ids(period * 3)) == [(0, 150_000, 50_000)]
    assert R.runs_of(R.word_ids(period * 3)[:-1]) == []
    with pytest.raises(ValueError):
        R.runs_of(R.word_ids([1] * 50), times=2)


def test_run_digests_are_those_of_the_contract(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "word", "a b " * 30, "x " * 24, "x " * 23] + [" ".join(f"w{x}" for x in periodic_words(rng)) for _ in range(80)]
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1) for i, t in enumerate(texts)] + [(3, "again " * 40, 2)], "doc_id long, text string, N_RUNS int")

    def expected(doc_id, text):
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        listed = "".join("%d,%d,%d\n" % r for r in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))

    found = sorted(map(tuple, R.run_digests(docs).collect()), key=str)
    assert found == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))


def test_runs_and_collapsed_texts_take_the_place_of_columns_in_any_case(spark):
    docs = spark.createDataFrame([(1, "the end " * 20 + "fin", 1)], "doc_id long, text string, _RUNS int")
    row = R.collapse(R.find_runs(docs)).first()
    assert [tuple(r) for r in row["_runs"]] == [(0, 40, 2)] and row["_collapsed"] == "the end fin"
    assert R.find_runs(docs.limit(0)).collect() == []
