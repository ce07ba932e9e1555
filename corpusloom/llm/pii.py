"""Personal data: base patterns, and boosted trees over candidate spans.

The base patterns find e-mail addresses, IP addresses, card and phone numbers; they always stay.  High-recall generators
propose further, overlapping spans: addresses with spelled-out signs, numbers with other separators or without a plus.
Each candidate is described by its format and by the words before it; gradient-boosted trees give it a score, which a
sigmoid fitted on held-out candidates turns into a probability, and a threshold per kind, set on those for precision,
selects it.  Selected spans that meet no base span and no likelier one are added.

The trees are fitted on a bounded sample: the candidates of SAMPLE documents of at most SAMPLE_CHARS code points, those
with the smallest hashes, and of MADE generated examples of every format.  The labels are weak: base matches and their
rewritten forms are personal data, candidates that fail the base checks, numbers of other formats and wrong bounds of made
examples are not; other candidates of the sample are unknown and left out.  Detection itself covers every document and whole texts.

Defined cases: null and empty texts have no spans; repeated rows get equal spans; an empty table is fitted on the
generated examples alone.  ``detect`` takes the name of the column that it adds, in place of a caller's column of that
name; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, free, own, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SAMPLE_CHARS, MARGIN, MADE, SEED = 500, 20_000, 4, 400, 11
#: Every so many made examples also give their spans of wrong bounds.
OTHERS = 3
TREES, DEPTH, RATE, BINS, PRECISION = 60, 3, 0.2, 16, 0.995

# The base patterns.  A run that fails once fails at all its later starts, so runs are taken whole and once.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# The generators.
AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|\s(?:at|AT)\s)"
DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
LOCAL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?={AT})")
AT_HOST, MORE_HOST = re.compile(rf"{AT}[A-Za-z0-9-]++{DOT}[A-Za-z0-9-]++"), re.compile(rf"{DOT}[A-Za-z0-9-]++")
PART = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]")
GROUP = re.compile("[0-9]++")
#: What may stand between two groups of digits, and the most groups of a span.
GAPS = {1: re.compile(r"\s?(?:\.|\[\.\]|\(\.\))\s?"), 2: re.compile("[ ./_-]?"), 3: re.compile(r"\)?[ ./-]{1,2}\(?")}
GROUPS = {1: 4, 2: 6, 3: 7}
#: Whether a run goes on beyond the start or the end of a span.
LEFT, PART_LEFT, RIGHT = re.compile(r"[0-9]\)?[ ./_-]{1,2}\(?$"), re.compile("[A-Za-z0-9][._%+-]$"), re.compile(r"\)?[ ./_-]{1,2}\(?[0-9]")
#: Candidates that are rated at a time.
RATED = 4096
HINTS = {
    "email": ("mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "master", "amex"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "ring"), "other": ("version", "license", "order", "ref", "date", "token", "page", "no", "id", "isbn", "price"),
}
BEFORE = 24


def luhn(digits: str) -> bool:
    twice = [2 * int(x) for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, in order."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), 0) for m in EMAIL.finditer(text) if m[1]]
    if DIGITS.search(text):
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = only_digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], x[2]))


def loose_emails(text: str) -> Iterator[tuple[int, int, int]]:
    """Addresses with signs or words for them: every start of a part before the sign, every end of a host label after a dot."""
    for local in LOCAL.finditer(text):
        host = AT_HOST.match(text, local.end())
        if host:
            starts = [local.start(), *(m.start() for m in PART.finditer(text, local.start() + 1, local.end()))]
            ends = [host.end()]
            while more := MORE_HOST.match(text, ends[-1]):
                ends.append(more.end())
            yield from ((s, e, 0) for s in starts for e in ends)


def loose_numbers(text: str) -> list[tuple[int, int, int]]:
    """Spans of 1 to GROUPS groups of digits from every group on, as far as gaps and sizes are those of a kind.

    No number of a kind has more than 7 groups; card numbers have at most 6 parts of up to 6 digits, groups cut into such."""
    groups, found = [m.span() for m in GROUP.finditer(text)], []
    for i, (start, _) in enumerate(groups):
        if text[start - 1:start].isalpha() and text[start - 1:start].isascii():
            continue
        alive, chunks, digits, double = {1, 2, 3}, 0, 0, text.startswith("00", start)
        for j in range(i, min(len(groups), i + 7)):
            s, e = groups[j]
            size, n = e - s, j - i + 1
            if j > i:
                gap = text[groups[j - 1][1]:s]
                alive = {k for k in alive if n <= GROUPS[k] and len(gap) < 6 and GAPS[k].fullmatch(gap)}
            chunks, digits = chunks + -(-size // 6), digits + size
            if chunks > 6:
                alive.discard(2)
            if size > 3:
                alive.discard(1)
            first = 5 + 2 * double if n == 1 else 8
            if size > first or n > 1 and size < 2 and not (n == 2 and groups[i][1] - start == 2 and double) or n == 7 and not (double and groups[i][1] - start == 2):
                alive.discard(3)
            if not alive:
                break
            if text[e:e + 1].isalpha() and text[e:e + 1].isascii():
                break
            if 1 in alive and n == 4:
                found.append((start, e, 1))
            if 2 in alive and digits >= 3:
                found.append((start, e, 2))
            if 3 in alive and n > 1:
                end = e + (text[e:e + 1] == ")" and text[s - 1:s] == "(")
                found += [(p, end, 3) for p in prefixes(text, start)]
    return found


def prefixes(text: str, start: int) -> list[int]:
    """Starts of a phone number whose digits start there: with its bracket, and with and without a plus."""
    inner = start - (text[start - 1:start] == "(")
    plus = inner - 1 if text[inner - 1:inner] == "+" else inner - 2 if inner > 1 and text[inner - 2] == "+" and text[inner - 1].isspace() else None
    before = text[plus - 1:plus] if plus else ""
    return [inner] if plus is None or before.isascii() and before.isalnum() else [plus, inner]


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """Spans of the generators, one after another: of each run every start and every end at a group's boundary; they overlap."""
    if re.search(r"@|\b(?:at|AT)\b", text):
        yield from loose_emails(text)
    if DIGITS.search(text):
        yield from loose_numbers(text)


def fails_base(text: str, start: int, end: int, kind: int) -> bool:
    """Whether a span has the form of its base pattern and fails the check that belongs to it."""
    span = text[start:end]
    if kind == 1:
        return bool(IP.fullmatch(span)) and not all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in span.split("."))
    digits = only_digits(span)
    if kind == 2:
        return bool(CARD.fullmatch(span)) and not (14 <= len(digits) <= 19 and luhn(digits))
    return kind == 3 and bool(PHONE.fullmatch(span)) and not 10 <= len(digits) <= 15


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    span, before = text[start:end], text[max(0, start - BEFORE):start].lower()
    digits, groups = only_digits(span), re.findall("[0-9]+", span)
    sizes = [len(x) for x in groups] or [0]
    words = set(re.findall("[a-z]+", before))
    hints = [float(any(w.startswith(h) for w in words for h in HINTS[k])) for k in (*KINDS, "other")]
    return [
        *[float(kind == k) for k in range(4)], len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        float(len(set(sizes)) == 1), float(bool(digits) and luhn(digits)), float(digits[:1] == "0"), float(bool(digits) and digits[0] in "3456"),
        float("+" in span), float(span.lstrip("+").startswith("00")), float("(" in span), span.count("-"), span.count("."), span.count(" "), span.count("/"), span.count("_"),
        float(all(int(x) < 256 for x in groups if len(x) < 9) and bool(groups)), float(any(len(x) > 1 and x[0] == "0" for x in groups)),
        float(sizes[0] == 4 and groups[0][:2] in ("19", "20")) if groups else 0.0, float(sizes[-1] == 4 and groups[-1][:2] in ("19", "20")) if groups else 0.0,
        float("@" in span), float(bool(re.search(r"[\[({]\s?(at|AT|@)", span))), float(bool(re.search(r"\s(at|AT)\s", span))),
        float(bool(re.search(r"[\[({]\s?(dot|DOT|\.)", span))), float(bool(re.search(r"\s(dot|DOT)\s", span))),
        float(text[start - 1:start].isalnum()), float(text[end:end + 1].isalnum()), float(text[start - 1:start] in tuple(".,-/$€£#=")), float(text[end:end + 1] in tuple("%-/=€")), *hints,
        float(bool((LEFT if kind else PART_LEFT).search(text[max(0, start - 4):start]))), float(bool((RIGHT if kind else MORE_HOST).match(text, end))),
    ]


@dataclass
class Trees:
    """Gradient-boosted regression trees for the logistic loss, with calibrated thresholds; numbers only."""

    start: float
    trees: list  # of (feature, edge) for inner nodes and values for leaves, as complete binary trees
    scale: tuple[float, float] = (1.0, 0.0)
    limits: tuple[float, ...] = (0.5,) * 4

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, edge, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > edge[at])
            out += value[at - len(feature)]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -30, 30)))


def fit_tree(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner = 2**DEPTH - 1
    feature, edge, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
    for node in range(inner):
        mine = np.flatnonzero(at == node)
        g, h, best = slope[mine], bend[mine], 1e-6
        whole = g.sum() ** 2 / (h.sum() + 1)
        for k, cuts in enumerate(edges):
            for cut in cuts if len(mine) > 8 else ():
                right = x[mine, k] > cut
                gr, hr = g[right].sum(), h[right].sum()
                gain = gr**2 / (hr + 1) + (g.sum() - gr) ** 2 / (h.sum() - hr + 1) - whole
                if gain > best:
                    best, feature[node], edge[node] = gain, k, cut
        at[mine] = 2 * node + 1 + (x[mine, feature[node]] > edge[node])
    leaf = at - inner
    g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
    return feature, edge, RATE * g / (h + 1)


def fit(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, rng: np.random.Generator) -> Trees:
    held = rng.random(len(x)) < 0.3
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[:-1])) for k in range(x.shape[1])]
    rate = y[~held].mean()
    model = Trees(float(np.log(rate / (1 - rate))), [])
    margin = np.full((~held).sum(), model.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        model.trees.append(fit_tree(x[~held], y[~held] - p, p * (1 - p), edges))
        margin = model.margin(x[~held])
    m, t, (a, b) = model.margin(x[held]), y[held], model.scale
    for _ in range(200):  # the sigmoid of the held-out margins
        error = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30))) - t
        a, b = a - 0.05 * (error * m).mean(), b - 0.05 * error.mean()
    model.scale = (float(a), float(b))
    p, limits = model.chance(x[held]), []
    for k in range(4):
        own = kinds[held] == k
        order = np.argsort(-p[own])
        good = np.cumsum(t[own][order]) / np.arange(1, own.sum() + 1)
        fits = np.flatnonzero(good >= PRECISION)
        limits.append(max(0.5, float(p[own][order][fits[-1]])) if len(fits) else 1.1)
    model.limits = tuple(limits)
    return model


def made_examples(rng: np.random.Generator) -> list[tuple[str, str, int, bool]]:
    """(words before, span, kind, personal) of every format."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9)))
    pick = lambda *x: x[rng.integers(len(x))]
    out = []

    def card() -> str:
        head = number(pick(14, 15, 18))
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    for _ in range(MADE):
        plain = f"{word()} {word()} "
        hint = lambda *x: pick(plain, f"{word()} {pick(*x)}: ")
        name, host, end = pick(f"{word()}.{number(2)}", word(), f"{word()}_{word()}"), pick(word(), f"{word()}{number(1)}"), pick("com", "org", "net", "de")
        at, dot = pick(" [at] ", "[at]", " (at) ", "(at)"), pick(" [dot] ", "[dot]", " (dot) ", ".", " dot ")
        out.append((hint("email", "contact"), f"{name}{at}{host}{dot}{end}", 0, True))
        out.append((hint("email", "mail"), f"{name}@{host}.{end}", 0, True))
        out.append((hint("email", "mail"), f"{name} at {host} dot {end}", 0, True))
        out.append((plain, f"{word()} at {word()}.{word()}", 0, False))
        parts = [str(rng.integers(1, 256)) for _ in range(4)]
        out.append((hint("ip", "server"), pick("[.]", "(.)", " . ").join(parts), 1, True))
        out.append((hint("ip", "host"), ".".join(parts), 1, True))
        out.append((plain, ".".join([*parts[:3], str(rng.integers(256, 999))]), 1, False))
        out.append((f"{word()} version ", ".".join(str(rng.integers(0, 20)) for _ in range(4)), 1, False))
        good = card()
        cut = pick(".", "/", "_")
        out.append((hint("card", "visa"), cut.join(good[i:i + 4] for i in range(0, len(good), 4)), 2, True))
        out.append((hint("card", "visa"), good, 2, True))
        bad = good[:-1] + str((int(good[-1]) + rng.integers(1, 10)) % 10)
        out.append((plain, pick(bad, " ".join(bad[i:i + 4] for i in range(0, len(bad), 4))), 2, False))
        out.append((plain, pick(number(6), number(8), number(10), number(12), number(20)), 2, False))
        a, b, c = number(3), number(3), number(4)
        local = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}")
        out.append((plain, f"({a}) {b}-{c}", 3, True))
        out.append((f"{word()} {pick('tel', 'phone', 'call', 'mobile')}: ", pick(local, f"0{number(3)} {number(7)}", f"0{number(2)}/{number(7)}", f"{a} {b} {c}"), 3, True))
        out.append((hint("tel", "phone"), pick(f"+{number(2)} {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"00{number(2)} {a} {b} {c}"), 3, True))
        out.append((plain, pick(f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.19{number(2)}", f"{number(2)}/{number(2)}/20{number(2)}"), 3, False))
        out.append((plain, pick(f"{number(1)}.{number(2)}", f"{number(4)} {number(4)} {number(4)} {number(4)}", f"{number(3)} {number(2)}", f"{number(4)}-{number(4)}", f"{number(2)} {number(3)} {number(2)}", f"{number(3)}-{number(2)}", f"{number(5)} {number(6)}"), 3, False))
    return out


def made_rows(rng: np.random.Generator):
    """(features, personal, kind) of the made examples; every OTHERS-th also after a date or a number, with its wrong bounds."""
    for n, (before, span, k, personal) in enumerate(made_examples(rng)):
        yield features(f"{before}{span} and so on", len(before), len(before) + len(span), k), personal, k
        if personal and n % OTHERS == 0:
            date = f"{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)} "
            before += ("", date, f"{rng.integers(1, 999)} ")[rng.integers(3)] if k else ""
            text, start, end = f"{before}{span} and so on", len(before), len(before) + len(span)
            yield features(text, start, end, k), True, k
            for s, e, kind in candidates(text):
                if kind == k and s < end and start < e and (s, e) != (start, end):
                    yield features(text, s, e, kind), False, kind


def trained(docs: DataFrame) -> Trees:
    """Trees fitted on the sample of docs and the made examples."""
    rng = np.random.default_rng(SEED)
    shaped = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    hashed = shaped.select("text", F.xxhash64("text").alias("h"))
    n = shaped.count()
    if n > MARGIN * SAMPLE:  # so that about MARGIN * SAMPLE rows are sorted and sent, however many tasks there are
        hashed = hashed.where(F.col("h") < -(1 << 63) + int((1 << 64) * MARGIN * SAMPLE / n))
    sample = hashed.distinct().orderBy("h").limit(SAMPLE)
    rows, labels, kinds = [], [], []
    for (text, _) in sample.collect():  # at most SAMPLE short texts
        base = {(k, s, e) for s, e, k in base_spans(text)}
        for s, e, k in candidates(text):
            if (k, s, e) in base or fails_base(text, s, e, k):  # what no base check decides is unknown
                rows.append(features(text, s, e, k))
                labels.append((k, s, e) in base)
                kinds.append(k)
    for x, label, kind in made_rows(rng):
        rows.append(x)
        labels.append(label)
        kinds.append(kind)
    return fit(np.array(rows, float), np.array(labels, float), np.array(kinds), rng)


def added_spans(text: str, base: list[tuple[int, int, int]], model: Trees) -> list[tuple[int, int, int]]:
    """Selected candidates that meet no base span and no likelier selected one, ties to the earlier proposed; they are
    proposed and rated in blocks, of which the selected ones are kept."""
    taken, chosen = np.zeros(len(text) + 1, bool), []
    for s, e, _ in base:
        taken[s:e] = True
    proposed = (c for c in candidates(text) if not taken[c[0]:c[1]].any())
    while block := list(itertools.islice(proposed, RATED)):
        chance = model.chance(np.array([features(text, *c) for c in block]))
        chosen += [(-p, len(chosen) + i, c) for i, (p, c) in enumerate(zip(chance.tolist(), block)) if p >= model.limits[c[2]]]
    out = []
    for _, _, (s, e, k) in sorted(chosen):
        if not taken[s:e].any():
            taken[s:e] = True
            out.append((s, e, k))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def detect(docs: DataFrame, model: Trees | None = None, into: str = "_pii") -> DataFrame:
    """docs with a struct column ``into``: the count of base spans of each kind, base and all spans as lists of kind:start:end."""
    bound_batches(docs.sparkSession)
    model = model or trained(docs.select("text"))  # a bounded number of trees, sent with the function

    @F.arrow_udf("struct<counts: array<long>, base: string, spans: string>")
    def found(texts: pa.Array) -> pa.Array:
        counts, bases, spans = [], [], []
        for text in texts.to_pylist():
            base = base_spans(text or "")
            counts.append([sum(x[2] == k for x in base) for k in range(4)])
            bases.append(listed(base))
            spans.append(listed(base + added_spans(text or "", base, model)))
        return pa.StructArray.from_arrays([pa.array(counts, pa.list_(pa.int64())), pa.array(bases, pa.string()), pa.array(spans, pa.string())], ["counts", "base", "spans"])

    return docs.select(*own(docs, into), found("text").alias(into))


def redact(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """docs whose text has each span replaced by its kind in brackets."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, listing in zip(texts.to_pylist(), spans.to_pylist()):
            parts, at = [], 0
            for kind, s, e in (x.split(":") for x in (listing or "").split(",") if x):
                if int(s) >= at:
                    parts += [text[at:int(s)], f"[{kind}]"]
                at = max(at, int(e))
            out.append(None if text is None else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    (spans,) = free(docs, "_pii")
    text = masked("text", f"{spans}.spans").alias("text")
    return detect(docs, model, spans).select(*[text if c == "text" else held for c, held in zip(docs.columns, own(docs))])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col("_pii.counts")[k].alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2("_pii.base", 256).alias("base_sha256"), "_pii.spans")
