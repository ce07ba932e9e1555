"""The whole pipeline against a plain statement of its five stages."""

import hashlib
import random
import re
from collections import Counter

from test_corpus_operators import slow_components, slow_print
from test_text_operators import slow_dedup, slow_verdicts, tokenizer_library  # noqa: F401  a fixture

import corpus_pipeline
from corpusloom.llm import simhash


def slow_mix(rows):
    """(id, text) of every copy, by shares that are dealt again until no source is above twice its size."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, source in rows:
        sizes[source] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, level, capped = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}, 0.0, set()
    while True:
        left = [s for s in order if s not in capped]
        level = (1.5 * sum(sizes.values()) - sum(2.0 * sizes[s] for s in capped)) / sum(weight[s] for s in left) if left else 0.0
        over = {s for s in left if weight[s] * level > 2.0 * sizes[s]}
        if not over:
            break
        capped |= over
    out = []
    for i, t, source in rows:
        target = 2.0 * sizes[source] if source in capped else weight[source] * level
        rate = target / sizes[source] if sizes[source] else 0.0
        draw = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [(i, t)] * (int(rate) + (draw < rate - int(rate)))
    return out


def test_pipeline_equals_a_plain_statement(spark, tmp_path, tokenizer_library):  # noqa: F811
    rng = random.Random(30)
    good, junk = [f"w{i}" for i in range(80)], [f"j{i}" for i in range(80)]
    texts = [" ".join(rng.choices(good, k=rng.randint(15, 60))) for _ in range(150)] + [" ".join(rng.choices(junk, k=40)) for _ in range(30)]
    texts += texts[:25] + [t + " more" for t in texts[25:45]]
    texts = [t if i % 3 else t.replace(" ", "\n", 2) + "\n  Shared LINE of all " for i, t in enumerate(texts)] + [None, "", "a b"]
    sources = [rng.choice(["web", "book", "x", None, "web", "web"]) for _ in texts]
    rows = [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    trusted = set(range(0, 100))
    spark.createDataFrame([(i, int(i in trusted), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = [i for i, good_one in enumerate(slow_verdicts(texts, trusted)) if good_one]
    assert 0 < len([i for i in range(150) if i not in kept]) < 75 and not set(range(150, 180)) & set(kept)
    cleaned = dict(zip(kept, (x[0] for x in slow_dedup([texts[i] for i in kept], 10))))
    assert any("Shared" in texts[i] for i in kept) and not any("Shared" in t for t in cleaned.values())
    groups = slow_components({i: slow_print(t) for i, t in cleaned.items()})
    first = [i for i in kept if groups[i] == i]
    assert len(first) < len(kept)
    want = Counter()
    for i, t in slow_mix([(i, cleaned[i], sources[i]) for i in first]):
        ids = tokenizer_library.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    found = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, found.collect())) == want


def test_pipeline_and_near_dedup_of_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert simhash.classes(docs).collect() == [] and simhash.keep_one(docs).collect() == []
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.collect() == [] and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(found.columns)
