"""URL filters, MaxScore, SimHash, WARC, main text and the pipeline against plain re-statements of their definitions."""

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pyarrow.fs
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import html_text, maxscore, simhash, url_filter, warc
from corpusloom.llm.common import shared_dir


def slow_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut].translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://www.example.org/en/1", "https://www.example.org/en/22", "x://a.com/fr/?q", "x://a.com/de/#f", "x://xorg/", "x://com/de", "x://example.org:80/es/", "a://b://org/", "http://Ä.org/es/\nx"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert tuple(r)[1:] == slow_verdict(urls[r.page_id]), urls[r.page_id]
    trie = url_filter.build([("allow", "a.b", "/x/"), ("block", "a.b", "/x/y"), ("block", "", "/bad"), ("allow", "b", "")])
    assert url_filter.find(trie, "q.a.b", "/x/yz") == ("a.b/x/y", "block")
    assert url_filter.find(trie, "z.b", "/bad/") == ("/bad", "block") and url_filter.find(trie, "z.b", "/") == ("b", "allow")


def test_url_lists_of_any_length_and_depth(spark):
    rng = random.Random(4)
    hosts = ["", "a", "b.a", "c.b.a", "x.y", "y", "q..a", "é.a"]
    rules = [(rng.choice(["allow", "block", None]), rng.choice(hosts + [None]), rng.choice(["", "/", "/p", "/p/", "/p/q", "/pp", "/p/q/r/s", None])) for _ in range(60)]
    urls = [f"http://{rng.choice(['d.', '', 'c.', 'www.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q?x', '/pp/q', '/p/q/r/s/t#u'])}" for _ in range(300)] + [None, "", "://", "://a"]
    deep = "/" + "s/" * 5000
    rules.append(("block", "deep", deep))
    urls += [f"http://deep{deep}x", f"http://deep{deep[:-2]}"]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, host int, found int")
    listed = spark.createDataFrame(rules, "verdict string, host string, path string")

    def slow(host, path):
        fits = [(len(h) + len(p), v, len(h), h + p) for v, h, p in ((v, h or "", p or "") for v, h, p in rules) if v and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
        size, verdict, _, rule = max(fits, default=(0, "allow", 0, None))
        return rule, verdict

    small, table, joined = (sorted(map(tuple, url_filter.judge(pages, r, max_rules=m).collect())) for r, m in ((rules, 100), (listed, 100), (listed, 1)))
    assert small == table == joined and len(small) == len(urls)
    for _, host, path, rule, verdict in small:
        assert (rule, verdict) == slow(host, path)
    assert url_filter.judge(pages.limit(0), listed, max_rules=0).count() == 0 and url_filter.judge(pages, listed.limit(0), max_rules=-1).where("rule IS NOT NULL").count() == 0


def test_url_list_of_a_million_rules(spark):
    rules = spark.range(1_000_000).select(F.when(F.col("id") % 2 == 0, "allow").otherwise("block").alias("verdict"), F.concat(F.lit("h"), F.col("id") % 1000, F.lit(".net")).alias("host"), F.concat(F.lit("/p"), F.col("id"), F.lit("/")).alias("path"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), F.col("id") % 1000, F.lit(".net/p"), F.col("id") * 400 + F.col("id") % 1000, F.lit("/x")).alias("url"))
    got = url_filter.judge(pages, rules).collect()
    for r in got:
        n = r.page_id * 400 + r.page_id % 1000
        want = (f"h{n % 1000}.net/p{n}/", "block" if n % 2 else "allow") if n < 1_000_000 and n % 1000 == r.page_id % 1000 else (None, "allow")
        assert (r.rule, r.verdict) == want
    assert sum(r.rule is not None for r in got) > 300


@pytest.mark.parametrize("scale", [1.0, 1e17])
def test_maxscore_is_exact(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * scale).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(30)] + [(None, rows[0][1]), (500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (504, []), (550, [2.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = maxscore.top_k(vectors, F.col("vec_id") % 50 == 0, shards=7, pilot=50).collect()
    import math
    good = {i: [math.floor(256 * x) if abs(x) < 2**52 else 256 * int(x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    clamp = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (i for i in good if i % 50 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q))[:5]
        if scale == 1.0:
            assert found[q] == [(i, -s) for s, i in scores], q
        else:
            assert {clamp(-s) for s, _ in scores} == {s for _, s in found[q]}


@pytest.mark.parametrize("block, scale", [(7, 1), (64, 1), (2048, 1), (64, 3000), (64, 1 << 40)])
def test_maxscore_shards_prune_and_stay_exact(block, scale):
    rng = np.random.default_rng(block)
    vectors = np.floor(rng.normal(size=(500, 12)) * rng.choice([1, 20], 500)[:, None] * 30) * scale
    vectors[::5] = vectors[0]
    vectors[:, 3] = 0
    asked = np.concatenate([np.floor(rng.normal(size=(20, 14)) * 40) * scale, np.zeros((1, 14))])
    ids, own = rng.permutation(500), np.arange(21)
    exact = [[int(x) for x in row] for row in vectors.tolist()]
    for floors in ([None] * 21, "kth"):
        want = []
        for q, row in enumerate(asked.tolist()):
            scores = sorted((-sum(int(a) * b for a, b in zip(row, v)), i) for v, i in zip(exact, ids.tolist()) if i != q)[:6]
            want += [(q, i, -s) for s, i in scores]
        if floors == "kth":
            floors = [want[6 * q + 5][2] for q in range(21)]
        got = list(maxscore.Shard(ids, vectors, block).search(asked, own, floors, 6))
        assert sorted(got) == sorted(want)


def test_maxscore_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.top_k(none, F.lit(True)).count() == 0
    few = spark.createDataFrame([(50, [1.0, 2.0], "x"), (50, [1.0, 2.0], "y"), (1, [], "z"), (2, [0.5], "z"), (0, [3.0, 0.0, 9.0], "z")], "vec_id long, embedding array<float>, floor string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.top_k(few, F.col("vec_id") % 50 == 0, k=3).collect())
    assert got == [(0, 1, 50, 768 * 256), (0, 2, 50, 768 * 256), (0, 3, 2, 768 * 128), (50, 1, 0, 768 * 256), (50, 2, 2, 256 * 128), (50, 3, 1, 0)]


def slow_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(n=150, seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choices("one two three four five six seven".split(), k=40)) for _ in range(n // 5)]
    texts = base + [rng.choice(base) for _ in range(n // 5)]
    while len(texts) < n:
        words = rng.choice(base[:3]).split()
        words[rng.randrange(len(words))] = rng.choice(["eight", "TWO"])
        texts.append(" ".join(words))
    return texts + [None, "", " ", "Hi", "hi", "hi there"]


@pytest.mark.parametrize("tile", [4096, 7])
def test_simhash_components_equal_brute_force(spark, tile):
    texts = near_copies()
    docs = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = {i * 3 + 1: slow_print(t) for i, t in enumerate(texts)}
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(docs, tile=tile).collect()}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == slow_components(prints)


def test_simhash_long_chains_and_spanning_links(spark):
    chain = [0]
    for i in range(60):
        chain.append(chain[-1] ^ (3 << i))
    prints = spark.createDataFrame([(x if x < 1 << 63 else x - (1 << 64),) for x in chain], "fp long")
    found = simhash.components(simhash.links(prints, tile=5)).collect()
    assert len(found) == len(chain) - 1 and len({r.root for r in found}) == 1
    near = np.arange(3000, dtype=np.uint64) % np.uint64(8)
    u, _ = simhash.spanning_links(near, near, True, 3)
    assert len(u) == len(near) - 1


def test_simhash_keeps_one_of_each_group(spark):
    texts = near_copies()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "lonely words of nobody at all", "x"), (None, "lonely words of nobody at all", "x"), (None, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0))
    want = slow_components({i: slow_print(t) for i, t in enumerate(texts)})
    assert ids == sorted({c for i, c in want.items()}) + [None]


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (0, "v", "q" * 100_000), (None, "w", "<p>é</p>"), (None, "w", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    path = shared_dir(spark, "warc")
    manifest = warc.write_archives(pages, path, file_bytes=300)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = sorted(((r.page_id if r.page_id is not None else 99, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(manifest, path).collect()), key=str)
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    want = [(1, "response", None), (2, "response", None), (3, "revisit", 2), (4, "revisit", 1), (4, "revisit", 1), (0, "response", None), (99, "revisit", 1), (99, "response", None)]
    assert got == sorted(((i, k, f, len((h or "").encode()), digest(h or "")) for (i, k, f), (_, _, h) in zip(want, rows)), key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0), path), path).count() == 0


def test_warc_members_stand_alone_and_damage_is_seen():
    members = [warc.record(i, f"u{i}", random.Random(i).randbytes(i * 7000), None) for i in range(4)]
    stream = b"".join(members)
    assert [(gzip.decompress(m), None) for m in members] == list(warc.members(io.BytesIO(stream)))
    assert [r["payload_bytes"] for r in warc.records("f", io.BytesIO(stream), 4)] == [0, 7000, 14000, 21000]
    cut = list(warc.records("f", io.BytesIO(stream[:-20]), 4))
    assert len(cut) == 5 and cut[3]["error"] and not cut[0]["error"] and cut[4]["error"] == "3 of 4 records"
    for at in (len(members[0]) + 3, len(members[0]) + 400, len(members[0]) + 5000):  # the second member is damaged, the others are read
        broken = bytearray(stream)
        broken[at] ^= 0x55
        rows = list(warc.records("f", io.BytesIO(bytes(broken))))
        assert [r["page_id"] for r in rows if not r["error"]] == [0, 2, 3] and sum(r["error"] is not None for r in rows) == 1
    text = warc.record(1, "u", b"x" * 7000, None)
    head = gzip.decompress(text).replace(b"xxxxx", b"xxxxy", 1)
    rows = list(warc.records("f", io.BytesIO(gzip.compress(head) + members[2])))
    assert rows[0]["error"] and rows[1]["page_id"] == 2
    assert list(warc.records("f", io.BytesIO(b"no archive at all")))[0]["error"] and list(warc.records("f", io.BytesIO(b""))) == []


def test_warc_fails_loudly(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"text {i % 5}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(pages, path)
    good = warc.read_archives(manifest, path, strict=True)
    assert warc.checked(good).count() == 20 and warc.unmatched(good.where("page_id <> 2")).count() == 1
    with pytest.raises(ValueError, match="without their response"):
        warc.checked(good.where("page_id <> 2"))
    with pytest.raises(Exception, match="20 of 21 records"):
        warc.read_archives(manifest.withColumn("records", F.col("records") + 1), path, strict=True).collect()
    file = manifest.first().file
    with open(file, "r+b") as archive:
        archive.seek(40)
        archive.write(b"\0" * 8)
    with pytest.raises(Exception, match=file):
        warc.read_archives(manifest, path, strict=True).collect()
    lenient = warc.read_archives(manifest, path).collect()
    assert sum(r.error is None for r in lenient) == 19 and sum(r.error is not None for r in lenient) == 2


PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>First  part<br>here.</p><p><b>Second<p>Third</article><footer>&copy; x</footer>", "A & B\nFirst part here.\nSecond\nThird"),
    ("<body><div id='comments'><p>I think that this is a long comment of a reader.</p></div><main><header><h1>Title</h1></header><p>Text of the page, long enough.</p><ul><li>one<li>two</ul></main><form>Name</form><aside>Other</aside></body>", "Title\nText of the page, long enough.\none\ntwo"),
    ("<div><div class='content with-sidebar'><h1>Head of it all here</h1><p>Para one is long enough to be read.</p><p>Para two is also long.</p></div><div class=cookie-notice>We use cookies</div></div>", "Head of it all here\nPara one is long enough to be read.\nPara two is also long."),
    ("<body><div id=header>Site name</div><div id=page><div class=post><div class=post-header><h1>A title of some length</h1></div><div><p>First paragraph, long enough to be read by all.</p><p>Second paragraph, about as long as that.</p></div></div><div class='sideMenu'><a href=a>One</a></div></div>", "A title of some length\nFirst paragraph, long enough to be read by all.\nSecond paragraph, about as long as that."),
    ("<script>var t='</p>';</script>plain <!-- x --> text", "plain text"),
    ("", ""), (None, ""), ("<p>a &lt;b&gt; &#233; &unknown; &am", "a <b> é &unknown; &am"), ("<<>><p", "<<>>"),
]


def test_main_text(spark):
    rows = [(i, "u", page) for i, (page, _) in enumerate(PAGES)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r._text for r in got] == [text for _, text in PAGES]
    html_text.main_text("<b>" * 50_000 + "deep"), html_text.main_text("<p class='" * 1000)


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=50)) for _ in range(200)]
    texts += texts[:20] + [t + " extra" for t in texts[20:30]] + ["too short", None] + [" ".join(x + "%%%" for x in t.split()) for t in texts[:40]]
    texts = [t if t is None or i % 2 else t + "\nshared line of text" for i, t in enumerate(texts)]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "line_dedup":
            assert docs.where("text LIKE '%shared line%'").count() == 0
    assert seen[0] == 230 and seen[1] == 230 and 195 <= seen[2] <= 210 and seen[3] == seen[4] > seen[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_registered_queries(spark, tmp_path):
    import duckdb

    urls = ["http://www.example.org/en/12", None, "https://a.com/de/?q", "x"] * 4
    pages = [(i, urls[i % len(urls)], PAGES[i % len(PAGES)][0]) for i in range(3 * len(PAGES))] + [(2, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=16).tolist(), 0) for i in range(300)] + [(300 + i, rng.normal(size=16).tolist() if i % 2 else None, 0) for i in range(10)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    texts = near_copies(80)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = {i: slow_print(t) for i, t in enumerate(texts)}
    groups = slow_components(prints)
    for r in simhash.op5_simhash(spark, str(tmp_path)).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", groups[r.doc_id])
    for r in html_text.op7_html_text(spark, str(tmp_path)).where("page_id <> 2").collect():
        assert r.text == PAGES[r.page_id % len(PAGES)][1] and r.n_chars == len(r.text)
    duck = duckdb.connect()
    for t in ("pages", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for function, sql in ((url_filter.op3_url_filter, url_filter.OP3_SQL), (maxscore.op4_maxscore, maxscore.OP4_SQL), (warc.op6_warc, warc.OP6_SQL)):
        found = function(spark, str(tmp_path))
        rows = duck.sql(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, rows)), function.__name__


@pytest.mark.parametrize("attribute", ['href="/hidden-gems"', 'title="A hidden gem"', 'data-s="hidden"', 'onload="x.hidden=true"', 'href="/p?id=share&x=1"', "data-a='class=\"menu\"'", 'data-style="display:none"', "alt=hidden", "href=/a/hidden"])
def test_words_in_other_attributes_drop_nothing(attribute):
    text = "One long sentence about a plain thing. " * 8
    assert html_text.main_text(f"<body><div {attribute}><p {attribute}>{text}</p></div></body>") == text.strip()


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN=''", 'title="a" hidden', "data-x=1 style = 'color:red;display: none'", "role=navigation", "id=share", 'a/class="x menu"'])
def test_attributes_of_that_name_still_drop(attribute):
    text = "One long sentence about a plain thing. " * 8
    assert html_text.main_text(f"<body><div><p>{text}</p><div {attribute}><p>{text}</p></div></div></body>") == text.strip()


@pytest.mark.parametrize("inline", ["span", "b", "a", "font"])
def test_end_tags_reach_any_depth(inline):
    text = "One long sentence about a plain thing. " * 8
    for tag in ("menu", "form", "nav"):
        page = f"<body><{tag}>" + f"<{inline}>x" * 3000 + f"</{tag}><article><p>{text}</p></article></body>"
        assert html_text.main_text(page) == text.strip()
    page = f"<body><article><p>{text}" + f"<{inline}>" * 300 + "</article><aside>beside</aside></body>"
    tree = html_text.Tree(page)
    assert tree.parent[tree.tag.index("aside")] == tree.tag.index("body")


def test_an_id_with_two_texts_leaves_one_row_of_each_component(spark):
    one, two = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(200))
    docs = spark.createDataFrame([(3, one), (5, two), (5, one), (5, two), (7, two), (9, "c d e")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(3, one), (5, two), (9, "c d e")]


ARTICLE = "A long sentence of an article that says something, and then some more. "


@pytest.mark.parametrize("names", ["entry-content widget", "article-share", "related-post", "story social", "sidebar", "post comments-open", "menu", "promo", "notice"])
def test_names_do_not_drop_most_of_a_page(names):
    text, page = "\n".join([(ARTICLE * 5).strip()] * 3), f'<p>{ARTICLE * 5}</p>' * 3
    assert html_text.main_text(f'<body><div class="{names}">{page}</div></body>') == text
    assert html_text.main_text(f'<body><div id=top>Some site</div><div class="{names}">{page}</div></body>').endswith(text)
    assert html_text.main_text(f'<body><form><div>{page}</div></form></body>') == text
    beside = f'<body><article>{page}</article><div class="{names}"><p>{ARTICLE * 40}</p></div></body>'
    assert html_text.main_text(beside) == text  # where an article is marked, names outside it count whatever they hold


@pytest.mark.parametrize("names", ["comments", "sidebar", "ad", "related", "share-bar", "cookie-notice", "post-comments"])
def test_names_still_drop_the_smaller_part(names):
    page = f"<body><div class=post><h1>Title of it</h1><p>{ARTICLE * 9}</p></div><div class='{names}'><p>{ARTICLE * 4}</p></div></body>"
    assert html_text.main_text(page) == "Title of it\n" + (ARTICLE * 9).strip()


def test_text_that_is_all_boilerplate_by_markup_is_none():
    assert html_text.main_text(f"<body><nav>{ARTICLE}</nav><footer>{ARTICLE}</footer><div hidden>{ARTICLE}</div><p> </p></body>") == ""
    assert html_text.main_text(f"<body><div class=ad><div class=comments>{ARTICLE}</div></div></body>") == ARTICLE.strip()


def slow_main_text(root):
    """The density rule over a tree of (tag, children), stated by recursion."""
    import math

    inline = ("a", "b", "span")

    def nodes(node):
        return [node, *(x for c in node[1] if not isinstance(c, str) for x in nodes(c))]

    def chars(node):
        return sum(len(c.replace(" ", "")) if isinstance(c, str) else chars(c) for c in node[1])

    def tags(node):
        return len(nodes(node)) - 1

    def links(node):
        if node[0] == "a":
            return chars(node), 1 + sum(x[0] == "a" for x in nodes(node)[1:])
        below = [links(c) for c in node[1] if not isinstance(c, str)]
        return sum(x for x, _ in below), sum(x for _, x in below)

    def dense(node):
        c, t, (lc, lt), (bl, _) = chars(node), max(1, tags(node)), links(node), links(root)
        if not bl or not c:
            return c / t
        base = math.log(c / max(1, c - lc) * lc + bl / max(1, chars(root)) * c + math.e)
        return c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt)) / math.log(max(base, 1.01)))

    def total(node):
        return sum(dense(c) for c in node[1] if not isinstance(c, str))

    every = nodes(root)
    best = max(range(len(every)), key=lambda i: (total(every[i]) if chars(every[i]) else -1.0, chars(every[i]), i))
    path = [x for x in every if any(y is every[best] for y in nodes(x))]
    lowest = min(map(dense, path))
    chosen = [every[best]] + [x for x in every[1:] if chars(x) and dense(x) >= lowest and (x[0] in ("p", "pre") or total(x) > 0 and not any(y is every[best] for y in nodes(x)))]
    out, block = [""], 0

    def walk(node, inside):
        nonlocal block
        inside = inside or any(node is x for x in chosen)
        if node[0] not in inline:
            out.append("")
        for c in node[1]:
            if not isinstance(c, str):
                walk(c, inside)
            elif inside:
                out[-1] += c
        if node[0] not in inline:
            out.append("")

    walk(root, False)
    return "\n".join(x for x in (" ".join(x.split()) for x in out) if x)


def test_density_equals_a_plain_statement_of_it():
    rng = random.Random(21)

    def grow(depth, inline):
        children = []
        for _ in range(rng.randint(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                children.append(" ".join(rng.choices(["one", "three", "fifteen", "to"], k=rng.randint(1, 25))) + " ")
            else:
                tag = rng.choice(["a", "b", "span"] if inline else ["div", "div", "section", "p", "a", "b", "ul"])
                if tag == "ul":
                    children.append(("ul", [("li", grow(0, True)) for _ in range(rng.randint(1, 3))]))
                else:
                    children.append((tag, grow(depth - 1, tag not in ("div", "section"))))
        return children

    def render(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(render, node[1]))}</{node[0]}>"

    for _ in range(300):
        root = ("body", grow(4, False))
        assert html_text.main_text(render(root)) == slow_main_text(root), render(root)


def test_extract_names_its_column(spark):
    pages = spark.createDataFrame([(1, "<p>a b</p>", 5)], "page_id long, html string, _text int")
    assert html_text.extract(pages).first()._text == "a b" and html_text.extract(pages, "mine").first()._text == 5
    assert html_text.extract(pages.limit(0)).count() == 0
