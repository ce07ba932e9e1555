"""Every registered query against its SQL twin on the smallest tables; those without one give rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 8) + 0.0 if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=str)
    if sql := entry.oracle_sql().get(name):
        twin = duck.sql(sql)
        assert sorted(twin.columns) == columns
        assert rows == sorted((tuple(map(plain, r)) for r in twin.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=str)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_code_pairs_meet_all_codes_or_the_nearest(spark):
    from corpusloom.plans import models as M

    codes = M.distinct_codes(spark, DATA).cache()
    asked = codes.where("id % 50 = 0").count()
    pairs = entry.queries()["pair_similarity"](spark, DATA).cache()
    assert pairs.count() == pairs.select("query_id", "match_id").distinct().count() == asked * codes.count()
    a, b = (codes.select(codes.id.alias(f"{x}_id"), M.S.syntax_metrics("code")["nodes"].alias(x)) for x in ("query", "match"))
    plain_ratio = pairs.where("match_id % 29 = 0").join(a, "query_id").join(b, "match_id").where(M.F.abs(M.S.sequence_ratio("query", "match") - M.F.col("ratio")) > 1e-12)
    assert plain_ratio.count() == 0
    every = entry.queries()["pair_similarity_all"](spark, DATA).cache()
    assert every.agg(M.F.sum("codes")).first()[0] == asked * codes.count() and every.select("id").distinct().count() == codes.count()
    told = every.where("ratio IS NOT NULL").select("id", "match_class", "ratio").distinct().collect()
    match = every.select(M.F.col("id").alias("match_id"), M.F.col("class_id").alias("match_class")).distinct()
    assert set(told) == set(pairs.join(match, "match_id").select("query_id", "match_class", "ratio").distinct().collect())
    parsed = codes.where(M.S.is_valid_code("code"))
    ranked = entry.queries()["ted_rerank"](spark, DATA).groupBy("query_id").count().collect()
    assert len(ranked) == parsed.where("id % 50 = 0").count() and {r["count"] for r in ranked} == {min(100, parsed.count() - 1)}


def test_pair_similarity_has_a_row_for_each_query_and_code(spark, monkeypatch):
    import ast
    import difflib

    from corpusloom.plans import models as M
    from corpusloom.plans.shapes import names_of

    rows = [(50, "x = 1\n"), (51, "y = 2\n"), (52, "def f(x):\n    return x\n"), (100, "def f(:\n"), (101, "def g(:\n"), (102, "def g(x):\n    return -x\n"), (103, "x = 1\n")]
    monkeypatch.setattr(M, "code_files", lambda spark, sf_dir: spark.createDataFrame(rows, "id long, code string"))
    nodes = {i: [] if ":\n" in code[:8] else names_of(ast.parse(code)) for i, code in rows[:-1]}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    found = entry.queries()["pair_similarity"](spark, DATA).select("query_id", "match_id", "ratio").collect()
    assert sorted(map(tuple, found)) == [(q, i, ratio(nodes[q], nodes[i])) for q in (50, 100) for i in sorted(nodes)]


def test_every_rewrite_has_its_original(spark):
    from corpusloom.plans import models as M

    asked = {r.id for r in M.distinct_codes(spark, DATA).where("id % 50 = 0").where(M.S.is_valid_code("code")).collect()}
    ranks = {r.query_id: r["rank"] for r in M.ranked_originals(spark, DATA).collect()}
    assert set(ranks) == asked and all(0 < r <= 100 for r in ranks.values())


def test_rewrites_are_searched_for_in_all_codes_and_all_that_are_asked_count(spark, monkeypatch):
    from corpusloom.plans import models as M

    short, broken, twice = "def f(x):\n    return x\n", "def f(:\n    return 1\n", "import os\nimport sys\n"
    near = [(1000 + 50 * i + 1, "def f(v0)\n    return v0 :\n" + "\n" * i) for i in range(100)]  # the words of short's rewrite, but no Python
    rows = [(50, short), (100, broken), (7, twice), (150, twice), (8, "x = 1\n"), *near]
    monkeypatch.setattr(M, "code_files", lambda spark, sf_dir: spark.createDataFrame(rows, "id long, code string"))
    assert {r.query_id: r["rank"] for r in M.ranked_originals(spark, DATA).collect()} == {50: -1, 100: -1, 7: 1}
    rows = rows[:-2]  # of the hundred places broken has one and short the last
    assert {r.query_id: r["rank"] for r in M.ranked_originals(spark, DATA).collect()} == {50: 1, 100: -1, 7: 1}


def test_classifier_reads_shapes_and_the_search_drops_the_weaker(spark):
    rows = entry.queries()["train_classifier"](spark, DATA).collect()
    assert sum(r.label == r.pred for r in rows) / len(rows) > 0.95 and all(0 <= r.p_human <= 1 for r in rows)
    log = entry.queries()["tune_classifier"](spark, DATA).collect()
    trials = {n: {r.trial: r.f1 for r in log if r.iterations == n} for n in (2, 6, 18)}
    assert [len(trials[n]) for n in (2, 6, 18)] == [6, 2, 1] and set(trials[18]) < set(trials[6]) < set(trials[2])
    assert min(trials[2][t] for t in trials[6]) >= max(f for t, f in trials[2].items() if t not in trials[6])


def test_every_query_but_the_drawn_and_learned_has_a_twin():
    without = set(catalog.queries()) - set(catalog.oracle_sql())
    assert without == {"knn_cosine_approx", "uniqueness_score", "most_unique_code", "train_classifier", "tune_classifier", "score_files", "rewrite_retrieval_eval"}


def test_keys_are_thousandths_in_the_vectors_own_precision(spark, duck, tmp_path):
    values = [0.29, 0.57, 0.009, 0.069, -0.29, 0.1, 0.0, 1.5]
    spark.createDataFrame([(1, values), (2, [])], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    twin = duck.sql(entry.oracle_sql()["stringify_key"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    found = entry.queries()["stringify_key"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == set(twin) == {(1, "[290,570,9,69,-290,100,0,1500]"), (2, "[]")}
