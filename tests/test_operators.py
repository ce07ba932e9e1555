"""Operators on edge rows: nulls, ties, empty tables, exact sizes, repeated runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import ledgers as L
from corpusloom.operators import ranks as R
from corpusloom.operators import sampling as P
from corpusloom.operators import similarity as N
from corpusloom.operators import stats as A
from corpusloom.operators import vector_index as V
from corpusloom.sources import scans, sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "column, value, want",
    [
        (T.is_success, None, True), (T.is_success, " No ", False), (T.is_success, "none", False), (T.is_success, "", True), (T.is_success, "\u00a0FAILED\u2003", False),
        (T.fenced_code, "no fence", None), (T.fenced_code, "```python\n```", ""), (T.fenced_code, "```\na\n```\n```python\nb\n```", "b"), (T.fenced_code, None, None),
        (T.without_fence, "```python\nx\n```", "x"), (T.without_fence, " y ", "y"),
        (T.number_or_null, "1e3", 1000.0), (T.number_or_null, "5d", None), (T.number_or_null, " 7 ", 7.0), (T.number_or_null, "", None),
        (T.renamed_model, "gpt-4o", "gpt-4o-2024-11-20"), (T.renamed_model, "other", "other"), (T.renamed_model, None, None),
        (T.comment_free, "a # b\r\n\n#c\nd\u00a0\x0be", "a\nd\ne"), (T.first_line, "ab\nc", "ab"), (T.truthy, "0", None),
    ],
)
def test_text(spark, column, value, want):
    assert one(spark, column, value) == want


def test_dedup_keeps_nulls_apart_from_text(spark):
    df = spark.createDataFrame([(1, None), (2, "None"), (3, None), (4, "a")], "id int, k string")
    ids = lambda keep: sorted(r.id for r in R.dedup_rows(df, ["k"], "id", keep).collect())
    assert ids("first") == [1, 2, 4] and ids("last") == [2, 3, 4] and ids(None) == [2, 4]
    with pytest.raises(ValueError):
        R.dedup_rows(df, ["missing"], "id")


def test_quantile_bins_refuse_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 20 + [(2.0,)], "x double")
    with pytest.raises(Exception, match="unique"):
        R.quantile_bins(df, F.col("x"), "bin").collect()
    assert R.quantile_bins(df, F.col("x"), "bin", duplicates="drop").count() == 21


def test_splits_are_disjoint_exact_and_repeat(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    once = {r.k: r.is_test for r in P.split(df, "c", "k", 0.1, 1).collect()}
    assert once == {r.k: r.is_test for r in P.split(df.repartition(7), "c", "k", 0.1, 1).collect()}
    assert sum(once.values()) == 33 + 66
    sizes = {r.c: r["count"] for r in P.balance_classes(df, "c", "k", 1).groupBy("c").count().collect()}
    assert sizes == {"a": 334, "b": 334}
    tests = P.balanced_test_split(df, "c", "k", 0.1, 1).where("is_test").groupBy("c").count().collect()
    assert {r["count"] for r in tests} == {33}
    assert P.stratified_sample(df, ["c"], "k", 100, 10, 1).count() == 20


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1)], "h string, n int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "h string, n int")
    assert [tuple(r) for r in L.upsert_ignore(new, old, "h", "n").collect()] == [("b", 3)]
    assert L.upsert_ignore(new.limit(0), old, "h", "n").count() == 0


def test_row_ids_number_all_rows(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    got = sorted((r.k, r.row_id) for r in L.row_ids(df, "k").collect())
    assert got == [(i, i + 1) for i in range(500)]


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "label int, pred int")
    assert A.macro_f1_accuracy(none).first().accuracy is None
    assert A.retrieval_stats(spark.createDataFrame([], "rank int")).first().found == 0
    assert A.retrieval_stats(spark.createDataFrame([(-1,), (1,), (7,)], "rank int")).first().top_1 == 50.0


def test_neighbours_exact_and_approximate(spark):
    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(6)]).alias("v"))
    asked = rows.where("vec_id % 50 = 0")
    exact = N.knn_cosine(rows, asked, "vec_id", "v", 10, shard=64)
    whole = N.knn_cosine(rows, asked, "vec_id", "v", 10)
    assert {tuple(r) for r in exact.collect()} == {tuple(r) for r in whole.collect()} and exact.count() == 50  # the zero vector takes no part
    assert N.recall(V.knn_cosine_approx(rows, asked, "vec_id", "v", 10), exact).first().recall >= 0.9
    every = V.knn_cosine_approx(rows, asked, "vec_id", "v", 10, share=1.0, candidates=300)
    assert {tuple(r) for r in every.collect()} == {tuple(r) for r in exact.collect()}  # all cells are all rows


def test_approximate_neighbours_of_odd_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0])], "vec_id long, v array<double>")
    exact, found = (sorted(map(tuple, f(rows, rows, "vec_id", "v", 5).collect())) for f in (N.knn_cosine, V.knn_cosine_approx))
    assert found == exact and len(found) == 12
    for base, asked in ((rows.limit(0), rows), (rows, rows.limit(0)), (rows.where("vec_id = 1"), rows.where("vec_id = 1"))):
        assert V.knn_cosine_approx(base, asked, "vec_id", "v", 5).count() == 0


def test_approximate_neighbours_of_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = rows.where("vec_id % 50 = 0")
    exact, found = (f(rows, asked, "vec_id", "embedding", 100) for f in (N.knn_cosine, V.knn_cosine_approx))
    assert N.recall(found, exact).first().recall >= 0.9


def test_an_index_of_clustered_vectors_reads_few_rows_and_finds_most_neighbours(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 32))
    data = [(i, (middles[i % 40] + 0.35 * rng.normal(size=32)).tolist()) for i in range(4000)]
    rows = spark.createDataFrame(data, "id long, v array<double>")
    asked = rows.where("id % 50 = 0")
    index = V.build(rows, "id", "v")
    assert len(index.centres) == 63 and index.codes.count() == 4000 and index.codes.where("length(code) <> 8").count() == 0
    found, exact = V.search(index, asked, "id", "v", 50, share=0.12, candidates=150), N.knn_cosine(rows, asked, "id", "v", 50)
    assert N.recall(found, exact).first().recall >= 0.9
    near = found.join(exact.withColumnsRenamed({"cosine": "c", "rank": "r"}), ["query_id", "vec_id"])
    assert near.where("abs(cosine - c) > 1e-9").count() == 0  # rated by vectors
    probed = V.search(index, asked, "id", "v", 4000, share=0.12, candidates=4000).groupBy("query_id").count().agg(F.avg("count")).first()[0]
    assert probed < 4000 / 5


def test_codes_are_near_their_vectors():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(3000, 4))
    words = V.fitted_words(rows, 256)
    far, plain = rows - words[V.nearest(rows, words)], ((rows[:, None] - words) ** 2).sum(2).min(1)
    assert words.shape == (256, 4) and np.allclose((far**2).sum(1), plain) and plain.mean() < 0.1 * (rows**2).sum(1).mean()
    assert len(V.fitted_words(rows[:5].repeat(9, axis=0), 256)) == 5


def test_uniqueness_is_between_its_bounds(spark):
    rows = spark.createDataFrame([(i, ["A", "B", "C"][: 1 + i % 3]) for i in range(40)], "id int, nodes array<string>")
    got = N.uniqueness_score(rows, "id", "nodes", 5, 1).collect()
    assert len(got) == 40 and all(0 <= r.uniqueness <= 1 for r in got)


def test_uniqueness_meets_all_rows_or_a_fair_draw(spark):
    rows = spark.createDataFrame([(i, ["A"] * (i + 1)) for i in range(12)], "id int, nodes array<string>")
    ratio = lambda i, j: 2 * (min(i, j) + 1) / (i + j + 2)
    want = {i: 1 - sum(ratio(i, j) for j in range(12)) / 12 for i in range(12)}
    got = {r.id: r.uniqueness for r in N.uniqueness_score(rows, "id", "nodes", 1000, 1).collect()}
    assert got == pytest.approx(want, abs=1e-9) and N.PARTNERS == 1000
    unlike = spark.createDataFrame([(i, [f"N{i}"]) for i in range(100)], "id int, nodes array<string>")
    selves = [r.uniqueness for r in N.uniqueness_score(unlike, "id", "nodes", 10, 1).collect()]
    assert set(selves) == {0.9, 1.0} and selves.count(0.9) < 30  # a row meets itself by chance only


def test_uniqueness_by_joins_equals_that_in_one_step(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [f"N{i % 9}"] * (i % 4) + ["A", "B"]) for i in range(60)], "id int, nodes array<string>")
    found = lambda: {r.id: r.uniqueness for r in N.uniqueness_score(rows, "id", "nodes", 20, 1).collect()}
    once = found()
    monkeypatch.setattr(N, "SEQUENCES", 3)
    assert found() == pytest.approx(once, abs=1e-9) and len(once) == 60
    assert N.uniqueness_score(rows.limit(0), "id", "nodes", 20, 1).count() == 0


def test_neighbours_of_vectors_of_unlike_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 0.0, 1.0]), (4, []), (5, None), (6, [0.0, 0.0])], "id long, v array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.cosine, 6)) for r in N.knn_cosine(rows, rows.where("id = 1"), "id", "v", 5).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (3, 0.707107)}
    assert N.knn_cosine(rows.limit(0), rows, "id", "v", 5).count() == N.knn_cosine(rows, rows.limit(0), "id", "v", 5).count() == 0


def test_work_is_dropped_and_settings_stay(spark):
    from pathlib import Path
    from types import SimpleNamespace

    path = sinks.work_path(spark, "gone")
    held = spark.conf.get("spark.checkpoint.dir")
    assert path.startswith(held + "/")
    other = SimpleNamespace(conf={}, sparkContext=spark.sparkContext)  # a local session without the setting
    local = sinks.work_path(other, "x")
    assert local.startswith("file:///") and not other.conf and sinks.work_top(other) == sinks.work_top(other)
    spark.range(3).write.parquet(local)
    sinks.drop_work(other)
    assert not Path(local.removeprefix("file://")).exists()
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sized = scans.scan_batches(spark.range(1000), 100).agg(F.max("batch_rows"), F.count("*")).first()
    assert tuple(sized) == (100, 1000) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows


def test_sinks_give_back_what_they_wrote(spark):
    df = spark.range(90).select("id", F.lit(None).cast("string").alias("x"))
    path = sinks.work_path(spark, "t")
    assert sinks.write_capped_files(df.coalesce(1), path, 20).count() == 90
    assert len(spark.read.parquet(path).inputFiles()) == 5
    assert sinks.compact(spark, path, sinks.work_path(spark, "t"), 1).count() == 90


def test_source_files_of_other_names_are_not_read(spark):
    path = sinks.work_path(spark, "sources")
    for name, text in (("a", "x = 1"), ("b", "y = 2\n")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
    spark.createDataFrame([(1,)], "n int").coalesce(1).write.json(f"{path}/c")
    found = scans.scan_source_files(spark, path, ".txt")
    assert {r.code for r in found.collect()} == {"x = 1\n", "y = 2\n\n"} and len(found.inputFiles()) == 2
    assert scans.scan_source_files(spark, path, "*").count() == 0  # not a pattern


def test_broken_response_lines(spark):
    lines = spark.createDataFrame([(None,), ("",), ("{",), ('{"custom_id":"a","response":{"status_code":200,"body":{"data":[]}}}',), ('{"custom_id":"b","response":{"status_code":200,"body":{"data":[{"embedding":[1]}]}}}',)], "value string")
    assert [r.failed for r in scans.parse_responses(lines).collect()] == [True, True, True, True, False]


def test_rungs_are_not_ranked_in_one_task(spark):
    log = spark.range(400).select(F.lit(1).alias("b"), F.lit(1).alias("e"), F.col("id").alias("t"), (F.col("id") * 7 % 400).alias("f1"))
    found = R.rung_promotions(log, "b", "e", "t", "f1", [1], 3)
    want = sorted(range(400), key=lambda t: (-(t * 7 % 400), t))[:134]
    assert [r.t for r in found.orderBy("rank").collect()] == want and found.columns == [*log.columns, "rank"]
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()  # windows over written ranges


def test_lease_states_stay_out_of_the_driver(spark):
    from corpusloom.plans import models as M

    assert M.lease_state(spark, "/root/testdata/sf0.001").inputFiles()


def test_a_unique_code_is_rated_once_however_many_rows(spark, monkeypatch):
    from corpusloom.plans import pipelines

    monkeypatch.setattr(N, "NUMBERS", 3)  # rows are told by their sequence's number, not joined
    monkeypatch.setattr(N, "rated_by_joins", None)
    found = pipelines.most_unique_code(spark, "/root/testdata/sf0.001")
    assert "uniqueness(" not in found._jdf.queryExecution().optimizedPlan().toString()  # ranked from what is written
    assert found.count() > 0
