"""Saved models, trials in one pass, structure vectors and their SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import syntax as S
from corpusloom.operators import classifier as C
from corpusloom.sources import sinks

HUMAN = "def f{0}(n):\n    total = 0\n    for i in range(n):\n        if i > {0}:\n            total += i\n    return total\n"
OTHER = "x{0} = {0}\ny{0} = [x{0}, {0}]\nprint(x{0}, y{0}, len(y{0}))\nz{0} = {{'a': x{0}}}\n"


def labelled(spark, n=80):
    rows = [(i, (HUMAN if i % 2 else OTHER).format(i), i % 2, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, code string, label int, weight double")


def vocabulary(spark):
    nodes = labelled(spark, 4).select(F.explode(S.syntax_metrics("code")["nodes"]).alias("t")).distinct().orderBy("t").collect()
    return {r.t: i for i, r in enumerate(nodes, 1)}


def test_a_model_read_back_scores_a_folder_alike(spark, monkeypatch):
    ids, path = vocabulary(spark), sinks.work_path(spark, "model")
    model = C.fitted(C.with_subtrees(labelled(spark), ids))
    C.save(model, ids, path)
    again, held = C.load(spark, path)
    fresh = spark.createDataFrame([("a.py", HUMAN.format(900)), ("b.py", OTHER.format(901)), ("c.py", "def (:"), ("d.py", "")], "name string, code string")
    one, two = (sorted(map(tuple, C.scored(m, v, fresh, "name").collect())) for m, v in ((model, ids), (again, held)))
    assert one == two and held == ids and [r[:3] for r in one] == [("a.py", 0, 1)]  # the other has too few lines for a block
    folder = sinks.work_path(spark, "code")
    fresh.select("name", "code").write.partitionBy("name").text(folder)
    found = C.score_folder(spark, path, folder, ".txt").collect()
    assert [(r["class"], r.block, round(r.p_human, 12)) for r in found] == [(1, 0, round(one[0][4], 12))] and "a.py" in found[0].full_path
    monkeypatch.setattr(C, "python", lambda: "2.7")
    with pytest.raises(ValueError):
        C.load(spark, path)


def ready(spark, n=120):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        x = rng.normal(size=6) * (rng.random(6) < 0.6)
        x /= max(1.0, np.linalg.norm(x))
        rows.append((int(x[0] + 0.5 * x[1] > 0.05), 1.0 + i % 2, [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x != 0]]))
    return spark.createDataFrame(rows, "label long, weight double, at array<long>, x array<double>").repartition(3), rows


SPACE = [{"reg": r, "elastic": e} for r in (0.001, 0.1) for e in (0.0, 0.5)]


def test_trials_advanced_together_are_those_fitted_apart(spark):
    rows, _ = ready(spark)
    together = C.Trials(rows, 6, SPACE)
    together.advance([0, 1, 2, 3], 4)
    together.advance([1, 3], 9)
    for t in range(4):
        alone = C.Trials(rows, 6, [SPACE[t]])
        alone.advance([0], together.done[t])
        assert np.allclose(alone.weights[0], together.weights[t], atol=1e-12)
    told = C.f1_by_trial(together.predictions(rows, [1, 3]))
    assert set(told) == {1, 3} and min(told.values()) > 0.5


def test_trials_come_to_the_weights_that_minimise_their_loss(spark):
    rows, data = ready(spark)
    trials = C.Trials(rows, 6, SPACE)
    trials.advance([1], 60)

    def loss(w):
        total = sum(weight * np.log1p(np.exp(-(1 if label else -1) * (sum(w[i] * v for i, v in zip(at, x)) + w[6]))) for label, weight, at, x in data)
        reg = SPACE[1]["reg"]
        return total / sum(r[1] for r in data) + reg * (0.5 * np.abs(w[:6]).sum() + 0.25 * (w[:6] ** 2).sum())

    least, rng = loss(trials.weights[1]), np.random.default_rng(0)
    assert least < loss(np.zeros(7)) - 0.05
    fine = C.Trials(rows, 6, SPACE)
    fine.weights, fine.before, fine.done = dict(trials.weights), dict(trials.before), dict(trials.done)
    fine.advance([1], 120)
    assert abs(loss(fine.weights[1]) - least) < 2e-3 and all(loss(fine.weights[1] + 0.3 * rng.normal(size=7)) > loss(fine.weights[1]) for _ in range(20))


def test_passes_of_a_rung_do_not_grow_with_the_trials(spark, monkeypatch):
    passes, plain = [], C.Trials.gradients
    monkeypatch.setattr(C.Trials, "gradients", lambda self, weights: passes.append(len(weights)) or plain(self, weights))
    trials = C.Trials(ready(spark, 20)[0], 6, SPACE)
    trials.advance([0, 1, 2, 3], 2)
    assert passes == [4, 4]


def test_renamed_code_lies_nearer_its_source_than_unlike_code():
    codes = [HUMAN.format(1), OTHER.format(2), "class A:\n    def go(self):\n        return [x for x in self.y if x]\n", "import os\nwith open(os.devnull) as f:\n    f.read()\n"]
    vectors = [np.array(S.structure_vector(c)) for c in codes]
    for code, own in zip(codes, vectors):
        new = np.array(S.structure_vector(S.renamed(code)))
        assert np.isclose(new @ own, 1.0) and all(new @ v < 0.9 for v in vectors if v is not own)
        longer = np.array(S.structure_vector(code + "extra = 1\n"))
        assert longer @ own > max(longer @ v for v in vectors if v is not own)
    assert S.structure_vector("def (:") is None and S.structure_vector(None) is None and len(S.structure_vector("")) == S.WIDTH


def test_structure_and_neighbours_are_called_from_sql(spark):
    S.register(spark)
    spark.createDataFrame([(i, (HUMAN if i % 2 else OTHER).format(i), i % 3 % 2) for i in range(9)] + [(9, "def (:", 0)], "id long, code string, part int").createOrReplaceTempView("sql_code")
    found = spark.sql("""SELECT * FROM nearest_in_group(rows => TABLE(SELECT id, part, embed_code(code) AS v FROM sql_code) PARTITION BY part, k => 2, id => 'id', vector => 'v')""").collect()
    rows = {r.id: (r.part, r.v) for r in spark.sql("SELECT id, part, embed_code(code) AS v FROM sql_code").collect()}
    want = set()
    for q, (part, v) in rows.items():
        others = sorted((-round(float(np.dot(v, w)), 6), i) for i, (p, w) in rows.items() if i != q and p == part and w and v)
        want |= {(q, i, rank) for rank, (_, i) in enumerate(others[:2], 1)}
    assert {(r["query"], r.neighbour, r["rank"]) for r in found} == want and want


def test_codes_are_encoded_where_they_are_dealt_out(spark):
    from corpusloom.operators import classifier
    from corpusloom.plans import fixtures

    rows = classifier.with_subtrees(fixtures.code_files(spark, "/root/testdata/sf0.001").select("id", "code"), {"Module": 1})
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "ArrowEvalPython" not in plan[plan.index("Exchange") :]  # metrics, then subtrees
