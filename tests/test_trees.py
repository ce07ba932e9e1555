"""Tree distances with bounds, and the joins that use them, against plain forms."""

import ast
import difflib
import json
import random
import time
from functools import lru_cache
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import syntax as S
from corpusloom.functions import trees as T
from corpusloom.operators import similarity as N

LABELS = [("A",), ("B",), ("C", "x"), ("C", "y"), ("D", "u", "v"), ("D", "u", "w")]


def some_tree(rng, n):
    """A random tree of n nodes, numbered in preorder."""
    below = {i: [] for i in range(n)}
    for i in range(1, n):
        below[rng.randrange(max(0, i - rng.choice([1, 3, 100])), i)].append(i)
    nodes = []

    def put(i):
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (rng.choice(LABELS), [put(c) for c in below[i]])
        return at

    put(0)
    return T.Tree(nodes)


def plain_distance(a, b):
    nested = lambda t, i: (t.nodes[i][0], tuple(nested(t, c) for c in t.nodes[i][1]))

    @lru_cache(None)
    def far(x, y):
        if not x or not y:
            return sum(10 + far(t[1], ()) for t in x + y) if x or y else 0
        (la, ca), (lb, cb) = x[-1], y[-1]
        return min(far(x[:-1] + ca, y) + 10, far(x, y[:-1] + cb) + 10, far(x[:-1], y[:-1]) + far(ca, cb) + T.label_cost(la, lb))

    return far((nested(a, 0),), (nested(b, 0),))


@pytest.mark.parametrize("seed", range(4))
def test_distances_equal_the_recursion_and_bounds_lie_below(seed):
    rng = random.Random(seed)
    for _ in range(150):
        a, b = some_tree(rng, rng.randint(1, 11)), some_tree(rng, rng.randint(1, 11))
        want, limit = plain_distance(a, b), rng.randint(0, 110)
        assert T.distance(a, b) == T.distance(b, a) == T.distance(a, b, None, T.Known()) == want
        assert T.quick_bound(a, b) <= T.lower_bound(a, b) <= want
        assert T.distance(a, b, limit) == (want if want <= limit else None)


def plain_sequence_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_sequence_distances_equal_the_table():
    rng = random.Random(1)
    for _ in range(400):
        a, b = (["ABC"[rng.randrange(3)] for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert T.sequence_distance(a, b) == plain_sequence_distance(a, b)


def test_the_most_similar_trees_and_ranks_are_those_of_all_distances():
    rng = random.Random(5)
    for _ in range(25):
        query = (some_tree(rng, 12), 12)
        others = [(t := some_tree(rng, rng.randint(3, 30)), t.size + rng.randint(0, 3)) for _ in range(40)]
        exact = sorted(((-T.similarity(T.distance(query[0], t), max(12, n)), i) for i, (t, n) in enumerate(others)))
        best, begun = T.most_similar(query, others, 5)
        assert [(-s, i) for i, s in best] == exact[:5] and begun < 40
        place = rng.randrange(40)
        assert T.rank_among(query, others, place)[0] == [i for _, i in exact].index(place) + 1


def test_bounds_decide_most_of_a_top_list_of_real_files():
    """Functions of the standard library: nine in ten of the distances are never begun."""
    folder = Path(json.__file__).parent.parent
    found = [n for f in ("textwrap.py", "shlex.py", "bisect.py", "heapq.py", "json/decoder.py", "csv.py", "fnmatch.py", "string/__init__.py", "glob.py", "copy.py", "calendar.py") if (folder / f).exists() for n in ast.walk(ast.parse((folder / f).read_text())) if isinstance(n, ast.FunctionDef)]
    trees = [(S.comparable(n), sum(1 for _ in ast.walk(n))) for n in found]
    assert len(trees) > 100
    begun = 0
    for i in range(0, len(trees), 10):
        best, more = T.most_similar(trees[i], trees, 3)
        begun += more
        assert best[0][1] == 1.0
    assert begun < 0.2 * len(range(0, len(trees), 10)) * len(trees)


def test_a_file_of_thousands_of_nodes_takes_seconds():
    folder = Path(json.__file__).parent.parent
    one, two = (S.sized((folder / f).read_text()) for f in ("textwrap.py", "calendar.py"))
    big = S.sized("\n".join((folder / f).read_text() for f in ("calendar.py",)))
    assert big[1] > 3000 and one[1] > 1000
    began = time.time()
    far = T.distance(one[0], two[0])
    assert time.time() - began < 60 and T.lower_bound(one[0], two[0]) <= far <= 10 * (one[0].size + two[0].size)


def test_reranked_neighbours_are_ordered_by_trees(spark):
    codes = [(1, "x = 1\n"), (2, "x = 2\n"), (3, "def f(a):\n    return a\n"), (4, "def (:"), (5, None), (6, "for i in y:\n    print(i)\n"), (7, "x = 1\n")]
    held = spark.createDataFrame(codes, "id long, code string")
    found = spark.createDataFrame([(q, m, i) for q in (1, 3, 4) for i, (m, _) in enumerate([c for c in codes if c[0] != q], 1)], "query_id long, match_id long, rank int")
    rows = N.ted_rerank(found, held, held).collect()
    assert {r.query_id for r in rows} == {1, 3} and all(r.match_id not in (4, 5) for r in rows)
    by = dict(codes)
    for q in (1, 3):
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r.ted for r in mine] == [S.ted(by[q], by[r.match_id]) for r in mine]
        assert [(-r.ted, r.original_ranking) for r in mine] == sorted((-r.ted, r.original_ranking) for r in mine)
        top = N.ted_rerank(found, held, held, 2).where(F.col("query_id") == q).orderBy("rank").collect()
        assert top == mine[:2]
    own = spark.createDataFrame([(1, 7, 2), (1, 1, 3), (1, 2, 1), (3, 1, 1)], "query_id long, match_id long, rank int")
    assert [tuple(r) for r in N.rank_by_trees(own, held, held).collect()] == [(1, 2)]  # as near as 7, which ranks before it
    assert N.ted_rerank(found.limit(0), held, held).count() == 0


def test_similar_pairs_are_those_of_all_ratios(spark):
    rng = random.Random(7)
    kinds = [f"N{i}" for i in range(12)]
    base = [[rng.choice(kinds) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    rows = []
    for i in range(140):
        nodes = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            nodes.insert(rng.randrange(len(nodes) + 1), rng.choice(kinds))
        rows.append((i, nodes))
    rows += [(200, None), (210, []), (211, ["N1"] * 300), (220, ["N1"] * 299 + ["N2"])]
    codes = spark.createDataFrame(rows, "id long, nodes array<string>")
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    for at_least, k in ((0.8, 5), (0.3, 200)):
        want = set()
        for q, a in rows:
            if q % 10 == 0:
                all_of = sorted((-ratio(a, b), m) for m, b in rows if m != q and ratio(a, b) >= at_least)
                want |= {(q, m, -r, i) for i, (r, m) in enumerate(all_of[:k], 1)}
        found = N.similar_pairs(codes, codes.where("id % 10 = 0"), "id", "nodes", at_least, k)
        assert {tuple(r) for r in found.collect()} == want
    assert N.similar_pairs(codes.limit(0), codes, "id", "nodes", 0.5, 3).count() == 0


def test_ratios_of_classes_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    kinds = [[rng.choice("ABCDE") for _ in range(rng.randint(1, 9))] for _ in range(12)] + [None, []]
    rows = [(i, kinds[i % 14] if i < 28 else rng.choice(kinds)) for i in range(90)]
    codes = spark.createDataFrame(rows, "id long, nodes array<string>")
    members, pairs = N.class_ratios(codes, codes.where("id % 10 = 0"), "id", "nodes")
    of, ratios = {r.id: r.class_id for r in members.collect()}, {(r.query_id, r.match_id): r.ratio for r in pairs.collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    assert len(of) == 90 and len(set(of.values())) == len({tuple(x or ()) for x in kinds}) and all(c == min(i for i in of if of[i] == c) for c in of.values())
    assert all(ratios[of[q], of[m]] == ratio(a, b) for q, a in rows if q % 10 == 0 for m, b in rows)
    assert set(ratios) == {(of[q], c) for q in range(0, 90, 10) for c in of.values()}
    assert all(x.count() == 0 for x in N.class_ratios(codes.limit(0), codes.limit(0), "id", "nodes"))


def test_equal_trees_are_compared_once():
    trees, known = S.Trees(), T.Known()
    a, b, c = (trees[x][0] for x in ("x = f(1)\n", "# note\nx = f(1)\n", "x = f(2)\n"))
    assert a is b and a is not c
    assert T.distance(a, c, None, known) == T.distance(a, c) == T.distance(b, c, None, known) == 1 and len(known.pairs) == 1
    assert T.distance(b, c, 0, known) is None and T.distance(b, c, 1, known) == 1


def test_neighbours_of_copies_are_those_of_all_vectors(spark):
    rng = random.Random(5)
    kinds = [[rng.random() for _ in range(4)] for _ in range(6)]
    rows = spark.createDataFrame([(i, rng.choice(kinds)) for i in range(120)], "id long, v array<float>")
    for own in (False, True):
        want, found = (f(rows, rows.where("id % 10 = 0"), "id", "v", 7, own=own) for f in (N.knn_cosine, N.knn_of_copies))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = N.knn_of_copies(rows, rows, "id", "v", 7)
    assert plan.count() == 840 and N.knn_of_copies(rows.limit(0), rows.limit(0), "id", "v", 7).count() == 0


def test_pair_ratios_are_of_all_pairs_whatever_the_shards(spark, monkeypatch):
    rng = random.Random(5)
    kinds = [[rng.choice("ABCDE") for _ in range(rng.randint(1, 9))] for _ in range(12)] + [None, []]
    rows = [(i, kinds[0] if i % 2 else rng.choice(kinds)) for i in range(90)]  # one sequence is every second code's
    codes = spark.createDataFrame(rows, "id long, nodes array<string>")
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    want = [(q, m, ratio(a, b)) for q, a in rows if q % 3 == 0 for m, b in rows]
    for shard, known, block in ((4096, 1_000_000, 128), (7, 5, 4)):
        monkeypatch.setattr(N, "KNOWN", known)
        monkeypatch.setattr(N, "PAIR_BLOCK", block)
        assert sorted(map(tuple, N.pair_ratios(codes, codes.where("id % 3 = 0"), "id", "nodes", shard).collect())) == want
    assert all(N.pair_ratios(codes.limit(n), codes.limit(m), "id", "nodes").count() == 0 for n, m in ((0, 9), (9, 0), (0, 0)))
