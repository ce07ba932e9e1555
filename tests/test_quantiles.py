"""Quantiles by selection over ranges against those of all values in order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import quantiles as Q
from corpusloom.operators import ranks as R
from corpusloom.operators import stats as A

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("few", [1, 7, 100_000])
def test_quantiles_equal_those_of_sorted_values(spark, few):
    rng = random.Random(few)
    groups = {
        "a": [rng.gauss(0, 1e6) for _ in range(700)], "b": [5.0] * 40, "c": [1.0, 1.0, 2.0], None: [float(rng.randrange(4)) for _ in range(90)],
        "d": [1e-300, 1e300, 3.0, 3.0000000000000004], "e": [7.0], "skewed": [0.0] * 300 + [1e9] + [rng.random() for _ in range(30)],
    }
    rows = [(g, x) for g, values in groups.items() for x in values] + [("a", None), ("b", float("nan")), ("none", None)]
    rng.shuffle(rows)
    found = {r.g: (r.n, r.quantiles) for r in Q.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", SHARES, few).collect()}
    assert found.keys() == groups.keys()
    for g, values in groups.items():
        assert found[g][0] == len(values) and np.allclose(found[g][1], np.quantile(values, SHARES), rtol=1e-12)


def test_as_many_distinct_values_as_rows_are_never_in_one_task(spark, monkeypatch):
    n = 60_000
    rows = spark.range(n).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % n).cast("double").alias("x"))
    sizes, plain = [], Q.write_parquet
    monkeypatch.setattr(Q, "write_parquet", lambda df, path: sizes.append((path.rsplit("/", 1)[1].split("-")[0], (out := plain(df, path)).count())) or out)
    found = {r.g: r.quantiles for r in Q.exact_quantiles(rows, "g", "x", [0.5, 0.99], few=500).collect()}
    for g in (0, 1):
        assert np.allclose(found[g], np.quantile([i * 7919 % n for i in range(n) if i % 2 == g], [0.5, 0.99]))
    assert max(m for name, m in sizes if name in ("ranges", "found", "targets")) <= 16  # a row for each rank that is looked for


def test_bins_and_statistics_by_selection_equal_those_in_one_task(spark, monkeypatch):
    rows = spark.range(3000).select("id", (F.col("id") * 37 % 1009).alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 2)).alias("class"))
    texts = rows.select("class", F.repeat(F.lit("x"), F.col("x").cast("int")).alias("code"))
    binned = lambda: sorted(map(tuple, R.quantile_bins(rows, F.col("x") - F.lit(1e-7), "bin", by=["class"]).select("id", "bin").collect()))
    told = lambda: sorted(map(str, A.length_stats(texts).collect()))
    bins, stats = binned(), told()
    monkeypatch.setattr(Q.exact_quantiles, "__defaults__", (50,))
    assert binned() == bins and told() == stats and {b for _, b in bins} == set(range(10)) and len(stats) == 3
    assert A.length_stats(texts.limit(0)).count() == 0
