"""The keyed table: what a change touches, what a reader sees, what a failure and a repeat leave."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import sinks
from corpusloom.sources.keyed import KeyedTable


def made(spark, n=1000, buckets=16):
    rows = spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"), (F.col("id") % 2 == 0).alias("done"))
    return KeyedTable.create(rows, sinks.work_path(spark, "keyed"), "k", buckets)


def content(table, version=None):
    return {r.k: (r.v, r.done) for r in table.read(version).collect()}


def changed_buckets(table):
    before, after = (table.manifest(v)["files"] for v in table.versions()[-2:])
    return {b for b in {*before, *after} if before.get(b) != after.get(b)}


def test_a_change_of_few_keys_touches_their_buckets_alone(spark):
    table = made(spark)
    held = content(table)
    assert len(held) == 1000 and table.versions() == [0, 1]
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark.createDataFrame([("a", 1, True)], "k string, v long, done boolean"), table.path, "k")
    few = spark.createDataFrame([("k5", 500, True), ("k5", 3, False), ("new", 7, False), ("new", 6, True)], "k string, v long, done boolean")
    assert table.insert_new(few, "v") == 2
    assert content(table) == {**held, "new": (6, True)} and len(changed_buckets(table)) <= 1
    assert table.combine(few, {"v": F.min, "done": F.bool_or}) == 3
    assert content(table) == {**held, "new": (6, True), "k5": (3, True)} and len(changed_buckets(table)) <= 2
    assert table.delete(few.where("k = 'k5'")) == 4 and len(changed_buckets(table)) == 1
    assert content(table) == {k: v for k, v in {**held, "new": (6, True)}.items() if k != "k5"}
    assert content(table, 1) == held  # an old version is still whole
    assert table.delete(few.limit(0)) is None and table.newest() == 4


def test_a_failed_change_leaves_the_version_before(spark, monkeypatch):
    table = made(spark, 100)
    held = content(table)
    broken = spark.createDataFrame([("k1",)], "k string").select("k", F.raise_error(F.lit("lost")).cast("long").alias("v"), F.lit(True).alias("done"))
    with pytest.raises(Exception, match="lost"):
        table.insert_new(broken)
    fine = spark.createDataFrame([("x", 1, True)], "k string, v long, done boolean")
    with monkeypatch.context() as patch:
        patch.setattr(table, "write_manifest", lambda manifest: (_ for _ in ()).throw(OSError("no room")))
        with pytest.raises(OSError):
            table.insert_new(fine)
    assert table.newest() == 1 and content(table) == held
    assert table.insert_new(fine) == 2 and content(table) == {**held, "x": (1, True)}
    with pytest.raises(RuntimeError):  # another writer was faster
        table.write_manifest({**table.manifest(1), "version": 2})
    assert table.vacuum() > 0 and table.versions() == [2] and content(table) == {**held, "x": (1, True)}


def test_a_batch_that_comes_again_adds_nothing(spark):
    table = made(spark, 10)
    rows = spark.createDataFrame([("b", 1, True)], "k string, v long, done boolean")
    assert table.insert_new(rows, mark=("s", 0)) == 2 and table.insert_new(rows.withColumn("k", F.lit("c")), mark=("s", 0)) is None
    assert table.insert_new(rows.limit(0), mark=("s", 1)) == 3 and table.manifest()["marks"] == {"s": 1}
    assert table.insert_new(rows.withColumn("k", F.lit("c")), mark=("other", 0)) == 4 and len(content(table)) == 12


def test_null_keys_additions_in_many_parts_and_more_buckets(spark):
    table = KeyedTable.create(spark.createDataFrame([], "k string, v long"), sinks.work_path(spark, "keyed"), "k", 1)
    assert table.read().count() == 0
    for i in range(11):
        table.insert_new(spark.createDataFrame([(None, i), (f"k{i}", i)], "k string, v long"))
    found = {r.k: r.v for r in table.read().collect()}
    assert found == {None: 0, **{f"k{i}": i for i in range(11)}}
    assert max(map(len, table.manifest()["files"].values())) <= 9
    table.rebucket(5)
    assert {r.k: r.v for r in table.read().collect()} == found and table.manifest()["buckets"] == 5
    assert json.dumps(table.manifest())
