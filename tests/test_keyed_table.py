"""The keyed table against plain dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from plotlens.sources.keyed_table import Conflict, KeyedTable

SCHEMA = "k long, name string, price double, seen int"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)


def rows(df):
    return {r["k"]: tuple(r)[1:] for r in df.select("k", "name", "price", "seen").collect()}


def test_batches_against_a_dictionary(spark, table):
    draw, want = random.Random(3), {}
    for number in range(3):
        batch = [(draw.randrange(60) if draw.random() < 0.95 else None, draw.choice([None, "a", "b"]), draw.choice([None, 1.0, 2.5]), at) for at in range(40)]
        known = number == 1
        got = table.upsert(spark.createDataFrame(batch, SCHEMA), at="seen", keep_known=known, run=("load", number))
        new = {}
        for k, *values in batch:  # in the order of ``seen``
            if k is not None:
                new[k] = tuple(v if v is not None or not known else o for v, o in zip(values, new.get(k, (None,) * 3)))
        assert (got["inserted"], got["updated"]) == (len(new.keys() - want.keys()), len(new.keys() & want.keys()))
        assert got["incomplete"] == sum(k is None for k, *_ in batch)
        for k, values in new.items():
            old = want.get(k, (None,) * 3)
            want[k] = tuple(v if v is not None or not known else o for v, o in zip(values, old))
        assert rows(table.read()) == want
        assert table.upsert(spark.createDataFrame(batch, SCHEMA), run=("load", number))["version"] == number + 1  # a replay changes nothing
    assert rows(table.read()) == want
    table.rebucket(3)
    assert rows(table.read()) == want and table.snapshot()["buckets"] == 3


def test_a_small_batch_rewrites_its_buckets_only(spark, table):
    table.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("name")))
    before = table.snapshot()["folders"]
    table.upsert(spark.createDataFrame([(5, "y")], "k long, name string"))
    after = table.snapshot()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert table.read().where("name = 'y'").count() == 1 and table.read().count() == 1000
    assert table.read(version=1).where("name = 'y'").count() == 0


def test_a_write_has_one_shuffle_of_old_rows(spark, table):
    table.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("name")))
    held = table.snapshot()
    new, _ = table._reduced(spark.range(3).select(F.col("id").alias("k"), F.lit("z").alias("name")), table._schema(held, table.read()), 8, None, False, set())
    plan = table._met(held, table.read().schema, 8, new, [0, 1, 2])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_killed_or_late_writer_leaves_the_snapshot(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(1, "a")], "k long, name string"))
    publish = KeyedTable._publish

    def killed(self, manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(KeyedTable, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(spark.createDataFrame([(1, "b")], "k long, name string"))
    assert table.read().collect() == [(1, "a")]

    def overtaken(self, manifest):
        publish(self, manifest | {"folders": {}})
        publish(self, manifest)

    monkeypatch.setattr(KeyedTable, "_publish", overtaken)
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(2, "c")], "k long, name string"))
    monkeypatch.setattr(KeyedTable, "_publish", publish)
    assert table.versions() == [1, 2]
    table.upsert(spark.createDataFrame([(3, "d")], "k long, name string"))
    table.vacuum(keep=1, hours=0)
    assert table.versions() == [3] and table.read().collect() == [(3, "d")]
    assert set(table._names("data")) == set(table.snapshot()["folders"].values())


def test_rebuild_removes_older_stamps_but_no_verdicts(spark, table):
    schema = "k long, score int, at int, confirmed boolean"
    table.upsert(spark.createDataFrame([(1, 10, 1, None), (2, 20, 1, True), (3, 30, 1, False), (4, 40, None, None), (5, 50, 9, None)], schema))
    new = spark.createDataFrame([(1, 11, 2), (3, 31, 2), (6, 60, 2), (None, 0, 2)], "k long, score int, at int")
    got = table.rebuild(new, "at", F.lit(2), verdict="confirmed")
    assert (got["inserted"], got["updated"], got["removed"], got["incomplete"]) == (1, 2, 0, 1)
    want = {(1, 11, 2, None), (2, 20, 1, True), (3, 31, 2, False), (4, 40, None, None), (5, 50, 9, None), (6, 60, 2, None)}
    assert set(map(tuple, table.read().collect())) == want
    got = table.rebuild(new.where("k = 6").withColumn("at", F.lit(3)), "at", F.lit(3))
    assert got["removed"] == 3
    assert set(map(tuple, table.read().collect())) == {(4, 40, None, None), (5, 50, 9, None), (6, 60, 3, None)}


def test_empty_batches_odd_names_new_columns_and_sums(spark, tmp_path):
    odd = KeyedTable(spark, str(tmp_path / "odd"), ["bucket", "a.b"], buckets=4)
    with pytest.raises(FileNotFoundError):
        odd.read()
    schema = "bucket string, `a.b` int, key string, row long, there int, a int, b int"
    odd.upsert(spark.createDataFrame([], schema))
    assert odd.read().count() == 0 and odd.read().columns == ["bucket", "a.b", "key", "row", "there", "a", "b"]
    odd.upsert(spark.createDataFrame([("x", 1, "k", 2, 3, 4, 5), ("x", 1, "k", 5, 3, 4, 5)], schema), sums=["row"])
    odd.upsert(spark.createDataFrame([("x", 1, 10, "new")], "bucket string, `a.b` int, row long, v string"), sums=["row"])
    assert odd.read().collect() == [("x", 1, "k", 17, 3, 4, 5, "new")]
    only = KeyedTable(spark, str(tmp_path / "only"), ["k"], buckets=2)
    only.upsert(spark.createDataFrame([(1,), (1,), (2,)], "k int"))
    assert sorted(only.read().collect()) == [(1,), (2,)]
