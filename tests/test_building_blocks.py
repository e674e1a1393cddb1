"""Ordered scans, percentiles, joins and lineage against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.functions import joins, lineage
from loadlens.functions.ordered import running
from loadlens.functions.quantiles import quantiles


def skewed_rows(n=400, seed=7):
    """A third of the rows have one key; some keys and values are NULL."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else pick.choice(["a", "b", "c", None])
        rows.append((key, pick.randrange(50), i, pick.choice([None, 1, 2, 3, 4, 5])))
    return rows


def brute_running(rows, before):
    out = {}
    for key in {r[0] for r in rows}:
        total, top, last = 0, None, None
        for _, at, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if before:
                out[i] = (total, top, last)
            if v is not None:
                total, top, last = total + v, v if top is None else max(top, v), v
            if not before:
                out[i] = (total, top, last)
    return out


@pytest.mark.parametrize("before", [False, True])
def test_running_equals_brute_force(spark, both_ways, before):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "key string, at int, id int, v int")
    v = F.col("v")
    got = running(
        df, ["key"], ["at", "id"], sums={"s": v}, maxes={"m": v}, lasts={"l": v}, before=before
    )
    assert got.columns == ["key", "at", "id", "v", "s", "m", "l"]
    assert {r.id: (r.s, r.m, r.l) for r in got.collect()} == brute_running(rows, before)


def test_running_in_falling_order(spark, both_ways):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    got = running(df, ["k"], [F.col("id").desc()], sums={"n": F.lit(1)})
    assert {r.id: r.n for r in got.collect()} == {i: (99 - i) // 2 + 1 for i in range(100)}


def test_running_without_keys_and_without_rows(spark, both_ways):
    df = spark.range(50)
    got = running(df, [], ["id"], sums={"s": F.col("id")}).collect()
    assert {r.id: r.s for r in got} == {i: i * (i + 1) // 2 for i in range(50)}
    assert running(df.where("id < 0"), [], ["id"], sums={"s": F.col("id")}).count() == 0
    assert running(df.where("id < 0"), ["id"], ["id"], sums={"s": F.col("id")}).count() == 0


def test_a_split_group_is_in_many_slices(spark):
    spark.conf.set("spark.loadlens.groupLimit", "10")
    df = spark.range(1000).select(F.lit("hot").alias("k"), "id")
    got = running(df, ["k"], ["id"], sums={"n": F.lit(1)})
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.loadlens.groupLimit")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 1000


def test_quantiles_equal_numpy(spark, both_ways):
    rows = skewed_rows()
    df = spark.createDataFrame([(r[0], r[3]) for r in rows], "key string, v int")
    wanted = {"low": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "top": 1.0}
    got = {r.key: r for r in quantiles(df, ["key"], "v", wanted).collect()}
    for key in {r[0] for r in rows}:
        values = [r[3] for r in rows if r[0] == key and r[3] is not None]
        assert got[key].n == len(values)
        for name, p in wanted.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_quantiles_of_all_rows(spark, both_ways):
    got = quantiles(spark.range(101), [], "id", {"p90": 0.9}).collect()
    assert [(r.n, r.p90) for r in got] == [(101, 90.0)]


def test_approximate_quantiles_use_the_sketch(spark, plan):
    df = quantiles(spark.range(1001), [], "id", {"p50": 0.5}, exact=False)
    assert "percentile_approx" in plan(df)
    assert df.first().p50 == 500


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_plain_join(spark, both_ways, how):
    rows = spark.createDataFrame(
        [("hot" if i % 3 == 0 else f"k{i % 7}", i) for i in range(90)] + [(None, 90)] * 5,
        "k string, i int",
    )
    other = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("none", 5), (None, 6)], "k string, v int"
    )
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    want = sorted(rows.join(other, "k", how).collect(), key=str)
    got = joins.split_join(rows, other, ["k"], sizes, how)
    assert got.columns == ["k", "i", "v"]
    assert sorted(got.collect(), key=str) == want


def test_checked_join_broadcasts_only_few_rows(spark, plan, monkeypatch):
    rows = spark.range(100).withColumnRenamed("id", "k")
    other = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    few = joins.checked_join(rows, other, ["k"], sizes)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 100)
    many = joins.checked_join(rows, other, ["k"], sizes)
    assert "BroadcastHashJoin" in plan(few) and "BroadcastHashJoin" not in plan(many)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few.count() == many.count() == 10


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert lineage.checkpoint_root(spark) == named
    a, b = lineage.scratch_folder(spark, "x"), lineage.scratch_folder(spark, "x")
    assert a != b and a.startswith(named)


def test_a_cluster_without_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.checkpoint_root(Session())
