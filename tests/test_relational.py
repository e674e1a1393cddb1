"""Joins, groups, set operations and hooks."""

import pytest
from pyspark.sql import functions as F

from loadlens.operators import hooks, relational


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_not_ready(spark):
    nodes = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "node string")
    logs = spark.createDataFrame(
        [("n1", "starting"), ("n1", "I have been elected leader"), ("n2", "starting")],
        "node string, line string",
    )
    got = relational.not_ready(nodes, logs, "elected leader|Successfully registered")
    assert pairs(got) == [("n2",), ("n3",)]


def test_allow_list_does_not_multiply_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    allowed = spark.createDataFrame([(1,), (1,)], "k int")
    assert pairs(relational.in_allocation(rows, allowed, "k")) == [(1, "a"), (1, "b")]


def test_enrich_keeps_rows_without_entry(spark):
    rows = spark.createDataFrame([(1,), (9,)], "k int")
    names = spark.createDataFrame([(1, "one")], "k int, name string")
    assert pairs(relational.enrich(rows, names, "k", "unknown")) == [(1, "one"), (9, "unknown")]
    assert {r.name for r in relational.enrich(rows, names, "k").collect()} == {"one", None}


@pytest.mark.parametrize("k", [2, 5000])
def test_top_k_with_ties(spark, both_ways, k):
    rows = spark.createDataFrame(
        [("g", 5, 2), ("g", 5, 1), ("g", 7, 3), ("h", 1, 4)], "g string, v int, id int"
    )
    got = relational.top_k(rows, ["g"], [F.col("v").desc(), F.col("id")], k)
    want = [("g", 3, 1), ("g", 1, 2), ("g", 2, 3), ("h", 4, 1)]
    got = sorted((r.g, r.id, r.place) for r in got.collect())
    assert got == sorted(w for w in want if w[2] <= k)


def test_top_k_limits_groups_before_the_shuffle(spark, plan):
    rows = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    text = plan(relational.top_k(rows, ["g"], ["id"], 3))
    assert "WindowGroupLimit" in text and text.rindex("WindowGroupLimit") > text.index("Exchange")


def test_group_members_in_parts(spark, both_ways):
    df = spark.createDataFrame(
        [("zk", f"f{i:02d}") for i in range(7)] + [("web", "f01"), ("web", "f01")],
        "role string, host string",
    )
    got = {(r.role, r.part): r.members for r in relational.group_members(df, "role", "host", 3).collect()}
    assert got == {
        ("zk", 0): ["f00", "f01", "f02"],
        ("zk", 1): ["f03", "f04", "f05"],
        ("zk", 2): ["f06"],
        ("web", 0): ["f01"],
    }


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert pairs(relational.missing(a, b)) == [(2,)]
    assert pairs(relational.missing(a, b, keep_duplicates=True)) == [(1,), (2,)]
    assert pairs(relational.distinct_keys(a, "k")) == [(1,), (2,), (3,)]
    assert relational.all_roles(a, b, a).count() == 10


def test_batch_hook(spark):
    df = spark.range(3)
    assert hooks.apply_hook(df, None) is df
    assert pairs(hooks.apply_hook(df, lambda d, n: d.where(F.col("id") < n), 2)) == [(0,), (1,)]
