"""What an operator costs the driver: jobs, which do not grow with the rows, and no broadcast of tables that do."""

import uuid

import pytest
from pyspark.sql import functions as F

from loadlens.functions import joins, ordered
from loadlens.llm import components, mixing, near_copies, simhash


def jobs(spark, run) -> int:
    """How many jobs Spark runs for ``run``."""
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, "counted")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_mix_counts_sources_once_and_joins_once_a_round(spark):
    rows = [(i, "w " * (i % 9 + 1), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    got = []
    assert jobs(spark, lambda: got.extend(mixing.mix(docs).select("_mix.*").collect())) <= 40
    assert len(got) == 300 and abs(sum(r.taken for r in got) - 1.5 * sum(r["size"] for r in got)) <= 3 * 9


def test_components_compare_labels_without_a_join(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long").coalesce(1)
    got = {}
    assert jobs(spark, lambda: got.update({r.node: r.root for r in components.components(links).collect()})) <= 70
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_postings_of_fingerprints_are_not_broadcast(spark, plan):
    prints = spark.range(2000).selectExpr("xxhash64(id div 2) ^ (id % 2) fp")
    found = simhash.linked_fingerprints(prints)
    assert found.count() >= 1000
    found.collect()
    # Before and after the sizes of shuffles are known: 56,000 postings are few enough for Spark by themselves.
    for shown in (plan(simhash.linked_fingerprints(prints)), plan(found)):
        assert "SortMergeJoin" in shown and "Broadcast" not in shown


def test_near_copies_broadcast_no_texts_and_entries(spark, plan, monkeypatch):
    plans, store = {}, near_copies.stored

    def seen(df, name):
        plans.setdefault(name, []).append(plan(df))
        return store(df, name)

    monkeypatch.setattr(near_copies, "stored", seen)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([f"x{i}" if k == 3 * i else w for k, w in enumerate(words)])) for i in range(9)]
    found = near_copies.groups(spark.createDataFrame([*rows, (9, "other words")], "doc_id long, text string"))
    assert "Broadcast" not in plan(found) and {r.doc_id: r.component_id for r in found.collect()} == {i: i // 9 * 9 for i in range(10)}
    # Texts meet a hash table on their keys, entries and pairs of entries are sorted, and so are the ends of linked fingerprints.
    assert "ShuffledHashJoin" in plans["texts"][0]
    assert len(plans["entries"]) == 2 and not any("Broadcast" in p for p in [*plans["entries"], plans["pairs"][-1]])
    assert plans["pairs"][0].count("SortMergeJoin") >= 3 and "SortMergeJoin" in plans["members"][0]


def test_checked_join_sorts_what_spark_takes_for_small(spark, both_ways, plan, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    rows = spark.range(40).selectExpr("id % 5 k", "id v")
    other = spark.range(6).selectExpr("id k", "id + 1 w")
    got = joins.checked_join(rows, other, ["k"], rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows")), merge=True)
    assert "SortMergeJoin" in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted((i % 5, i, i % 5 + 1) for i in range(40))


@pytest.mark.parametrize(("column", "size"), [("'abc' t", 19), ("struct(id, id b) s", 32), ("struct(id, struct(id b) c) s", 40)])
def test_fields_of_a_struct_count(spark, column, size):
    df = spark.range(1).selectExpr("id", column)
    assert df.select(ordered.row_bytes(df)).first()[0] == size
