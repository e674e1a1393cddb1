"""Keyed records: reads, replay, final state."""

import random

import pytest

from loadlens.operators import records

OPS = "seq long, ts long, key string, op string, value double"


def random_ops(n=300, seed=3):
    pick = random.Random(seed)
    return [
        (
            i,
            pick.randrange(100),
            "hot" if i % 3 == 0 else f"k{pick.randrange(8)}",
            pick.choice(["READ", "UPDATE", "INSERT"]),
            pick.choice([None, float(i)]),
        )
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(
        [("hot", -1.0), ("k1", -2.0), ("never", -3.0), ("k2", None)], "key string, value double"
    )


def test_reads_and_final_state_equal_a_replay(spark, both_ways, base):
    ops = random_ops()
    state = {"hot": -1.0, "k1": -2.0, "never": -3.0, "k2": None}
    loaded = set(state)
    origin, reads = {k: "LOAD" for k in state}, {}
    for seq, _, key, op, value in sorted(ops, key=lambda o: (o[1], o[0])):
        if op == "READ":
            reads[seq] = (state.get(key), origin.get(key, "NOT_FOUND"))
        else:
            state[key], origin[key] = value, "WRITE"
    log = spark.createDataFrame(ops, OPS)
    got = records.reads_as_of(log, base).collect()
    assert {r.seq: (r.value, r.origin) for r in got} == reads and len(got) == len(reads)
    final = records.final_state(log, base).collect()
    assert {r.key: r.value for r in final} == state and len(final) == len(state)
    assert {r.key for r in final if r.writes == 0} <= loaded


def test_point_reads(spark, base):
    keys = spark.createDataFrame([("k1",), ("k1",), ("k2",), ("gone",)], "key string")
    got = sorted((tuple(r) for r in records.point_reads(keys, base).collect()), key=str)
    assert got == [
        ("gone", None, "NOT_FOUND"),
        ("k1", -2.0, "OK"),
        ("k1", -2.0, "OK"),
        ("k2", None, "OK"),
    ]


def test_loaded_records_are_the_same_every_time(spark):
    load = lambda: records.load_records(spark.range(50), "id").orderBy("key").collect()
    rows = load()
    assert rows == load() and len({r.field0 for r in rows}) == 50
    assert len(rows[0]) == 11 and all(len(r[f"field{i}"]) == 100 for r in rows for i in range(10))


def test_popularity_and_mix(spark, both_ways):
    ops = spark.createDataFrame(
        [("a", "READ")] * 5 + [("b", "READ")] * 3 + [("c", "UPDATE")] * 2, "key string, op string"
    )
    got = [tuple(r) for r in records.key_popularity(ops).orderBy("rank").collect()]
    assert got == [("a", 5, 1, 0.5), ("b", 3, 2, 0.8), ("c", 2, 3, 1.0)]
    assert {r.op: r.share for r in records.op_mix(ops).collect()} == {"READ": 0.8, "UPDATE": 0.2}


def test_new_keys(spark):
    wanted = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "a int, b int")
    present = spark.createDataFrame([(1, 2)], "a int, b int")
    got = records.new_keys(wanted, present, ["a", "b"]).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1)]


def test_replay_shuffles_the_log_once(spark, plan, base):
    log = spark.createDataFrame(random_ops(), OPS)
    text = plan(records.reads_as_of(log, base))
    assert text.count("Window [") + text.count("Window(") == 1
    assert "Python" not in text and "CartesianProduct" not in text
