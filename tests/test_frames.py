"""Interval joins, range frames, shares and sessions against plain Python, whole and split."""

import random

import pytest
from pyspark.sql import functions as F

from loadlens.operators import frames, intervals


def spans(draw, n, keys="abc"):
    out = []
    for i in range(n):
        start = draw.randrange(-500, 2000)
        out.append((draw.choice(keys), i, start, start + draw.choice([-3, 0, 1, 2, 7, 40, 300, 5000])))
    return out


def plain_overlaps(left, right):
    return sorted(
        (k, i, j, min(e, f) - max(s, t))
        for k, i, s, e in left for m, j, t, f in right
        if k is not None and k == m and s < e and t < f and s < f and t < e
    )


@pytest.mark.parametrize("limit", [None, "20"])
def test_overlaps_against_all_pairs(spark, monkeypatch, limit):
    from loadlens.functions import joins

    draw = random.Random(1)
    left, right = spans(draw, 300) + [(None, 900, 0, 9), ("a", 901, None, 5)], spans(draw, 60) + [(None, 70, 0, 9), ("a", 71, -(1 << 50), 1 << 50)]
    a = spark.createDataFrame(left, "k string, i long, s long, e long")
    b = spark.createDataFrame(right, "k string, j long, t long, f long")
    if limit:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        spark.conf.set("spark.loadlens.groupLimit", limit)
    try:
        got = intervals.overlap_join(a, b, ["k"], ("s", "e"), ("t", "f"))
        assert got.columns == ["k", "i", "s", "e", "j", "t", "f", "overlap"]
        pairs = sorted((r.k, r.i, r.j, r.overlap) for r in got.collect())
    finally:
        spark.conf.unset("spark.loadlens.groupLimit")
    real = [r for r in left if None not in r[1:]]
    assert pairs == plain_overlaps(real, right) and pairs
    assert intervals.overlap_join(a, b.limit(0), ["k"], ("s", "e"), ("t", "f")).count() == 0
    with pytest.raises(ValueError):
        intervals.overlap_join(a, a, ["k"], ("s", "e"), ("s", "e"))


def test_a_long_pause_takes_two_cells(spark, plan):
    """One interval over all of time and many short ones: rows in cells grow with rows, not with time."""
    many = spark.range(20_000).select(F.col("id").alias("i"), (F.col("id") * 1000).alias("s"), (F.col("id") * 1000 + 700).alias("e"))
    one = spark.createDataFrame([(1, 0, 20_000_000)], "j long, t long, f long")
    start, end = F.col("t"), F.col("f")
    placed = one.withColumns({"_start": start, "_last": end - 1, "_level": intervals._level(end - start)})
    assert intervals._in_cells(placed, "b", []).count() <= 2
    short = many.withColumns({"_start": F.col("s"), "_last": F.col("e") - 1, "_level": intervals._level(F.col("e") - F.col("s"))})
    assert intervals._in_cells(short, "a", intervals._levels(placed)).count() <= 4 * 20_000
    met = intervals.overlap_join(many, one, [], ("s", "e"), ("t", "f"))
    assert met.count() == 20_000 and met.agg(F.sum("overlap")).first()[0] == 700 * 20_000
    assert "NestedLoop" not in plan(met) and "Cartesian" not in plan(met)


@pytest.mark.parametrize("after", [0, 5, 60])
def test_band_join(spark, after):
    draw = random.Random(2)
    left = [(draw.choice("ab"), i, draw.randrange(-200, 200)) for i in range(120)] + [(None, 500, 1), ("a", 501, None)]
    right = [(draw.choice("abc"), j, draw.randrange(-200, 260)) for j in range(80)] + [(None, 600, 1), ("a", 601, None)]
    a, b = spark.createDataFrame(left, "k string, i long, s long"), spark.createDataFrame(right, "k string, j long, t long")
    pairs = [(k, i, j) for k, i, s in left for m, j, t in right if k == m and None not in (k, s, t) and s <= t <= s + after]
    inner = intervals.band_join(a, b, ["k"], "s", "t", after)
    assert sorted((r.k, r.i, r.j) for r in inner.collect()) == sorted(pairs)
    found = {i for _, i, _ in pairs}
    want = pairs + [(k, i, None) for k, i, _ in left if i not in found]
    got = intervals.band_join(a, b, ["k"], "s", "t", after, "left")
    assert sorted(((r.k, r.i, r.j) for r in got.collect()), key=str) == sorted(want, key=str)


def test_range_frame(spark, both_ways):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(-50, 300), draw.choice([None, *range(-5, 6)])) for _ in range(150)] + [("a", None, 3)]
    table = spark.createDataFrame(rows, "k string, at long, v long")
    got = {(r.k, r.at): r for r in frames.range_frame(table, ["k"], "at", "v", 30).collect()}
    assert set(got) == {(k, t) for k, t, _ in rows if t is not None}
    for (k, t), r in got.items():
        inside = [v for m, s, v in rows if m == k and s is not None and t - 30 <= s <= t]
        known = [v for v in inside if v is not None]
        assert r.rows == len(inside) and r.total == sum(known)
        assert (r.least, r.most) == ((min(known), max(known)) if known else (None, None))
        assert r.mean == (pytest.approx(sum(known) / len(known)) if known else None)


def test_shares(spark, both_ways):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(6), i) for i in range(70)] + [("one", 1, 900)]
    table = spark.createDataFrame(rows, "k string, v long, i long")
    table.createOrReplaceTempView("shares_in")
    want = spark.sql(
        "select *, rank() over w as rank, percent_rank() over w as percent_rank, cume_dist() over w as cume_dist, "
        "cast(ntile(4) over (partition by k order by v, i) as bigint) as ntile from shares_in window w as (partition by k order by v)"
    )
    got = frames.shares(table, ["k"], ["v"], 4, ["i"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    alone = frames.shares(table.select("v", "i"), [], ["v"], 100, ["i"])
    assert sorted(r.ntile for r in alone.collect()) == list(range(1, 72))


def test_sessions(spark, both_ways):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(1000), i) for i in range(120)] + [("a", None, 999)]
    table = spark.createDataFrame(rows, "k string, at long, i long")
    want = []
    for k in ("a", "b", None):
        times = sorted(t for m, t, _ in rows if m == k and t is not None)
        runs = []
        for t in times:
            if runs and t - runs[-1][-1] < 10:
                runs[-1].append(t)
            else:
                runs.append([t])
        want += [(k, n + 1, r[0], r[-1], len(r)) for n, r in enumerate(runs)]
    got = [tuple(r) for r in frames.sessions(table, ["k"], "at", 10, "i").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
