"""Point reads from a large record table; sketches that are merged."""

import random

import pytest
from pyspark.sql import functions as F

from loadlens.functions import sketches
from loadlens.sources import lookup


def rows_scanned(df):
    """Rows that the scans of a DataFrame gave out when it ran, and files they opened."""
    df.collect()
    todo, rows, files = [df._jdf.queryExecution().executedPlan()], 0, 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            metrics = node.metrics()
            rows += metrics.apply("numOutputRows").value()
            files += metrics.apply("numFiles").value()
    return rows, files


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_few_rows_are_read_for_few_keys(spark, tmp_path, n):
    """What a batch of keys reads does not grow with the table."""
    table = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("key"), F.col("id").alias("value"), F.repeat(F.lit("x"), 50).alias("pad"))
    path = str(tmp_path / "t")
    lookup.store_records(table, path, "key", rows_per_file=5_000, group_bytes=1 << 16)
    asked = spark.range(0, n, n // 40).select(F.md5(F.col("id").cast("string")).alias("key"))
    got = lookup.read_records(spark, path, asked.union(asked).union(spark.createDataFrame([("none",), (None,)], "key string")), "key")
    rows, files = rows_scanned(got)
    assert got.count() == 40 and files <= 40
    assert rows <= 40 * 1500
    absent = spark.range(n, n + 30).select(F.md5(F.col("id").cast("string")).alias("key"))
    nothing = lookup.read_records(spark, path, absent, "key")
    assert rows_scanned(nothing)[0] <= 3000 and nothing.count() == 0


def test_lookup_edges(spark, tmp_path):
    table = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", None)], "key string, value long")
    path = str(tmp_path / "t")
    lookup.store_records(table, path, "key")
    read = lambda *keys: sorted(map(str, lookup.read_records(spark, path, spark.createDataFrame([(k,) for k in keys], "key string"), "key").collect()))
    assert len(read("a", "zz")) == 2 and len(read("b", None)) == 1 and read("c") == [] and read(None) == []
    assert len(read(*[f"k{i}" for i in range(lookup.LITERALS + 5)], "a")) == 2
    empty = str(tmp_path / "e")
    lookup.store_records(table.limit(0), empty, "key")
    assert lookup.read_records(spark, empty, table, "key").count() == 0


def test_merged_sketches_are_as_near_as_one(spark):
    draw = random.Random(7)
    rows = [(g, i % 50, None if i % 97 == 0 else draw.lognormvariate(0, 2)) for g in "ab" for i in range(20_000)] + [("c", 0, 1.0)]
    table = spark.createDataFrame(rows, "g string, part int, v double")
    wanted = {"p01": 0.01, "p50": 0.5, "p999": 0.999}
    for by in (["g", "part"], ["g"]):
        kept = sketches.store_sketches(table, by, "v")
        merged = sketches.merged_quantiles(kept, ["g"], wanted)
        errors = sketches.rank_error(table, merged, ["g"], "v", wanted).collect()
        assert {r.g: r.n for r in errors} == {"a": 20_000 - 207, "b": 20_000 - 207, "c": 1}
        assert max(r[c] for r in errors for c in wanted) < 0.02
    assert sketches.merged_quantiles(sketches.store_sketches(table.limit(0), ["g"], "v"), ["g"], wanted).count() == 0
