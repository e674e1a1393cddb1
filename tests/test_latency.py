"""Reports on request logs, on hand-written logs."""

import pytest
from pyspark.sql import functions as F

from loadlens.operators import latency

LOG = "seq long, start_us long, dur_us long, label string, flow long, success boolean, bytes long"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


@pytest.fixture
def small(spark):
    return log(
        spark,
        [
            (1, 0, 2000, "get", 1, True, 100),
            (2, 500_000, 4000, "get", 1, False, 300),
            (3, 1_000_000, 6000, "put", 2, True, 200),
        ],
    )


def test_latency_summary(spark, small):
    rows = {r.label: r for r in latency.latency_summary(small).collect()}
    assert set(rows) == {"get", "put", "TOTAL"}
    assert (rows["get"].samples, rows["get"].avg_ms, rows["get"].error_pct) == (2, 3.0, 50.0)
    assert (rows["get"].min_ms, rows["get"].max_ms, rows["get"].stddev_ms) == (2.0, 4.0, 1.0)
    assert rows["TOTAL"].samples == 3 and rows["TOTAL"].avg_bytes == 200.0
    assert rows["TOTAL"].throughput_per_s == pytest.approx(3 / 1.006)
    assert rows["get"].throughput_per_s == pytest.approx(2 / 0.504)


def test_a_null_label_is_not_the_total(spark):
    rows = latency.latency_summary(log(spark, [(1, 0, 10, None, 1, True, 1)])).collect()
    assert sorted(str(r.label) for r in rows) == ["None", "TOTAL"]


def test_empty_log(spark):
    empty = log(spark, [])
    assert latency.latency_timeseries(
        empty.withColumn("op", F.lit("READ")), 100
    ).count() == 0
    assert latency.percentile_table(empty, "dur_us", ["label"]).count() == 0
    assert latency.concurrency_profile(empty).count() == 0


def test_percentile_table(spark, both_ways):
    rows = [(i, i, i, "x", 1, True, 1) for i in range(1, 1002)]
    got = latency.percentile_table(log(spark, rows), "dur_us", ["label"]).collect()
    values = {r.stat: r.value for r in got}
    assert [r.stat for r in got][0] == "MAX" and len(got) == 11
    assert (values["MAX"], values["50.00"], values["25.00"], values["MIN"]) == (1001, 501, 251, 1)
    assert values["99.90"] == pytest.approx(1000.0)
    assert {r.per_percentile for r in got} == {10.01}


def test_valid_window_leaves_out_both_ends(spark):
    rows = [(i, i * 100_000, 1000 * (i + 1), "x", 1, i != 5, 1) for i in range(11)]
    got = {r.phase: r for r in latency.valid_window(log(spark, rows), 200_000, 300_000).collect()}
    assert (got["total"].sent, got["total"].received, got["total"].run_s) == (11, 10, 1.0)
    assert (got["valid"].sent, got["valid"].received, got["valid"].run_s) == (6, 5, 0.5)
    assert got["valid"].avg_ms == pytest.approx(sum(range(3, 9)) / 6)


def test_message_quality(spark, both_ways):
    arrivals = spark.createDataFrame(
        [("a", t, s) for t, s in enumerate([1, 2, 2, 5, 4, 9])]
        + [("b", t, s) for t, s in enumerate([7, 7, 7])],
        "flow string, at int, seq long",
    )
    got = {
        r.flow: (r.messages, r.dropped, r.duplicated, r.out_of_order)
        for r in latency.message_quality(arrivals, ["flow"], ["at"], "seq").collect()
    }
    assert got == {"a": (6, 4, 1, 1), "b": (3, 0, 2, 0)}


def test_sum_row_equals_the_streams(spark, small):
    rows = latency.stream_bandwidth(small, F.col("flow")).collect()
    total = next(r for r in rows if r.stream == "SUM")
    parts = [r for r in rows if r.stream != "SUM"]
    assert total.bytes == sum(r.bytes for r in parts) == 600
    assert total.bits_per_s == pytest.approx(sum(r.bits_per_s for r in parts))


def test_peak_takes_the_smallest_size_on_a_tie(spark):
    sweep = spark.createDataFrame([(8, 5.0), (4, 5.0), (2, 1.0)], "size long, mib_per_s double")
    assert tuple(latency.peak_rate(sweep).first()) == (5.0, pytest.approx(11 / 3), 4)


def test_concurrency(spark, both_ways):
    rows = [
        (1, 0, 10, "x", 1, True, 1),
        (2, 5, 10, "x", 1, True, 1),
        (3, 10, 10, "x", 1, True, 1),  # starts as the first ends
        (4, 14, 2, "x", 1, True, 1),
        (5, 0, 1, "y", 1, True, 1),
        (6, 3, 0, "y", 1, True, 1),  # takes no time
    ]
    got = {r.label: r for r in latency.concurrency_profile(log(spark, rows)).collect()}
    assert got["x"].peak == 3 and got["x"].mean_in_flight == pytest.approx(32 / 20)
    assert got["y"].peak == 1 and got["y"].requests == 2


def test_fanout(spark, both_ways):
    leaves = spark.createDataFrame(
        [(1, 1, 5.0), (1, 2, 9.0), (2, 1, 3.0), (2, 2, 4.0), (3, 1, 7.0)],
        "request long, leaf long, t double",
    )
    got = {r.fanout: r for r in latency.fanout_latency(leaves).collect()}
    assert (got[2].requests, got[2].mean_request) == (2, 6.5)
    assert got[2].p99_request == pytest.approx(4 + 5 * 0.99)
    assert got[2].p99_leaf == pytest.approx(5 + 4 * 0.97)
    assert (got[1].requests, got[1].p99_request, got[1].p99_leaf) == (1, 7.0, 7.0)


def test_modes_side_by_side(spark, small):
    mode = F.when(F.col("success"), "ok").otherwise("error")
    got = {r.metric: r for r in latency.compare_modes(small, mode, "ok", "error").collect()}
    assert (got["avg_ms"].ok, got["avg_ms"].error, got["avg_ms"].ratio) == (4.0, 4.0, 1.0)
    assert (got["samples"].ok, got["samples"].error) == (2.0, 1.0)


def test_offered_rate():
    assert latency.offered_rate(400) == 24_000
    assert latency.offered_rate(400, minutes=3, users=100) == 720


def test_gc_pauses(spark):
    lines = spark.createDataFrame(
        [
            ("n1", "0.5: [GC [PSYoungGen: 5K->0K(7K)] 5K->0K(9K), 0.0100000 secs]"),
            ("n1", "0.9: [Full GC [PSYoungGen: 5K->0K(7K)] 5K->0K(9K), 0.2500000 secs] "),
            ("n2", "no pause here, 0.5 secs"),
        ],
        "node string, line string",
    )
    pattern = r"\[(?:Full )?GC .*, ([0-9]+\.[0-9]+) secs\]"
    assert [tuple(r) for r in latency.gc_pauses(lines, pattern).collect()] == [("n1", 2, 0.26, 0.25)]


def test_progress(spark, both_ways):
    ops = spark.createDataFrame([(t * 400_000,) for t in range(10)], "start_us long")
    got = sorted(tuple(r) for r in latency.progress_report(ops, 1000).collect())
    assert got == [(0, 3, 3, 3.0), (1000, 2, 5, 2.0), (2000, 3, 8, 3.0), (3000, 2, 10, 2.0)]
