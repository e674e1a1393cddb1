"""Streams: results over several micro-batches equal the batch reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadlens.operators import latency, records
from loadlens.streaming import replay, reports

SCHEMA = (
    "seq long, ts timestamp, start_us long, dur_us long, label string, success boolean, "
    "bytes long, key string, op string, value double, node string, line string"
)


def row(i):
    ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * i)
    return (
        i, ts, i * 37_000_000, 1000 + i, f"l{i % 3}", i % 5 != 0, i, "hot" if i % 3 == 0 else f"k{i % 7}",
        ("READ", "UPDATE", "INSERT")[i % 3 if i % 2 else 1], float(i), f"n{i % 4}",
        "server ready" if i % 9 == 0 else "working",
    )


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Five files, so that five micro-batches change the same groups."""
    path = str(tmp_path_factory.mktemp("log") / "log")
    for part in range(5):
        rows = [row(i) for i in range(200) if i % 5 == (part * 2) % 5]
        df = spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture
def stream(spark, folder):
    return replay.replay_stream(spark, folder, SCHEMA, files_per_trigger=1)


@pytest.fixture
def batch(spark, folder):
    return spark.read.schema(SCHEMA).parquet(folder)


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    rows = lambda df: sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect()),
        key=str,
    )
    got = rows(left)
    assert got == rows(right) and got


def test_counts(stream, batch):
    same(
        replay.run_to_table(reports.stream_counts(stream, "ts", "10 minutes"), ["window_start"]),
        reports.stream_counts(batch, "ts", "10 minutes"),
    )


def test_throughput(stream, batch):
    same(
        replay.run_to_table(reports.stream_throughput(stream, "ts", "line", "10 minutes"), ["window_start"]),
        reports.stream_throughput(batch, "ts", "line", "10 minutes"),
    )


def test_summary_equals_the_batch_summary(stream, batch):
    same(
        replay.run_to_table(reports.stream_summary(stream), ["label"]),
        latency.latency_summary(batch).where("label <> 'TOTAL'"),
    )


def test_record_state_equals_the_final_state(spark, stream, batch):
    base = spark.createDataFrame([("k1", -1.0), ("never", -2.0)], "key string, value double")
    written = replay.run_to_table(reports.stream_kv_state(stream), ["key"])
    same(records.apply_writes(written, base), records.final_state(batch, base))


def test_ready_times(stream, batch):
    same(
        replay.run_to_table(reports.stream_ready(stream, "ready$"), ["node"]),
        reports.stream_ready(batch, "ready$"),
    )


def test_union(spark, folder, batch):
    streams = [replay.replay_stream(spark, folder, SCHEMA).where(F.col("seq") % 2 == i) for i in (0, 1)]
    counts = reports.stream_counts(replay.union_streams(*streams), "ts", "1 hour")
    same(replay.run_to_table(counts, ["window_start"]), reports.stream_counts(batch, "ts", "1 hour"))


def test_a_run_goes_on_where_it_stopped(spark, folder, tmp_path, batch):
    """A second run of the same folder adds only files that came later."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    batch.where("seq < 100").write.parquet(str(source))
    counts = lambda: reports.stream_counts(replay.replay_stream(spark, str(source), SCHEMA), "ts", "1 hour")
    replay.run_to_table(counts(), ["window_start"], out)
    batch.where("seq >= 100").write.mode("append").parquet(str(source))
    same(
        replay.run_to_table(counts(), ["window_start"], out),
        reports.stream_counts(batch, "ts", "1 hour"),
    )


def test_append_mode_holds_back_open_windows(spark, batch, tmp_path):
    source = str(tmp_path / "in")
    batch.write.parquet(source)
    stream = replay.replay_stream(spark, source, SCHEMA)
    counts = reports.stream_counts(stream, "ts", "10 minutes", delay="10 minutes")
    done = replay.run_to_table(counts, ["window_start"], str(tmp_path / "out"), mode="append")
    newest = batch.agg(F.max("ts")).first()[0]
    closed = newest - dt.timedelta(minutes=20)  # window end at or before newest - delay
    same(done, reports.stream_counts(batch, "ts", "10 minutes").where(F.col("window_start") <= F.lit(closed)))


def test_hook_sees_every_batch(stream, tmp_path):
    seen = []
    query = replay.with_hook(stream, lambda rows, i: seen.append((i, rows.count())), str(tmp_path / "c"))
    query.awaitTermination()
    assert [i for i, _ in seen] == list(range(len(seen))) and len(seen) >= 5
    assert sum(n for _, n in seen) == 200


def test_one_file_can_be_replayed(spark, folder, tmp_path):
    import pathlib

    file = next(pathlib.Path(folder).glob("*.parquet"))
    counts = reports.stream_counts(replay.replay_stream(spark, str(file), SCHEMA), "ts", "1 day")
    assert replay.run_to_table(counts, ["window_start"]).first().records > 0


def numbered(rows, path, spark, schema):
    """One file a row set, each later than the one before."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    replay.in_order(spark, path)
    return path


def test_files_stay_bounded_and_a_crash_changes_nothing(spark, tmp_path):
    import pathlib

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(2000).selectExpr("id % 7 as k", "id as v").repartition(50).write.parquet(source)
    report = lambda: replay.replay_stream(spark, source, "k long, v long", files_per_trigger=1).groupBy("k").agg(F.count("v").alias("n"), F.max("v").alias("top"))
    want = spark.read.parquet(source).groupBy("k").agg(F.count("v").alias("n"), F.max("v").alias("top"))
    schema = want.schema
    combine = replay.newest(schema, ["k"])
    broken = {9: "before", 29: "after"}

    def store(rows, batch):
        # Ends once before and once after a base has been written, before the stream has noted the batch.
        if broken.get(batch) == "before":
            rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
            broken.pop(batch)
            raise RuntimeError("lost")
        replay.store_batch(rows, batch, out, schema, combine, 10)
        if broken.get(batch) == "after":
            broken.pop(batch)
            raise RuntimeError("lost")

    for _ in range(3):
        query = replay.with_hook(report(), store, f"{out}/progress", "update")
        try:
            query.awaitTermination()
        except Exception as error:  # noqa: BLE001
            assert "lost" in str(error)
    assert not broken
    same(replay.last_state(spark, out, schema, ["k"]), want)
    batches = [p for p in pathlib.Path(out, "rows").iterdir() if p.name.startswith("batch=")]
    bases = [p for p in pathlib.Path(out, "base").iterdir() if p.name.startswith("upto=")]
    assert len(batches) <= 20 and 1 <= len(bases) <= 2
    # A base without its marker is as if it were not there.
    newest = max(bases, key=lambda p: int(p.name.split("=")[1]))
    (newest / "_SUCCESS").rename(newest / "_lost")
    same(replay.last_state(spark, out, schema, ["k"]), want)


def test_late_rows_and_counts_add_up(spark, tmp_path):
    from loadlens.streaming import late

    start = dt.datetime(2024, 1, 1)
    at = lambda i, minute: (i, start + dt.timedelta(minutes=minute))
    parts = [[at(1, 0), at(2, 5), at(3, 70)], [at(4, 8), at(5, 65), (6, None)], [at(7, 300)], [at(8, 290), at(9, 30), at(10, 310)]]
    source, out = numbered(parts, str(tmp_path / "in"), spark, "i long, ts timestamp"), str(tmp_path / "out")
    feed = replay.replay_stream(spark, source, "i long, ts timestamp", files_per_trigger=1)
    late.count_with_late(feed, "ts", 600, 1800, out, merge_every=2)
    rows = late.late_rows(spark, out, "i long, ts timestamp")
    # After the first file the mark is at minute 40, after the third at 270.
    assert sorted(r.i for r in rows.collect()) == [4, 6, 9]
    closed, opened = late.closed_counts(spark, out, 600), late.closed_counts(spark, out, 600, closed=False)
    minute = lambda r: int((r.window_start - start).total_seconds() // 60)
    assert {minute(r): r.records for r in closed.collect()} == {0: 2, 60: 1, 70: 1}
    assert {minute(r): r.records for r in opened.collect()} == {290: 1, 300: 1, 310: 1}
    again = replay.replay_stream(spark, source, "i long, ts timestamp", files_per_trigger=1)
    late.count_with_late(again, "ts", 600, 1800, out, merge_every=2)
    assert late.late_rows(spark, out, "i long, ts timestamp").count() == 3


def test_stream_join_gives_out_rows_without_a_partner_late(spark, tmp_path):
    from loadlens.operators import intervals

    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"u{i % 3}", start + dt.timedelta(minutes=7 * i), "view" if i % 4 else "buy") for i in range(60)]
    clock = [(None, "clock", start + dt.timedelta(days=9), w) for w in ("view", "buy")]
    source = numbered([rows[k : k + 12] for k in range(0, 60, 12)] + [clock], str(tmp_path / "in"), spark, "i long, u string, ts timestamp, what string")
    feed = lambda: replay.replay_stream(spark, source, "i long, u string, ts timestamp, what string", files_per_trigger=1)
    views = feed().where("what = 'view'").selectExpr("u", "i", "ts")
    bought = feed().where("what = 'buy'").selectExpr("u", "i as j", "ts as at")
    pairs = reports.stream_band_join(views, bought, "u", "ts", "at", "20 minutes", "1 minute").select("u", "i", "j")
    batches = []
    replay.with_hook(pairs, lambda rows, n: batches.append(rows.collect()), str(tmp_path / "c")).awaitTermination()
    got = sorted((r.i, r.j or -1) for b in batches for r in b if r.u != "clock")
    stored = spark.createDataFrame(rows, "i long, u string, ts timestamp, what string").withColumn("us", F.unix_micros("ts"))
    a = stored.where("what = 'view'").select("u", "i", "us")
    b = stored.where("what = 'buy'").selectExpr("u", "i as j", "us as at")
    want = intervals.band_join(a, b, ["u"], "us", "at", 20 * 60_000_000, "left")
    assert got == sorted((r.i, r.j or -1) for r in want.collect())
    assert sum(1 for b in batches if any(r.j is None and r.u != "clock" for r in b)) > 1


def test_nodes_are_reported_once_when_their_time_is_over(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda node, minute, line="working": (node, start + dt.timedelta(minutes=minute), line)
    parts = [
        [at("a", 0), at("b", 1), at("c", 2)], [at("a", 5, "server ready"), at("d", 6)], [at("c", 30, "server ready"), at("b", 31)],
        [at("d", 60, "server ready"), at("e", 61, "server ready")], [at("clock", 9000)],
    ]
    source = numbered(parts, str(tmp_path / "in"), spark, "node string, ts timestamp, line string")
    feed = replay.replay_stream(spark, source, "node string, ts timestamp, line string", files_per_trigger=1)
    seen = []
    replay.with_hook(reports.stream_not_ready(feed, "ready$", 600, "1 second"), lambda rows, n: seen.extend(rows.collect()), str(tmp_path / "c")).awaitTermination()
    minute = lambda r: (r.deadline - start).total_seconds() / 60
    assert sorted((r.node, minute(r)) for r in seen) == [("b", 11), ("c", 12), ("d", 16)]


def test_sessions_of_a_stream(spark, tmp_path):
    from loadlens.operators import frames

    start = dt.datetime(2024, 1, 1)
    rows = [(f"u{i * i % 5}", start + dt.timedelta(seconds=50 * i + i % 7), i) for i in range(120)]
    clock = [("clock", start + dt.timedelta(days=9), -1)]
    parts = [rows[k : k + 30] for k in range(0, 120, 30)]
    source = numbered([*parts, clock], str(tmp_path / "in"), spark, "key string, ts timestamp, seq long")
    feed = replay.replay_stream(spark, source, "key string, ts timestamp, seq long", files_per_trigger=1)
    found = replay.run_to_table(reports.stream_sessions(feed, "key", "ts", "2 minutes", "1 minute"), ["key", "first"], mode="append")
    batch = spark.createDataFrame(rows, "key string, ts timestamp, seq long").withColumn("us", F.unix_micros("ts"))
    want = frames.sessions(batch, ["key"], "us", 120_000_000, "seq").select("key", "first", "last", "rows")
    got = found.select("key", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "rows")
    same(got, want)


def test_empty_tables(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    counts = reports.stream_counts(replay.replay_stream(spark, source, SCHEMA), "ts", "1 hour")
    assert replay.run_to_table(counts, ["window_start"]).count() == 0
