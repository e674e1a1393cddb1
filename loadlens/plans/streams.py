"""Streaming queries: the event file replayed as a stream into a result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens.functions import sketches
from loadlens.functions.lineage import cut, scratch_folder
from loadlens.operators import records
from loadlens.plans.latency import NEAR_RANKS, WANTED, near_ranks
from loadlens.plans.registry import query, rounded
from loadlens.plans.relational import READY, ready_lines
from loadlens.plans.views import kv_base, kv_ops_from, requests, requests_from, table, with_views
from loadlens.plans.records import FINAL_STATE
from loadlens.streaming import late, replay, reports

HOUR = "1 hour"
STAMP = "yyyy-MM-dd HH:mm:ss"


# The events cover 30 days, so with this delay no row is late whatever order files come in.
DELAY = "31 days"
# Feeds in order of time need little.
SHORT = "1 hour"
SLICES = 3
# User of the row that only moves the clock; no event has it.
CLOCK = -1


def _event_files(spark: SparkSession, sf_dir: str, closing: bool = False) -> str:
    """The events as several files, one for each part of their time, oldest first.

    ``closing`` adds a last file with one row, of user CLOCK, long after the others: it
    moves the watermark past everything, as the clock of a stream that goes on would.
    """
    events, folder = table(spark, sf_dir, "events"), scratch_folder(spark, "events")
    ranged = events.repartitionByRange(SLICES, "ts").sortWithinPartitions("ts", "event_id")
    ranged.write.parquet(folder)
    if closing:
        clock = events.agg(F.max("ts").alias("ts")).where("ts is not null")
        row = {"ts": F.col("ts") + F.expr("INTERVAL 60 DAYS"), "event_type": F.lit("clock"), "user_id": F.lit(CLOCK)}
        columns = [row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
        clock.select(*columns).coalesce(1).write.mode("append").parquet(folder)
    replay.in_order(spark, folder)
    return folder


def _events(spark: SparkSession, sf_dir: str, closing: bool = False) -> DataFrame:
    """The events as a stream of one file a micro-batch."""
    schema = table(spark, sf_dir, "events").schema
    return replay.replay_stream(spark, _event_files(spark, sf_dir, closing), schema, files_per_trigger=1)


def _requests(spark: SparkSession, sf_dir: str, closing: bool = False) -> DataFrame:
    return requests_from(_events(spark, sf_dir, closing))


def _stamped(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.date_format(column, STAMP))


COUNTS = """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
           count(*) AS records
    FROM events GROUP BY ALL"""


@query("stream_counts", COUNTS)
def stream_counts(spark, sf_dir):
    counts = reports.stream_counts(_requests(spark, sf_dir), "ts", HOUR, DELAY)
    return _stamped(replay.run_to_table(counts, ["window_start"]), "window_start")


@query("stream_union", COUNTS)
def stream_union(spark, sf_dir):
    log = _requests(spark, sf_dir)
    even = F.col("flow") % 2 == 0
    both = replay.union_streams(log.where(even), _requests(spark, sf_dir).where(~even))
    counts = reports.stream_counts(both, "ts", HOUR, DELAY)
    return _stamped(replay.run_to_table(counts, ["window_start"]), "window_start")


@query(
    "stream_throughput",
    """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
           count(*) AS records, round(count(*) / 3600, 6) AS records_per_s,
           round(sum(strlen(line)) / 3600, 6) AS bytes_per_s,
           round(sum(strlen(line)) / count(*), 6) AS mean_size
    FROM (SELECT ts, event_type || ' ' || props AS line FROM events) GROUP BY ALL""",
)
def stream_throughput(spark, sf_dir):
    lines = _events(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws(" ", "event_type", "props").alias("line"),
    )
    rates = reports.stream_throughput(lines, "ts", "line", HOUR, DELAY)
    return _stamped(rounded(replay.run_to_table(rates, ["window_start"])), "window_start")


@query(
    "stream_latency_summary",
    with_views(
        "requests",
        """
        SELECT label, count(*) AS samples,
               round(sum(dur_us)::DOUBLE / count(*) / 1000, 6) AS avg_ms,
               round(min(dur_us) / 1000, 6) AS min_ms, round(max(dur_us) / 1000, 6) AS max_ms,
               round(stddev_pop(dur_us / 1000), 6) AS stddev_ms,
               round(count(*) FILTER (NOT success) * 100 / count(*), 6) AS error_pct,
               round(count(*) * 1000000.0::DOUBLE / (max(start_us + dur_us) - min(start_us)), 6)
                   AS throughput_per_s,
               round(sum(bytes) / 1024 * 1000000.0::DOUBLE
                     / (max(start_us + dur_us) - min(start_us)), 6) AS kb_per_s,
               round(sum(bytes)::DOUBLE / count(*), 6) AS avg_bytes
        FROM requests GROUP BY label""",
    ),
)
def stream_latency_summary(spark, sf_dir):
    summary = reports.stream_summary(_requests(spark, sf_dir))
    return rounded(replay.run_to_table(summary, ["label"]))


@query("stream_kv_state", FINAL_STATE)
def stream_kv_state(spark, sf_dir):
    written = reports.stream_kv_state(kv_ops_from(_requests(spark, sf_dir)))
    return records.apply_writes(
        replay.run_to_table(written, ["key"]), kv_base(spark, sf_dir)
    )


@query(
    "stream_ready",
    with_views(
        "requests",
        """
        SELECT flow AS node, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ready_at
        FROM requests WHERE label = 'signup' AND floor(elapsed_ms) >= 100 GROUP BY flow""",
    ),
)
def stream_ready(spark, sf_dir):
    ready = reports.stream_ready(ready_lines(_requests(spark, sf_dir)), READY)
    return _stamped(replay.run_to_table(ready, ["node"]), "ready_at")


WAIT_S = 10 * 86_400


@query(
    "stream_not_ready",
    with_views(
        "requests",
        f"""
        WITH begun AS (
            SELECT flow, min(ts) + to_seconds({WAIT_S}) AS deadline FROM requests GROUP BY flow)
        SELECT flow AS node, strftime(deadline, '%Y-%m-%d %H:%M:%S') AS deadline FROM begun
        WHERE flow NOT IN (
            SELECT flow FROM requests JOIN begun USING (flow)
            WHERE label = 'signup' AND floor(elapsed_ms) >= 100 AND ts <= deadline)""",
    ),
)
def stream_not_ready(spark, sf_dir):
    logs = ready_lines(_requests(spark, sf_dir, closing=True))
    late = reports.stream_not_ready(logs, READY, WAIT_S, SHORT)
    stored = replay.run_to_table(late, ["node"], mode="append")
    return _stamped(stored.where(F.col("node") != CLOCK), "deadline")


GAP_HOURS = 6

SESSIONS = with_views(
    "requests",
    f"""
    WITH before AS (
        SELECT flow, ts, seq, lag(ts) OVER (PARTITION BY flow ORDER BY ts, seq) AS last FROM requests),
    marked AS (
        SELECT flow, ts, sum(CASE WHEN last IS NULL OR ts - last >= to_hours({GAP_HOURS}) THEN 1 ELSE 0 END)
            OVER (PARTITION BY flow ORDER BY ts, seq) AS session
        FROM before)
    SELECT flow, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS rows
    FROM marked GROUP BY flow, session""",
)


@query("stream_sessions", SESSIONS)
def stream_sessions(spark, sf_dir):
    log = _requests(spark, sf_dir, closing=True)
    found = reports.stream_sessions(log, "flow", "ts", f"{GAP_HOURS} hours", SHORT)
    stored = replay.run_to_table(found, ["flow", "first"], mode="append").where(F.col("flow") != CLOCK)
    return _stamped(_stamped(stored, "first"), "last")


BOUND_HOURS = 12

FOLLOWED = with_views(
    "requests",
    f"""
    SELECT v.flow, v.seq AS view, p.seq AS purchase
    FROM requests v LEFT JOIN requests p
        ON v.flow = p.flow AND p.label = 'purchase'
        AND p.start_us BETWEEN v.start_us AND v.start_us + {BOUND_HOURS * 3_600_000_000}
    WHERE v.label = 'view'""",
)


@query("stream_view_to_purchase", FOLLOWED)
def stream_view_to_purchase(spark, sf_dir):
    log = _requests(spark, sf_dir, closing=True)
    views = log.where("label IN ('view', 'clock')").select("flow", F.col("seq").alias("view"), "ts")
    bought = log.where("label IN ('purchase', 'clock')")
    bought = bought.select("flow", F.col("seq").alias("purchase"), F.col("ts").alias("bought"))
    pairs = reports.stream_band_join(views, bought, "flow", "ts", "bought", f"{BOUND_HOURS} hours", SHORT)
    columns = pairs.select("flow", "view", "purchase")
    stored = replay.run_to_table(columns, ["view", "purchase"], mode="append")
    return stored.where(F.col("flow") != CLOCK).select("flow", "view", "purchase")


# Parts of the events' time in the order in which they arrive: the third part is late.
ARRIVAL = (0, 1, 3, 2)
DELAY_S, WIDTH_S = 86_400, 3_600


@query(
    "stream_late_rows",
    f"""
    WITH span AS (SELECT min(epoch(ts)::BIGINT) AS a, max(epoch(ts)::BIGINT) AS b FROM events),
    parts AS (
        SELECT date_trunc('hour', ts) AS start, epoch(ts)::BIGINT AS s,
               least((epoch(ts)::BIGINT - a) * {len(ARRIVAL)} // (b - a + 1), {len(ARRIVAL) - 1}) AS part
        FROM events, span),
    late AS (
        SELECT start, part = 2 AND epoch(start)::BIGINT + {WIDTH_S}
            <= (SELECT max(s) FROM parts WHERE part = 3) - {DELAY_S} AS late
        FROM parts)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start,
           count(*) FILTER (NOT late) AS records, count(*) FILTER (late) AS late_rows
    FROM late GROUP BY start""",
)
def stream_late_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    folder, out = scratch_folder(spark, "events"), scratch_folder(spark, "late")
    second = F.unix_seconds("ts")
    first, last = stamped.agg(F.min(second), F.max(second)).first()
    if first is not None:
        part = F.least(F.floor((second - first) * len(ARRIVAL) / (last - first + 1)), F.lit(len(ARRIVAL) - 1))
        place = F.array_position(F.array(*[F.lit(p) for p in ARRIVAL]).cast("array<bigint>"), part.cast("bigint")) - 1
        # One file for each place in the order of arrival.
        stamped.repartitionById(len(ARRIVAL), place.cast("int")).write.parquet(folder)
        replay.in_order(spark, folder)
        feed = replay.replay_stream(spark, folder, stamped.schema, files_per_trigger=1)
        late.count_with_late(feed, "ts", WIDTH_S, DELAY_S, out)
    counted = late.closed_counts(spark, out, WIDTH_S).unionByName(late.closed_counts(spark, out, WIDTH_S, closed=False))
    missed = late.late_rows(spark, out, stamped.schema)
    missed = missed.groupBy(F.date_trunc("hour", "ts").alias("window_start")).agg(F.count(F.lit(1)).alias("late_rows"))
    both = counted.join(missed, "window_start", "full").fillna(0, ["records", "late_rows"])
    return _stamped(both, "window_start").select("window_start", "records", "late_rows")


@query("stream_latency_percentiles", NEAR_RANKS)
def stream_latency_percentiles(spark, sf_dir):
    # The stream keeps a sketch for each label and day; percentiles while it runs are merged from the table.
    log = _requests(spark, sf_dir).withWatermark("ts", DELAY)
    daily = log.groupBy(F.window("ts", "1 day").alias("day"), "label")
    kept = daily.agg(sketches.sketched(F.col("dur_us")).alias("sketch"), F.count("dur_us").alias("n"))
    table_ = replay.run_to_table(kept.select(F.col("day.start").alias("day"), "label", "sketch", "n"), ["day", "label"])
    merged = cut(sketches.merged_quantiles(table_, ["label"], WANTED))
    return near_ranks(requests(spark, sf_dir).select("label", "dur_us"), merged)


@query("stream_hook", "SELECT event_type AS label, count(*) AS rows FROM events GROUP BY ALL")
def stream_hook(spark, sf_dir):
    # User code for each micro-batch: it counts the rows of a batch into a folder of that batch.
    folder = scratch_folder(spark, "hook")

    def count_rows(rows, batch):
        rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/seen/batch={batch}")

    replay.with_hook(_requests(spark, sf_dir), count_rows, f"{folder}/progress").awaitTermination()
    seen = spark.read.schema("label string, rows bigint, batch bigint").parquet(f"{folder}/seen")
    return seen.groupBy("label").agg(F.sum("rows").alias("rows"))
