"""Queries on request logs and operation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions import measures, sketches
from loadlens.functions.lineage import cut, stored_rows
from loadlens.operators import hooks, latency, records
from loadlens.plans.registry import query, rounded
from loadlens.plans.views import kv_ops, leaf_times, requests, table, with_views

HOUR_MS = 3_600_000
DAY_US = 86_400_000_000
# Offered load of the fixture: about 14 requests an hour.
FIXTURE_QPS = 0.004


@query(
    "latency_summary",
    with_views(
        "requests",
        """
        SELECT CASE WHEN grouping(label) = 1 THEN 'TOTAL' ELSE label END AS label,
               count(*) AS samples,
               round(sum(dur_us)::DOUBLE / count(*) / 1000, 6) AS avg_ms,
               round(min(dur_us) / 1000, 6) AS min_ms, round(max(dur_us) / 1000, 6) AS max_ms,
               round(stddev_pop(dur_us / 1000), 6) AS stddev_ms,
               round(count(*) FILTER (NOT success) * 100 / count(*), 6) AS error_pct,
               round(count(*) * 1000000.0::DOUBLE / (max(start_us + dur_us) - min(start_us)), 6)
                   AS throughput_per_s,
               round(sum(bytes) / 1024 * 1000000.0::DOUBLE
                     / (max(start_us + dur_us) - min(start_us)), 6) AS kb_per_s,
               round(sum(bytes)::DOUBLE / count(*), 6) AS avg_bytes
        FROM requests GROUP BY ROLLUP (label)""",
    ),
)
def latency_summary(spark, sf_dir):
    return rounded(latency.latency_summary(requests(spark, sf_dir)))


@query(
    "kv_op_summary",
    with_views(
        "kv_ops",
        """
        SELECT op, count(*) AS ops, round(sum(dur_us)::DOUBLE / count(*) / 1000, 6) AS avg_ms,
               round(min(dur_us) / 1000, 6) AS min_ms, round(max(dur_us) / 1000, 6) AS max_ms,
               count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status <> 'OK') AS errors,
               round(quantile_cont(dur_us, 0.95) / 1000, 6) AS p95_ms,
               round(quantile_cont(dur_us, 0.99) / 1000, 6) AS p99_ms,
               (SELECT round(count(*) * 1000000.0::DOUBLE
                             / (max(start_us + dur_us) - min(start_us)), 6)
                FROM kv_ops) AS overall_ops_per_s
        FROM kv_ops GROUP BY op""",
    ),
)
def kv_op_summary(spark, sf_dir):
    return rounded(latency.op_summary(kv_ops(spark, sf_dir)))


@query(
    "latency_timeseries",
    with_views(
        "kv_ops",
        """
        SELECT op, start_us // 3600000000 * 3600000 AS bucket_ms, count(*) AS ops,
               round(sum(dur_us)::DOUBLE / count(*) / 1000, 6) AS avg_ms
        FROM kv_ops GROUP BY ALL""",
    ),
)
def latency_timeseries(spark, sf_dir):
    return rounded(latency.latency_timeseries(kv_ops(spark, sf_dir), HOUR_MS))


@query(
    "progress_report",
    with_views(
        "kv_ops",
        """
        SELECT bucket_ms, ops,
               CAST(sum(ops) OVER (ORDER BY bucket_ms ROWS UNBOUNDED PRECEDING) AS BIGINT)
                   AS total_ops,
               round(ops * 1000 / 30000, 6) AS ops_per_s
        FROM (SELECT start_us // 30000000 * 30000 AS bucket_ms, count(*) AS ops
              FROM kv_ops GROUP BY ALL)""",
    ),
)
def progress_report(spark, sf_dir):
    return rounded(latency.progress_report(kv_ops(spark, sf_dir)))


@query(
    "percentile_table",
    with_views(
        "requests",
        """
        SELECT label, round(count(*) / 100, 6) AS per_percentile, stat,
               round(CASE stat
                   WHEN 'MAX' THEN max(elapsed_ms) WHEN 'MIN' THEN min(elapsed_ms)
                   WHEN '99.99' THEN quantile_cont(elapsed_ms, 0.9999)
                   WHEN '99.90' THEN quantile_cont(elapsed_ms, 0.999)
                   WHEN '99.50' THEN quantile_cont(elapsed_ms, 0.995)
                   WHEN '99.00' THEN quantile_cont(elapsed_ms, 0.99)
                   WHEN '95.00' THEN quantile_cont(elapsed_ms, 0.95)
                   WHEN '90.00' THEN quantile_cont(elapsed_ms, 0.9)
                   WHEN '75.00' THEN quantile_cont(elapsed_ms, 0.75)
                   WHEN '50.00' THEN quantile_cont(elapsed_ms, 0.5)
                   ELSE quantile_cont(elapsed_ms, 0.25) END, 6) AS value
        FROM requests, (SELECT unnest(['MAX', '99.99', '99.90', '99.50', '99.00', '95.00',
                                       '90.00', '75.00', '50.00', '25.00', 'MIN']) AS stat)
        GROUP BY label, stat""",
    ),
)
def percentile_table(spark, sf_dir):
    return rounded(latency.percentile_table(requests(spark, sf_dir), "elapsed_ms", ["label"]))


@query(
    "valid_duration",
    with_views(
        "requests",
        """
        WITH span AS (SELECT min(start_us) AS lo, max(start_us) AS hi FROM requests),
        runs AS (SELECT 'total' AS phase, lo, hi FROM span
                 UNION ALL SELECT 'valid', lo + 86400000000, hi - 86400000000 FROM span)
        SELECT phase, round((any_value(hi) - any_value(lo)) / 1000000, 6) AS run_s,
               count(*) AS sent, count(*) FILTER (success) AS received,
               round(sum(dur_us)::DOUBLE / count(*) / 1000, 6) AS avg_ms,
               round(stddev_pop(dur_us / 1000), 6) AS stddev_ms
        FROM requests JOIN runs ON start_us BETWEEN lo AND hi GROUP BY phase""",
    ),
)
def valid_duration(spark, sf_dir):
    return rounded(latency.valid_window(requests(spark, sf_dir), DAY_US, DAY_US))


def _item_messages(spark, sf_dir):
    """Order lines as messages: one flow per supplier, in order of shipping."""
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("flow"), F.col("l_shipdate").alias("arrived"), number.alias("seq")
    )


@query(
    "message_quality",
    """
    WITH messages AS (SELECT l_suppkey AS flow, l_shipdate AS arrived,
                             l_orderkey * 8 + l_linenumber AS seq FROM lineitem),
    seen AS (SELECT flow, seq, max(seq) OVER (PARTITION BY flow ORDER BY arrived, seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before
             FROM messages)
    SELECT flow, count(*) AS messages,
           max(seq) - min(seq) + 1 - count(DISTINCT seq) AS dropped,
           count(*) - count(DISTINCT seq) AS duplicated,
           count(*) FILTER (seq < highest_before) AS out_of_order
    FROM seen GROUP BY flow""",
)
def message_quality(spark, sf_dir):
    return latency.message_quality(_item_messages(spark, sf_dir), ["flow"], ["arrived", "seq"], "seq")


@query(
    "out_of_order",
    """
    SELECT * FROM (
        SELECT o_custkey AS flow, o_orderkey AS seq,
               strftime(o_orderdate, '%Y-%m-%d') AS arrived,
               max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before
        FROM orders)
    WHERE seq < highest_before""",
)
def out_of_order(spark, sf_dir):
    arrivals = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("flow"), F.col("o_orderkey").alias("seq"), "o_orderdate"
    )
    late = latency.out_of_order(arrivals, ["flow"], ["o_orderdate", "seq"], "seq")
    arrived = F.date_format("o_orderdate", "yyyy-MM-dd").alias("arrived")
    return late.select("flow", "seq", arrived, "highest_before")


@query(
    "stream_bandwidth",
    with_views(
        "requests",
        """
        SELECT CASE WHEN grouping(stream) = 1 THEN 'SUM' ELSE stream END AS stream,
               CAST(sum(bytes) AS BIGINT) AS bytes,
               round(sum(bytes) * 8 * 1000000.0::DOUBLE
                     / (SELECT max(start_us + dur_us) - min(start_us) FROM requests), 6)
                   AS bits_per_s
        FROM (SELECT CAST(flow % 8 AS VARCHAR) AS stream, bytes FROM requests)
        GROUP BY ROLLUP (stream)""",
    ),
)
def stream_bandwidth(spark, sf_dir):
    return rounded(
        latency.stream_bandwidth(requests(spark, sf_dir), F.pmod(F.col("flow"), F.lit(8)))
    )


SWEEP = """
    SELECT CASE WHEN q > 0 THEN 1::BIGINT << (length(bin(q)) - 1) ELSE 0 END AS size,
           count(*) AS repetitions,
           round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / count(*), 6) AS avg_usec,
           round(sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE
                 / sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / 1.048576, 9) AS mib_per_s
    FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY ALL"""


def _sweep(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    sweep = latency.size_sweep(items, "l_quantity", "l_extendedprice")
    return sweep.withColumns(
        {"avg_usec": F.round("avg_usec", 6), "mib_per_s": F.round("mib_per_s", 9)}
    )


@query("size_sweep", SWEEP)
def size_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(
    "peak_bandwidth",
    f"""
    WITH sweep AS ({SWEEP})
    SELECT max(mib_per_s) AS peak_mib_per_s, round(avg(mib_per_s), 9) AS avg_mib_per_s,
           (SELECT size FROM sweep ORDER BY mib_per_s DESC, size LIMIT 1) AS size_at_peak
    FROM sweep""",
)
def peak_bandwidth(spark, sf_dir):
    return rounded(latency.peak_rate(_sweep(spark, sf_dir)), 9)


@query(
    "min_max_typical",
    with_views(
        "requests",
        """
        SELECT label, count(*) AS iterations, round(min(elapsed_ms), 6) AS t_min,
               round(max(elapsed_ms), 6) AS t_max,
               round(quantile_cont(elapsed_ms, 0.5), 6) AS t_typical
        FROM requests GROUP BY label""",
    ),
)
def min_max_typical(spark, sf_dir):
    return rounded(latency.min_max_typical(requests(spark, sf_dir), "elapsed_ms", ["label"]))


@query(
    "mode_compare",
    with_views(
        "requests",
        """
        WITH sides AS (
            SELECT success, count(*)::DOUBLE AS samples,
                   sum(dur_us)::DOUBLE / count(*) / 1000 AS avg_ms,
                   stddev_pop(dur_us / 1000) AS stddev_ms, min(dur_us) / 1000 AS min_ms,
                   quantile_cont(dur_us, 0.5) / 1000 AS p50_ms,
                   quantile_cont(dur_us, 0.99) / 1000 AS p99_ms, max(dur_us) / 1000 AS max_ms
            FROM requests GROUP BY success),
        figures AS (
            SELECT success, unnest(['samples', 'avg_ms', 'stddev_ms', 'min_ms', 'p50_ms',
                                    'p99_ms', 'max_ms']) AS metric,
                   unnest([samples, avg_ms, stddev_ms, min_ms, p50_ms, p99_ms, max_ms]) AS value
            FROM sides),
        pivoted AS (
            SELECT metric, max(value) FILTER (success) AS ok,
                   max(value) FILTER (NOT success) AS error
            FROM figures GROUP BY metric)
        SELECT metric, round(ok, 6) AS ok, round(error, 6) AS error,
               round(error / nullif(ok, 0), 6) AS ratio
        FROM pivoted""",
    ),
)
def mode_compare(spark, sf_dir):
    mode = F.when(F.col("success"), "ok").otherwise("error")
    return rounded(latency.compare_modes(requests(spark, sf_dir), mode, "ok", "error"))


@query(
    "all_ok",
    with_views(
        "requests",
        """
        SELECT start_us // 3600000000 * 3600000 AS hour_ms, bool_and(success) AS all_ok,
               count(*) FILTER (success) AS good, count(*) AS total
        FROM requests GROUP BY ALL""",
    ),
)
def all_ok(spark, sf_dir):
    hours = requests(spark, sf_dir).select(
        measures.bucket_ms(F.col("start_us"), HOUR_MS).alias("hour_ms"), "success"
    )
    return latency.all_ok(hours, ["hour_ms"], "success")


@query(
    "fanout_latency",
    with_views(
        "leaf_times",
        """
        WITH per_request AS (SELECT request, count(*) AS fanout, max(t) AS t_request
                             FROM leaf_times GROUP BY request),
        leaves AS (SELECT fanout, t FROM leaf_times JOIN per_request USING (request))
        SELECT fanout, count(*) AS requests,
               round(sum(CAST(t_request AS DECIMAL(18,2)))::DOUBLE / count(*), 6) AS mean_request,
               round(quantile_cont(t_request, 0.99), 6) AS p99_request,
               (SELECT round(quantile_cont(t, 0.99), 6) FROM leaves
                WHERE leaves.fanout = per_request.fanout) AS p99_leaf
        FROM per_request GROUP BY fanout""",
    ),
)
def fanout_latency(spark, sf_dir):
    # The answers come from an aggregation, so they are made once and kept.
    return rounded(latency.fanout_latency(cut(leaf_times(spark, sf_dir))))


@query(
    "concurrency_peak",
    with_views(
        "requests",
        """
        WITH long AS (SELECT label, start_us, dur_us * 60000 AS dur_us FROM requests),
        moves AS (SELECT label, start_us AS t, 1 AS delta FROM long
                  UNION ALL SELECT label, start_us + dur_us, -1 FROM long),
        steps AS (SELECT label, t, sum(delta) AS delta FROM moves GROUP BY label, t),
        level AS (SELECT label, sum(delta) OVER (PARTITION BY label ORDER BY t) AS n FROM steps),
        peaks AS (SELECT label, CAST(max(n) AS BIGINT) AS peak FROM level GROUP BY label)
        SELECT label, count(*) AS requests,
               round(sum(dur_us)::DOUBLE / (max(start_us + dur_us) - min(start_us)), 6)
                   AS mean_in_flight,
               any_value(peak) AS peak
        FROM long JOIN peaks USING (label) GROUP BY label""",
    ),
)
def concurrency_peak(spark, sf_dir):
    # A latency of x ms is read as x minutes; otherwise no two requests overlap.
    longer = requests(spark, sf_dir).withColumn("dur_us", F.col("dur_us") * 60_000)
    return rounded(latency.concurrency_profile(longer))


@query(
    "offered_vs_achieved",
    with_views(
        "requests",
        f"""
        SELECT start_us // 60000000 * 60000 AS minute_ms,
               round({FIXTURE_QPS}::DOUBLE * 60, 6) AS offered, count(*) AS achieved,
               round(count(*) / ({FIXTURE_QPS}::DOUBLE * 60), 6) AS ratio
        FROM requests GROUP BY ALL""",
    ),
)
def offered_vs_achieved(spark, sf_dir):
    return rounded(latency.rate_report(requests(spark, sf_dir), FIXTURE_QPS))


@query(
    "derived_rates",
    with_views(
        "requests",
        """
        SELECT seq, round(bytes / nullif(dur_us, 0) / 1.048576, 9) AS mib_per_s,
               round(bytes * 8 / nullif(dur_us, 0), 9) AS mbit_per_s
        FROM requests""",
    ),
)
def derived_rates(spark, sf_dir):
    size, usec = F.col("bytes"), F.col("dur_us")
    rates = requests(spark, sf_dir).select(
        "seq",
        measures.mib_per_s(size, usec).alias("mib_per_s"),
        measures.mbit_per_s(size, usec).alias("mbit_per_s"),
    )
    return rounded(rates, 9)


# Fixed value: form of a pause line in a garbage collection log.
GC_PAUSE = r"\[(?:Full )?GC .*, ([0-9]+\.[0-9]+) secs\]"


@query(
    "gc_pauses",
    with_views(
        "requests",
        """
        SELECT 'node' || flow AS node, count(*) AS pauses,
               round(sum(CAST(elapsed_ms AS DECIMAL(18,2)))::DOUBLE / 1000, 6) AS total_s,
               round(max(elapsed_ms) / 1000, 6) AS max_s
        FROM requests GROUP BY flow""",
    ),
)
def gc_pauses(spark, sf_dir):
    lines = requests(spark, sf_dir).select(
        F.concat(F.lit("node"), F.col("flow")).alias("node"),
        F.format_string(
            "%.3f: [GC [PSYoungGen: %dK->0K(76288K)] %dK->8K(251392K), %.7f secs]",
            F.col("start_us") / 1_000_000,
            "bytes",
            "bytes",
            F.col("elapsed_ms") / 1000,
        ).alias("line"),
    )
    return rounded(latency.gc_pauses(lines, GC_PAUSE))


@query(
    "key_popularity",
    with_views(
        "kv_ops",
        """
        SELECT key, ops, row_number() OVER (ORDER BY ops DESC, key) AS rank,
               round(sum(ops) OVER (ORDER BY ops DESC, key)::DOUBLE / sum(ops) OVER (), 6)
                   AS cumulative_share
        FROM (SELECT key, count(*) AS ops FROM kv_ops GROUP BY key)""",
    ),
)
def key_popularity(spark, sf_dir):
    return rounded(records.key_popularity(kv_ops(spark, sf_dir)))


@query(
    "op_mix",
    with_views(
        "kv_ops",
        """
        SELECT op, count(*) AS ops, round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM kv_ops GROUP BY op""",
    ),
)
def op_mix(spark, sf_dir):
    return rounded(records.op_mix(kv_ops(spark, sf_dir)))


WANTED = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
# A sketch of this size is that near to the asked rank in nearly all cases; merging adds nothing to it.
RANK_ERROR = 0.02

NEAR_RANKS = with_views(
    "requests",
    "SELECT label, count(*) AS n, " + ", ".join(f"true AS {c}" for c in WANTED) + " FROM requests GROUP BY label",
)


def near_ranks(log, estimates):
    """Whether each merged percentile is near the rank asked for, by an exact count over all rows."""
    errors = sketches.rank_error(log, estimates, ["label"], "dur_us", WANTED)
    return errors.select("label", "n", *[(F.col(c) <= RANK_ERROR).alias(c) for c in WANTED])


@query("latency_sketches", NEAR_RANKS)
def latency_sketches(spark, sf_dir):
    # A sketch for each label and hour is kept; percentiles of all time come from merging them.
    log = requests(spark, sf_dir).select("label", "dur_us", F.date_trunc("hour", "ts").alias("hour"))
    kept = stored_rows(sketches.store_sketches(log, ["label", "hour"], "dur_us"), "sketches")
    return near_ranks(log, cut(sketches.merged_quantiles(kept, ["label"], WANTED)))


@query(
    "hooked_report",
    with_views(
        "requests",
        """
        SELECT label, count(*) AS n, CAST(max(dur_us) AS BIGINT) AS most FROM requests
        WHERE dur_us >= 50000 GROUP BY label""",
    ),
)
def hooked_report(spark, sf_dir):
    # User code at a named point of the job: it leaves out short requests.
    def slow_only(rows, least):
        return rows.where(F.col("dur_us") >= least)

    log = hooks.apply_hook(requests(spark, sf_dir), slow_only, 50_000)
    return hooks.apply_hook(log, None).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("dur_us").alias("most"))
