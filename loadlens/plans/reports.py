"""Queries on report lines: sections and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.plans.registry import query
from loadlens.plans.views import requests, table, with_views
from loadlens.sources import reports

BLOCK_LINES = 16
RULE = "-" * reports.RULE_WIDTH


@query(
    "section_fill",
    """
    SELECT user_id AS file, event_id AS line_no, event_type AS line,
           last_value(CASE WHEN event_type = 'signup' THEN 'section ' || event_id END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
    FROM events""",
)
def section_fill(spark, sf_dir):
    title = F.when(
        F.col("event_type") == "signup", F.concat(F.lit("section "), F.col("event_id"))
    )
    lines = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"),
        F.col("event_id").alias("line_no"),
        F.col("event_type").alias("line"),
        title.alias("title"),
    )
    return reports.fill_sections(lines).drop("title")


def report_lines(log):
    """A report per user: each request is a titled section in the form of its label."""
    size = F.col("bytes")
    usec = F.col("dur_us")
    seconds = F.format_string("%.6f", usec / 1_000_000)
    two_sides = F.array(
        F.lit(" #bytes #iterations    t_min[usec]    t_max[usec]  t_typical[usec]"),
        F.format_string(" %d  1000   %d  %d  %d ", size, usec, usec + 2, usec + 1),
        F.lit(" #bytes     #iterations    BW peak[MB/sec]    BW average[MB/sec]   MsgRate[Mpps]"),
        F.format_string(" %d      5000      %d     %d\t\t   0.5", size, usec, usec),
    )
    sweep = F.array(
        F.lit("       #bytes #repetitions      t[usec]   Mbytes/sec"),
        F.format_string("    %d    1000   %d   4.25", size, usec),
    )
    pingpong = F.array(
        F.format_string("%d bytes in %s seconds = %d Mbit/sec", size, seconds, usec),
        F.format_string("1000 iters in %s seconds = %d usec/iter", seconds, usec),
        # The other side prints the same figure.
        F.format_string("%d bytes in %s seconds = %d Mbit/sec", size, seconds, usec + 5),
    )
    streams = F.array(
        F.lit("[ ID] Interval       Transfer     Bandwidth"),
        F.format_string("[ %d]  0.0-10.0 sec  %d GBytes  1.5 Gbits/sec", size, usec),
        F.format_string("[SUM]  0.0-10.0 sec  %d GBytes  1.5 Gbits/sec", usec),
    )
    tail = F.array(
        F.format_string(
            "client: [Valid Duration] RunTime=1.000 sec; SentMessages=%d; ReceivedMessages=%d",
            usec,
            size,
        ),
        F.format_string("client: ====> avg-lat=  %d (std-dev=0.375)", usec),
        F.lit("client: # dropped messages = 0; # duplicated messages = 1; # out-of-order messages = 2"),
        F.format_string("client: Total %d observations; each percentile contains 0.5 observations", usec),
        F.format_string("client: ---> <MAX> observation =   %d", usec),
        F.format_string("client: ---> percentile  99.90 =    %d", usec),
    )
    label = F.col("label")
    body = (
        F.when(label == "click", two_sides)
        .when(label == "signup", sweep)
        .when(label == "view", pingpong)
        .when(label == "purchase", streams)
        .otherwise(tail)
    )
    title = F.array(
        F.lit(""), F.lit(""), F.lit(RULE), F.concat(label, F.lit(" of "), F.col("seq")), F.lit(RULE)
    )
    block = log.select("flow", "seq", F.posexplode(F.concat(title, body)).alias("i", "line"))
    return block.select(
        F.concat(F.lit("report-"), F.col("flow")).alias("file"),
        (F.col("seq") * BLOCK_LINES + F.col("i") + 1).alias("line_no"),
        "line",
    )


def _expected() -> str:
    """Figures each label's section must give: label, line, table, name, key, value, unit."""
    rows = [
        ("click", 7, 1, "iterations", "bytes", "1000", "count"),
        ("click", 7, 1, "latency_min", "bytes", "dur_us", "usec"),
        ("click", 7, 1, "latency_max", "bytes", "dur_us + 2", "usec"),
        ("click", 7, 1, "latency_typical", "bytes", "dur_us + 1", "usec"),
        ("click", 9, 2, "iterations", "bytes", "5000", "count"),
        ("click", 9, 2, "bandwidth_peak", "bytes", "dur_us", "MB/sec"),
        ("click", 9, 2, "bandwidth_average", "bytes", "dur_us", "MB/sec"),
        ("click", 9, 2, "message_rate", "bytes", "0.5", "Mpps"),
        ("signup", 7, 1, "repetitions", "bytes", "1000", "count"),
        ("signup", 7, 1, "time", "bytes", "dur_us", "usec"),
        ("signup", 7, 1, "rate", "bytes", "4.25", "Mbytes/sec"),
        ("view", 6, 0, "seconds", "bytes", "secs", "sec"),
        ("view", 6, 0, "pingpong_rate", "bytes", "dur_us", "Mbit/sec"),
        ("view", 7, 0, "seconds", "1000", "secs", "sec"),
        ("view", 7, 0, "pingpong_time", "1000", "dur_us", "usec/iter"),
        ("view", 8, 0, "seconds", "bytes", "secs", "sec"),
        ("view", 8, 0, "pingpong_rate", "bytes", "dur_us + 5", "Mbit/sec"),
        ("purchase", 7, 1, "transfer", "bytes", "dur_us", "GBytes"),
        ("purchase", 7, 1, "bandwidth", "bytes", "1.5", "Gbits/sec"),
        ("purchase", 8, 1, "transfer", "'SUM'", "dur_us", "GBytes"),
        ("purchase", 8, 1, "bandwidth", "'SUM'", "1.5", "Gbits/sec"),
        ("error", 6, 0, "run_time", "'Valid Duration'", "1", "sec"),
        ("error", 6, 0, "sent", "'Valid Duration'", "dur_us", "count"),
        ("error", 6, 0, "received", "'Valid Duration'", "bytes", "count"),
        ("error", 7, 0, "latency_average", "'valid'", "dur_us", "usec"),
        ("error", 7, 0, "latency_stddev", "'valid'", "0.375", "usec"),
        ("error", 8, 0, "dropped", "'valid'", "0", "count"),
        ("error", 8, 0, "duplicated", "'valid'", "1", "count"),
        ("error", 8, 0, "out_of_order", "'valid'", "2", "count"),
        ("error", 9, 0, "observations", "'valid'", "dur_us", "count"),
        ("error", 9, 0, "per_percentile", "'valid'", "0.5", "count"),
        ("error", 10, 0, "percentile", "'MAX'", "dur_us", "usec"),
        ("error", 11, 0, "percentile", "'99.90'", "dur_us", "usec"),
    ]
    return " UNION ALL ".join(
        f"SELECT flow, label, seq, {line} AS line, '{metric}' AS metric, "
        f"CAST({key} AS VARCHAR) AS key, CAST({value} AS DOUBLE) AS value, '{unit}' AS unit, "
        f"before + {table_no} AS table_no FROM numbered WHERE label = '{label}'"
        for label, line, table_no, metric, key, value, unit in rows
    )


@query(
    "perf_report_rows",
    with_views(
        "requests",
        f"""
        WITH numbered AS (
            SELECT *, dur_us / 1000000 AS secs,
                   coalesce(sum(CASE label WHEN 'click' THEN 2 WHEN 'signup' THEN 1
                                 WHEN 'purchase' THEN 1 ELSE 0 END)
                       OVER (PARTITION BY flow ORDER BY seq
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
                       AS before
            FROM requests),
        figures AS ({_expected()})
        SELECT 'report-' || flow AS file, label || ' of ' || seq AS section,
               seq * {BLOCK_LINES} + line AS line_no, table_no, metric, key, value, unit,
               row_number() OVER (PARTITION BY flow, seq, table_no, metric, key ORDER BY line)
                   AS occurrence
        FROM figures""",
    ),
)
def perf_report_rows(spark, sf_dir):
    return reports.report_rows(report_lines(requests(spark, sf_dir)))
