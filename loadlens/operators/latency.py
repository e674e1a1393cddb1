"""Reports on request logs: latency, throughput, percentiles, message quality.

A request log has ``start_us`` and ``dur_us`` (whole microseconds), ``label``,
``flow``, ``seq``, ``success`` and ``bytes``.  Sums run on whole microseconds, so
they do not depend on the order in which partial results meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from loadlens.functions.joins import split_join
from loadlens.functions.lineage import stored_rows
from loadlens.functions.measures import bucket_ms, mib_per_s, per_second, size_class
from loadlens.functions.ordered import running, same_keys
from loadlens.functions.quantiles import quantiles

# The steps of a percentile report, from the top.
PERCENTILES = (99.99, 99.9, 99.5, 99.0, 95.0, 90.0, 75.0, 50.0, 25.0)


def _every_row() -> WindowSpec:
    """All rows at once: only for tables with one row per operation or stream."""
    return Window.partitionBy()


def _end_us() -> Column:
    return F.col("start_us") + F.col("dur_us")


def _mean_ms() -> Column:
    return F.sum("dur_us") / F.count("dur_us") / 1000


def _run_us() -> Column:
    """Time from the first start to the last end."""
    return F.max(_end_us()) - F.min("start_us")


def summary_aggregates() -> list[Column]:
    """Aggregates behind a latency summary; all of them merge part by part."""
    return [
        F.count(F.lit(1)).alias("samples"),
        _mean_ms().alias("avg_ms"),
        (F.min("dur_us") / 1000).alias("min_ms"),
        (F.max("dur_us") / 1000).alias("max_ms"),
        F.stddev_pop(F.col("dur_us") / 1000).alias("stddev_ms"),
        (F.count_if(~F.col("success")) * 100 / F.count(F.lit(1))).alias("error_pct"),
        F.sum("bytes").alias("bytes"),
        _run_us().alias("run_us"),
    ]


def summary_figures(report: DataFrame, label: Column) -> DataFrame:
    """The figures of a latency summary from its aggregates."""
    run = F.col("run_us")
    return report.select(
        label.alias("label"),
        "samples",
        "avg_ms",
        "min_ms",
        "max_ms",
        "stddev_ms",
        "error_pct",
        per_second(F.col("samples"), run).alias("throughput_per_s"),
        per_second(F.col("bytes") / 1024, run).alias("kb_per_s"),
        (F.col("bytes") / F.col("samples")).alias("avg_bytes"),
    )


def latency_summary(requests: DataFrame) -> DataFrame:
    """Per label and in total: counts, latency, errors, throughput and sizes."""
    report = requests.rollup("label").agg(
        F.grouping("label").alias("is_total"), *summary_aggregates()
    )
    return summary_figures(report, F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("label")))


def op_summary(ops: DataFrame) -> DataFrame:
    """Per operation: counts, latency with 95th and 99th percentile, overall rate."""
    counts = ops.groupBy("op").agg(
        F.count(F.lit(1)).alias("ops"),
        _mean_ms().alias("avg_ms"),
        (F.min("dur_us") / 1000).alias("min_ms"),
        (F.max("dur_us") / 1000).alias("max_ms"),
        F.count_if(F.col("status") == "OK").alias("ok"),
        F.count_if(F.col("status") != "OK").alias("errors"),
        F.min("start_us").alias("first_us"),
        F.max(_end_us()).alias("last_us"),
    )
    # The whole run from one row per operation, without reading the log again.
    run_us = F.max("last_us").over(_every_row()) - F.min("first_us").over(_every_row())
    overall = per_second(F.sum("ops").over(_every_row()), run_us)
    counts = counts.withColumn("overall_ops_per_s", overall).drop("first_us", "last_us")
    tails = quantiles(ops, ["op"], "dur_us", {"p95": 0.95, "p99": 0.99})
    return counts.join(tails, same_keys(counts, tails, ["op"]), "left").select(
        counts["*"], (tails.p95 / 1000).alias("p95_ms"), (tails.p99 / 1000).alias("p99_ms")
    )


def latency_timeseries(ops: DataFrame, granularity_ms: int = 100) -> DataFrame:
    """Mean latency per operation and time interval."""
    return ops.groupBy("op", bucket_ms(F.col("start_us"), granularity_ms).alias("bucket_ms")).agg(
        F.count(F.lit(1)).alias("ops"), _mean_ms().alias("avg_ms")
    )


def progress_report(
    ops: DataFrame, interval_ms: int = 30_000
) -> DataFrame:
    """Per interval: operations in it, operations so far, rate."""
    buckets = ops.groupBy(bucket_ms(F.col("start_us"), interval_ms).alias("bucket_ms")).agg(
        F.count(F.lit(1)).alias("ops")
    )
    so_far = running(
        buckets, [], ["bucket_ms"], sums={"total_ops": F.col("ops")}, measure=ops
    )
    return so_far.withColumn("ops_per_s", F.col("ops") * 1000 / F.lit(interval_ms))


def percentile_table(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    exact: bool = True,
    percentiles: Sequence[float] = PERCENTILES,
) -> DataFrame:
    """Long table of MAX, the report's percentiles and MIN for each group."""
    wanted = {f"p{i}": p / 100 for i, p in enumerate(percentiles)}
    wide = quantiles(
        df, by, value, {"top": 1.0, **wanted, "low": 0.0}, exact=exact
    )
    steps = [("MAX", "top")]
    steps += [(f"{p:.2f}", f"p{i}") for i, p in enumerate(percentiles)]
    steps += [("MIN", "low")]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("stat"), F.col(c).cast("double").alias("value"))
            for name, c in steps
        ]
    )
    return wide.select(*by, (F.col("n") / 100).alias("per_percentile"), F.inline(rows))


def valid_window(requests: DataFrame, head_us: int, tail_us: int) -> DataFrame:
    """Whole run and valid run side by side; the valid run leaves out both ends.

    Sent counts requests that start in the run, received those that succeed.
    """
    valid = F.struct(
        (F.min("start_us") + head_us).alias("from_us"), (F.max("start_us") - tail_us).alias("to_us")
    )
    marked = requests.withColumn("valid", requests.select(valid).scalar())
    inside = F.col("start_us").between(F.col("valid.from_us"), F.col("valid.to_us"))

    def figures(phase: str, keep: Column, run_us: Column) -> Column:
        dur = F.when(keep, F.col("dur_us"))
        return F.struct(
            F.lit(phase).alias("phase"),
            (run_us / 1_000_000).alias("run_s"),
            F.count_if(keep).alias("sent"),
            F.count_if(keep & F.col("success")).alias("received"),
            (F.sum(dur) / F.count(dur) / 1000).alias("avg_ms"),
            F.stddev_pop(dur / 1000).alias("stddev_ms"),
        )

    total_us = F.max("start_us") - F.min("start_us")
    phases = F.array(
        figures("total", F.lit(True), total_us),
        figures("valid", inside, F.max("valid.to_us") - F.min("valid.from_us")),
    )
    return marked.agg(phases.alias("phases")).select(F.inline("phases"))


def out_of_order(
    arrivals: DataFrame,
    flow: Sequence[str],
    order: Sequence[str],
    seq: str,
) -> DataFrame:
    """Arrivals whose sequence number is below one seen before in the same flow."""
    seen = running(
        arrivals, flow, order, maxes={"highest_before": F.col(seq)}, before=True
    )
    return seen.where(F.col(seq) < F.col("highest_before"))


def message_quality(
    arrivals: DataFrame,
    flow: Sequence[str],
    order: Sequence[str],
    seq: str,
) -> DataFrame:
    """Per flow: messages dropped, duplicated and out of order."""
    flow = list(flow)
    # Equal numbers meet first, so a long flow is counted by many tasks.
    numbers = arrivals.groupBy(*flow, seq).agg(F.count(F.lit(1)).alias("copies"))
    counts = numbers.groupBy(*flow).agg(
        F.sum("copies").alias("messages"),
        (F.max(seq) - F.min(seq) + 1 - F.count(F.lit(1))).alias("dropped"),
        (F.sum("copies") - F.count(F.lit(1))).alias("duplicated"),
    )
    late = out_of_order(arrivals, flow, order, seq)
    late = late.groupBy(*flow).agg(F.count(F.lit(1)).alias("late"))
    return counts.join(late, same_keys(counts, late, flow), "left").select(
        counts["*"], F.coalesce(late.late, F.lit(0)).alias("out_of_order")
    )


def stream_bandwidth(requests: DataFrame, stream: Column) -> DataFrame:
    """Bytes and rate of each parallel stream, and a SUM row over all of them."""
    rows = (
        requests.withColumn("stream", stream.cast("string"))
        .rollup("stream")
        .agg(
            F.grouping("stream").alias("is_sum"),
            F.sum("bytes").alias("bytes"),
            _run_us().alias("run_us"),
        )
    )
    # All rates are over the whole run, which is that of the SUM row.
    whole_run = F.max("run_us").over(_every_row())
    return rows.select(
        F.when(F.col("is_sum") == 1, "SUM").otherwise(F.col("stream")).alias("stream"),
        "bytes",
        per_second(F.col("bytes") * 8, whole_run).alias("bits_per_s"),
    )


def size_sweep(df: DataFrame, size: str, usec: str) -> DataFrame:
    """By power-of-two size class: repetitions, mean time and rate."""
    total = F.sum(F.col(size).cast("decimal(18,2)")).cast("double")
    time = F.sum(F.col(usec).cast("decimal(18,2)")).cast("double")
    return df.groupBy(size_class(F.col(size)).alias("size")).agg(
        F.count(F.lit(1)).alias("repetitions"),
        (time / F.count(F.lit(1))).alias("avg_usec"),
        mib_per_s(total, time).alias("mib_per_s"),
    )


def peak_rate(sweep: DataFrame) -> DataFrame:
    """Peak and mean rate of a size sweep and the smallest size at the peak."""
    return sweep.agg(
        F.max("mib_per_s").alias("peak_mib_per_s"),
        F.avg("mib_per_s").alias("avg_mib_per_s"),
        F.max_by("size", F.struct(F.col("mib_per_s"), -F.col("size"))).alias("size_at_peak"),
    )


def min_max_typical(
    df: DataFrame, value: str, by: Sequence[str]
) -> DataFrame:
    """Per group: iterations, minimum, maximum and typical (median) value."""
    wanted = {"t_min": 0.0, "t_max": 1.0, "t_typical": 0.5}
    return quantiles(df, by, value, wanted).withColumnRenamed(
        "n", "iterations"
    )


def compare_modes(
    requests: DataFrame, mode: Column, left: str, right: str
) -> DataFrame:
    """Each figure of two modes side by side, with the ratio right / left."""
    marked = requests.withColumn("mode", mode)
    basics = marked.groupBy("mode").agg(
        F.count(F.lit(1)).cast("double").alias("samples"),
        _mean_ms().alias("avg_ms"),
        F.stddev_pop(F.col("dur_us") / 1000).alias("stddev_ms"),
    )
    tails = quantiles(
        marked, ["mode"], "dur_us", {"low": 0.0, "p50": 0.5, "p99": 0.99, "top": 1.0}
    )
    both = basics.join(tails, same_keys(basics, tails, ["mode"])).drop(tails["mode"])
    figures = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), value.alias("value"))
            for name, value in {
                "samples": F.col("samples"),
                "avg_ms": F.col("avg_ms"),
                "stddev_ms": F.col("stddev_ms"),
                "min_ms": F.col("low") / 1000,
                "p50_ms": F.col("p50") / 1000,
                "p99_ms": F.col("p99") / 1000,
                "max_ms": F.col("top") / 1000,
            }.items()
        ]
    )
    sides = both.select("mode", F.inline(figures)).groupBy("metric").pivot("mode", [left, right])
    return sides.agg(F.first("value")).withColumn(
        "ratio", F.col(right) / F.nullif(F.col(left), F.lit(0.0))
    )


def all_ok(checks: DataFrame, by: Sequence[str], good: str) -> DataFrame:
    """Per group: is every check good, how many are, how many there are."""
    return checks.groupBy(*by).agg(
        F.bool_and(F.col(good)).alias("all_ok"),
        F.count_if(F.col(good)).alias("good"),
        F.count(F.lit(1)).alias("total"),
    )


def fanout_latency(leaf_times: DataFrame) -> DataFrame:
    """A request ends with its slowest leaf: latency of requests and leaves by fan-out."""
    per_request = stored_rows(
        leaf_times.groupBy("request").agg(
            F.count(F.lit(1)).alias("fanout"), F.max("t").alias("t_request")
        ),
        "requests",
    )
    sizes = per_request.select("request", F.col("fanout").alias("rows"))
    # Percentiles only need how often a value occurs, so the leaves are kept as counted pairs.
    leaves = split_join(leaf_times, per_request.select("request", "fanout"), ["request"], sizes)
    counted = leaves.groupBy("fanout", "t").agg(F.count(F.lit(1)).alias("n"))
    counted = stored_rows(counted, "leaves")
    means = per_request.groupBy("fanout").agg(
        F.count(F.lit(1)).alias("requests"),
        (F.sum(F.col("t_request").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias(
            "mean_request"
        ),
    )
    # Both percentiles in one pass.
    whole = per_request.select("fanout", F.lit("request").alias("kind"), F.col("t_request").alias("t"), F.lit(1).cast("bigint").alias("n"))
    every = whole.unionByName(counted.withColumn("kind", F.lit("leaf")))
    found = quantiles(every, ["fanout", "kind"], "t", {"p99": 0.99}, weight="n")
    sides = [F.max(F.when(F.col("kind") == k, F.col("p99"))).alias(f"p99_{k}") for k in ("request", "leaf")]
    return means.join(found.groupBy("fanout").agg(*sides), "fanout")


def concurrency_profile(requests: DataFrame) -> DataFrame:
    """Per label: highest and mean number of requests in flight.

    A request counts from its start up to, and without, its end.  Starts and ends
    at one instant are added up first, so the running sum sees each instant once.
    """
    moves = requests.select(
        "label",
        F.inline(
            F.array(
                F.struct(F.col("start_us").alias("t"), F.lit(1).alias("delta")),
                F.struct(_end_us().alias("t"), F.lit(-1).alias("delta")),
            )
        ),
    )
    steps = moves.groupBy("label", "t").agg(F.sum("delta").alias("delta"))
    level = running(
        steps, ["label"], ["t"], sums={"in_flight": F.col("delta")}, measure=moves
    )
    peaks = level.groupBy("label").agg(F.max("in_flight").alias("peak"))
    means = requests.groupBy("label").agg(
        F.count(F.lit(1)).alias("requests"),
        (F.sum("dur_us") / F.nullif(_run_us(), F.lit(0))).alias("mean_in_flight"),
    )
    return means.join(peaks, same_keys(means, peaks, ["label"])).drop(peaks["label"])


def rate_report(requests: DataFrame, qps: float) -> DataFrame:
    """Per minute: requests offered at ``qps`` per second, achieved, and their ratio."""
    target = offered_rate(qps)
    minutes = requests.groupBy(bucket_ms(F.col("start_us"), 60_000).alias("minute_ms")).agg(
        F.count(F.lit(1)).alias("achieved")
    )
    return minutes.select(
        "minute_ms",
        F.lit(target).alias("offered"),
        "achieved",
        (F.col("achieved") / F.lit(target)).alias("ratio"),
    )


def offered_rate(qps: float, minutes: float = 1.0, users: int = 1) -> float:
    """Requests that each of ``users`` has to send in ``minutes`` to offer ``qps``."""
    return qps * 60 * minutes / users


def gc_pauses(lines: DataFrame, pattern: str) -> DataFrame:
    """Per node: number, total and longest of the pauses (seconds) in its log lines."""
    seconds = F.regexp_extract("line", pattern, 1).cast("decimal(18,7)")
    pauses = lines.where(F.col("line").rlike(pattern)).select("node", seconds.alias("secs"))
    return pauses.groupBy("node").agg(
        F.count(F.lit(1)).alias("pauses"),
        F.sum("secs").cast("double").alias("total_s"),
        F.max("secs").cast("double").alias("max_s"),
    )
