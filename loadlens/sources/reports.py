"""Benchmark reports: titled sections of text that hold small tables and figures.

A title stands between two rules of ``RULE_WIDTH`` dashes, below a blank line.
Some table rows have the same shape, so a row is read by the table header above
it.  Both are carried down the lines of a file by ``running``, which copes with a
very long file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loadlens.functions.joins import checked_join
from loadlens.functions.lineage import stored_rows
from loadlens.functions.ordered import group_limit, group_sizes, running
from loadlens.sources.files import number_lines, read_lines

# Forms of the lines of a report.  Each form has the text its table
# header must contain (or None), a text the line must contain (looked for first, as
# it costs less than the pattern), a pattern, the key (a group of the pattern or a
# text) and, per figure, its name, group and unit (a text or a group).
RULE_WIDTH = 47
# Lines of a file that is not cut, line numbers in a chunk of a longer one, and bytes of lines in a task.
WHOLE_ROWS, CHUNK_LINES, TASK_BYTES = 1 << 18, 1 << 16, 64 << 20
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
GAP = r"\s+"
TABLE_HEADER = r"^\s*(?:#bytes|\[ ID\] Interval)"
FORMS = [
    (
        "t_min",
        "",
        r"^\s*" + GAP.join([NUMBER] * 5) + r"\s*$",
        1,
        [
            ("iterations", 2, "count"),
            ("latency_min", 3, "usec"),
            ("latency_max", 4, "usec"),
            ("latency_typical", 5, "usec"),
        ],
    ),
    (
        "BW peak",
        "",
        r"^\s*" + GAP.join([NUMBER] * 5) + r"\s*$",
        1,
        [
            ("iterations", 2, "count"),
            ("bandwidth_peak", 3, "MB/sec"),
            ("bandwidth_average", 4, "MB/sec"),
            ("message_rate", 5, "Mpps"),
        ],
    ),
    (
        "#repetitions",
        "",
        r"^\s*" + GAP.join([NUMBER] * 4) + r"\s*$",
        1,
        [("repetitions", 2, "count"), ("time", 3, "usec"), ("rate", 4, "Mbytes/sec")],
    ),
    (
        None,
        " bytes in ",
        NUMBER + r" bytes in " + NUMBER + r" seconds = " + NUMBER + r" Mbit/sec",
        1,
        [("seconds", 2, "sec"), ("pingpong_rate", 3, "Mbit/sec")],
    ),
    (
        None,
        " iters in ",
        NUMBER + r" iters in " + NUMBER + r" seconds = " + NUMBER + r" usec/iter",
        1,
        [("seconds", 2, "sec"), ("pingpong_time", 3, "usec/iter")],
    ),
    (
        None,
        " sec ",
        r"\[\s*([0-9]+|SUM)\]\s+[0-9.]+-\s*[0-9.]+ sec\s+" + NUMBER + r" ([KMGT]?Bytes)\s+"
        + NUMBER + r" ([KMGT]?bits/sec)",
        1,
        [("transfer", 2, 3), ("bandwidth", 4, 5)],
    ),
    (
        None,
        "RunTime=",
        r"\[(Total Run|Valid Duration)\] RunTime=" + NUMBER + r" sec; SentMessages=" + NUMBER
        + r"; ReceivedMessages=" + NUMBER,
        1,
        [("run_time", 2, "sec"), ("sent", 3, "count"), ("received", 4, "count")],
    ),
    (
        None,
        "avg-lat=",
        r"avg-lat=\s*" + NUMBER + r" \(std-dev=" + NUMBER + r"\)",
        "valid",
        [("latency_average", 1, "usec"), ("latency_stddev", 2, "usec")],
    ),
    (
        None,
        " dropped messages ",
        r"# dropped messages = " + NUMBER + r"; # duplicated messages = " + NUMBER
        + r"; # out-of-order messages = " + NUMBER,
        "valid",
        [("dropped", 1, "count"), ("duplicated", 2, "count"), ("out_of_order", 3, "count")],
    ),
    (
        None,
        " observations",
        r"Total " + NUMBER + r" observations.*each percentile contains " + NUMBER,
        "valid",
        [("observations", 1, "count"), ("per_percentile", 2, "count")],
    ),
    (None, "percentile ", r"percentile\s+" + NUMBER + r" =\s*" + NUMBER, 1, [("percentile", 2, "usec")]),
    (None, "> observation", r"<(MAX|MIN)> observation =\s*" + NUMBER, 1, [("percentile", 2, "usec")]),
]


def _titled(lines: DataFrame, marks: dict[str, Column] | None = None) -> tuple[DataFrame, int | None]:
    """``with_titles`` with lines of a ``_chunk`` of a file in one task, and how many line numbers a chunk has.

    ``marks`` are further columns, taken from a line once, before the lines meet.

    Short files are one chunk (None).  Of a long one, rules and blank lines go to
    the chunks of the lines next to them, too, so a line meets all that decides about it.
    """
    spark = lines.sparkSession
    rows, _, _, all_bytes = group_sizes(lines, ["file"])
    size = None if rows <= min(WHOLE_ROWS, group_limit(spark)) else min(CHUNK_LINES, group_limit(spark))
    is_rule = F.col("line").rlike(f"^-{{{RULE_WIDTH}}}$")
    is_blank = F.trim("line") == ""
    own = F.lit(0).cast("bigint") if size is None else F.floor(F.col("line_no") / size)
    dealt = lines.withColumns({"_rule": is_rule, "_blank": is_blank, **(marks or {})})
    is_rule, is_blank = F.col("_rule"), F.col("_blank")
    if size is None:
        dealt = dealt.withColumn("_chunk", own)
    else:
        near = [F.floor((F.col("line_no") + step) / size) for step in (0, -1, 1, 2)]
        edge = (is_rule | is_blank) & ((near[1] < own) | (near[3] > own))
        dealt = dealt.withColumn("_chunk", F.explode(F.when(edge, F.array_distinct(F.array(*near))).otherwise(F.array(own))))
    dealt = dealt.repartition(max(1, -(-all_bytes // TASK_BYTES)), "file", "_chunk")
    span = Window.partitionBy("file", "_chunk").orderBy("line_no")

    def seen(what: Column, step: int) -> Column:
        return F.coalesce(F.max(what).over(span.rangeBetween(step, step)), F.lit(False))

    marked = dealt.withColumns({"_opened": seen(is_rule, -1), "_closed": seen(is_rule, 1), "_gap": seen(is_blank, -2)})
    is_title = F.col("_opened") & F.col("_closed") & (F.col("_gap") | (F.col("line_no") == 2))
    is_title = is_title & ~is_rule & ~is_blank & F.col("file").isNotNull() & F.col("line_no").isNotNull()
    titled = marked.withColumn("title", F.when(is_title, F.trim("line"))).drop("_opened", "_closed", "_gap", "_rule", "_blank")
    return titled.where(F.col("_chunk").eqNullSafe(own)), size


def with_titles(lines: DataFrame) -> DataFrame:
    """Add ``title``: the text of a title line, NULL on all others.

    ``lines`` has ``file``, ``line_no`` and ``line``.  No file has to be in one task.
    """
    return _titled(lines)[0].drop("_chunk")


def fill_sections(
    lines: DataFrame, title: str = "title"
) -> DataFrame:
    """Give each line the last title at or above it in its file, as ``section``."""
    return running(
        lines, ["file"], ["line_no"], lasts={"section": F.col(title)}
    )


def _figures(
    header: str | None, text: str, pattern: str, key: int | str, figures: list
) -> Column:
    """The figures of a line of one form, NULL on other lines."""

    def group(i: int) -> Column:
        return F.regexp_extract("line", pattern, i)

    rows = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                (group(key) if isinstance(key, int) else F.lit(key)).alias("key"),
                group(value).cast("double").alias("value"),
                (group(unit) if isinstance(unit, int) else F.lit(unit)).alias("unit"),
            )
            for metric, value, unit in figures
        ]
    )
    fits = _fits(text, pattern)
    if header is not None:
        fits = F.contains("header", F.lit(header)) & fits
    return F.when(fits, rows)


def _fits(text: str, pattern: str) -> Column:
    """True for a line of a form, whatever its table."""
    return F.contains("line", F.lit(text)) & F.col("line").rlike(pattern)


def report_rows(lines: DataFrame) -> DataFrame:
    """Figures of numbered report lines, one row each.

    ``table_no`` counts the table headers of a file: a section that prints one
    table for each side keeps both apart.  Figures without a table are printed by both
    sides as well, so ``occurrence`` counts the same figure from 1 in order of lines:
    file, section, table_no, metric, key and occurrence name one row.
    """
    may = reduce(lambda a, b: a | b, [_fits(text, pattern) for _, text, pattern, *_ in FORMS])
    titled, size = _titled(lines, {"_table": F.col("line").rlike(TABLE_HEADER), "_may": F.coalesce(may, F.lit(False))})
    is_header = F.col("_table")
    header = F.when(is_header, F.col("line")).when(F.col("title").isNotNull(), F.lit(""))
    span = Window.partitionBy("file", "_chunk").orderBy("line_no")
    so_far = span.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = titled.withColumns({
        "table_no": F.coalesce(F.sum(is_header.cast("bigint")).over(so_far), F.lit(0)),
        "section": F.last("title", ignorenulls=True).over(so_far),
        "header": F.last(header, ignorenulls=True).over(so_far),
        "_end": F.lead(F.lit(1)).over(span).isNull(),
    })
    # Of all lines only those that may hold figures are kept, and each chunk's last one with what it hands on.
    may = F.col("_may")
    local = local.withColumn("line", F.when(may, F.col("line"))).where(may | F.col("_end"))
    placed = local.select("file", "_chunk", "line_no", "line", "table_no", "section", "header", "_end")
    if size is not None:
        placed = _carried(stored_rows(placed, "sections"))
    found = reduce(lambda a, b: F.coalesce(a, b), [_figures(*form) for form in FORMS])
    rows = stored_rows(placed.select("file", "section", "line_no", "table_no", F.inline(found)), "figures")
    same = ["file", "section", "table_no", "metric", "key"]
    return running(rows, same, ["line_no"], sums={"occurrence": F.lit(1).cast("bigint")})


def _carried(local: DataFrame) -> DataFrame:
    """Lines with the tables, section and header of their chunk alone, and those of the chunks before it added."""
    ends = local.where("_end").select("file", "_chunk", "table_no", "section", "header")
    before = running(
        ends,
        ["file"],
        ["_chunk"],
        sums={"_tables": F.col("table_no")},
        lasts={"_section": F.col("section"), "_header": F.col("header")},
        before=True,
    ).drop("table_no", "section", "header")
    # A line without file or number is alone in its chunk's group and hands nothing on.
    sizes = local.groupBy("file", "_chunk").agg(F.count(F.lit(1)).alias("rows"))
    joined = checked_join(local.where("line IS NOT NULL"), before, ["file", "_chunk"], sizes, "left")
    return joined.withColumns({
        "table_no": F.col("table_no") + F.coalesce("_tables", F.lit(0)),
        "section": F.coalesce("section", "_section"),
        "header": F.coalesce("header", "_header"),
    })


def parse_perf_report(spark: SparkSession, path: str) -> DataFrame:
    """Figures of all reports below ``path``."""
    return report_rows(number_lines(read_lines(spark, path)))
