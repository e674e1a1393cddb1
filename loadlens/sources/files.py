"""Readers and writers of the text forms the workloads exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loadlens.functions.joins import checked_join
from loadlens.functions.lineage import cut, stored_rows
from loadlens.functions.ordered import running
from loadlens.functions.text import parse_instant

# Column layout of the input and result files.
ARTICLE_COLUMNS = ("id", "title", "changed", "body", "plain")
PAGE_SCHEMA = (
    "id bigint, title string, revision struct<id:bigint, timestamp:string, "
    "contributor:struct<username:string, id:bigint>, text:string>"
)
DOCUMENT_SCHEMA = "id string, text string"
RESULT_SCHEMA = (
    "timeStamp bigint, elapsed bigint, label string, responseCode string, "
    "responseMessage string, threadName string, dataType string, success boolean, "
    "bytes bigint, URL string, Latency bigint"
)
MAP_SCHEMA = "host string, ip string"

# Columns that order the lines of a file.
PLACE = ("block", "row")


def read_articles_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated article dump: title and body of each line.

    Nothing is quoted or escaped in such a dump, so both are switched off.
    """
    schema = StructType([StructField(c, StringType()) for c in ARTICLE_COLUMNS])
    rows = spark.read.csv(
        path, schema=schema, sep="\t", quote="", escape="\u0000", comment="", header=False,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1,
    )
    return rows.select("title", "body")


def read_json_docs(
    spark: SparkSession,
    folder: str,
    schema: str = DOCUMENT_SCHEMA,
    whole_files: bool = False,
    names: str = "*json",
) -> DataFrame:
    """Documents of all ``*json`` files of a folder, with ``_broken`` and ``file``.

    By default a file has one JSON object per line and is read by many tasks.  With
    ``whole_files`` it is one JSON value, an array of objects or a single one that
    may go over many lines; such a file cannot be cut and is read by one task.

    What cannot be parsed is kept as ``_broken`` with NULL fields and the rest go on, so a
    caller can report the broken ones (``broken_docs``) and index the others.
    """
    rows = spark.read.json(
        folder, schema=f"{schema}, _broken string", pathGlobFilter=names, mode="PERMISSIVE",
        columnNameOfCorruptRecord="_broken", multiLine=whole_files,
    )
    return rows.withColumns({"file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})


def broken_docs(rows: DataFrame) -> DataFrame:
    """Broken documents per file."""
    # Spark wants one more column read besides the broken text; the length is never negative.
    other = next(c for c in rows.columns if c not in ("file", "_block", "_broken"))
    read = F.length(F.concat_ws("", F.col(other).cast("string"), "_broken")) >= 0
    return rows.where(F.col("_broken").isNotNull() & read).groupBy("file").agg(F.count(F.lit(1)).alias("broken"))


def last_docs(rows: DataFrame, key: str = "id") -> DataFrame:
    """The last document of each id, in order of file names and of places in a file.

    A later file replaces what an earlier one said; rows without id are left out.
    """
    place = F.struct("file", "_block", F.monotonically_increasing_id().alias("row"))
    values = [c for c in rows.columns if c not in (key, "file", "_block", "_broken")]
    placed = rows.where(F.col(key).isNotNull()).select(key, place.alias("_place"), F.struct(*values).alias("_values"))
    return placed.groupBy(key).agg(F.max_by("_values", "_place").alias("_values")).select(key, "_values.*")


def read_wiki_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``page`` element of a wiki dump, with its latest revision flat."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE_SCHEMA).load(path)
    return pages.select(
        "id",
        "title",
        F.col("revision.id").alias("revision"),
        F.col("revision.contributor.username").alias("user"),
        F.col("revision.contributor.id").alias("userId"),
        F.col("revision.text").alias("text"),
        parse_instant(F.col("revision.timestamp")).alias("timestamp"),
    )


def read_query_list(spark: SparkSession, path: str) -> DataFrame:
    """Request paths, one per line, numbered from 0 in order of files and lines."""
    lines = running(read_lines(spark, path), [], ["file", *PLACE], sums={"turn": F.lit(1)})
    return lines.select((F.col("turn") - 1).alias("query_id"), F.col("line").alias("path"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the file they are in and their place in it.

    Large files are read by many tasks.  The start of a task's block and the row
    order inside it give the order of lines without reading a file whole.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Number the lines of each file from 1.

    The lines are stored once and stay where they are: ``row`` counts on within a block, so a line's number follows from
    its block's first row and the lines of the blocks before it.  Lines of which some were left
    out after reading are numbered by ``running``.
    """
    lines = stored_rows(lines, "lines")
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"), F.max("row").alias("last"))
    blocks = cut(sizes)
    whole = F.col("file").isNotNull() & F.col("block").isNotNull() & (F.col("last") - F.col("first") + 1 == F.col("rows"))
    if not blocks.where(~F.coalesce(whole, F.lit(False))).isEmpty():
        numbered = running(lines, ["file"], PLACE, sums={"line_no": F.lit(1)})
        return numbered.select("file", "line_no", "line")
    before = running(blocks, ["file"], ["block"], sums={"before": F.col("rows")}, before=True)
    placed = checked_join(lines, before.select("file", "block", "first", "before"), ["file", "block"], blocks.select("file", "block", "rows"))
    return placed.select("file", (F.col("row") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")


def read_node_logs(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """Log lines of all node folders: the folder names the node.

    ``path`` is a pattern of files, whose folders the driver lists one by one, or, with ``names``, the folder above
    all node folders: these are then listed by tasks, and files that fit ``names`` are read.
    """
    file = F.col("_metadata.file_path")
    form = {} if names is None else {"recursiveFileLookup": True, "pathGlobFilter": names}
    return spark.read.options(**form).text(path).select(
        F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("node"),
        F.regexp_extract(file, r"([^/]+)$", 1).alias("file"),
        F.col("value").alias("line"),
    )


def json_map(lines: DataFrame) -> DataFrame:
    """Map of host to ip from JSON lines, as a table; the last line of a host wins.

    ``lines`` has ``line_no`` and ``line``.  A table in place of one map value lets
    the map grow with the hosts; join it where an entry is looked up.
    """
    entry = F.from_json("line", MAP_SCHEMA)
    entries = lines.select("line_no", entry.alias("entry")).where("entry.host IS NOT NULL")
    return entries.groupBy(F.col("entry.host").alias("host")).agg(
        F.max_by("entry.ip", "line_no").alias("ip")
    )


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """``json_map`` of a text file or of a folder of them; a later file name wins."""
    lines = read_lines(spark, path)
    return json_map(lines.select(F.struct("file", *PLACE).alias("line_no"), "line"))


def write_results_csv(df: DataFrame, path: str) -> None:
    """Result rows as CSV with a header; quotes inside a field are doubled."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue='""')


def read_results_csv(
    spark: SparkSession, path: str, schema: str = RESULT_SCHEMA, line_breaks: bool = False
) -> DataFrame:
    """Result rows written by ``write_results_csv`` or by a load test.

    Columns are taken by the names in the header, in any order; those that a file
    lacks are NULL and others are left out.  All files below ``path`` have the same
    header.  Many tasks read a large file; ``line_breaks=True`` says that quoted fields may
    hold line breaks, and then each file is read by one task.  An empty field is
    NULL and a quoted empty one a text; the marker for NULL only has to be something
    that no field holds.
    """
    form = {"header": True, "escape": '"', "nullValue": "\u0000", "multiLine": line_breaks}
    # The header is read, not the rows.
    named = spark.read.csv(path, inferSchema=False, **form)
    columns = [
        (F.col(f"`{f.name}`") if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in StructType.fromDDL(schema)
    ]
    return named.select(*columns)
