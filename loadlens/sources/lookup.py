"""Record tables for point reads: a small batch of keys reads a few row groups, however large the table.

Rows are range partitioned and sorted by key, so each file has a range of keys of its own, and row groups
are small.  A table of ranges, one row per file, is kept next to the files; a key column's Bloom filter tells row groups
that lack a key inside their range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS_PER_FILE = 4_000_000
#: Bytes of a row group, before compression.
GROUP_BYTES = 1 << 20
#: Keys of a batch that go into the filter of a scan; more are joined.
LITERALS = 200


def store_records(df: DataFrame, path: str, key: str, rows_per_file: int = ROWS_PER_FILE, group_bytes: int = GROUP_BYTES) -> None:
    """Write records sorted by key, in files of about ``rows_per_file`` rows, and the ranges of the files.

    Rows without a key cannot be asked for; they are kept in the first file.
    """
    spark = df.sparkSession
    files = max(1, -(-df.count() // rows_per_file))
    placed = df.repartitionByRange(files, key).sortWithinPartitions(key)
    writer = placed.write.mode("overwrite").option("parquet.block.size", group_bytes)
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option("parquet.page.size", max(1024, group_bytes // 16)).parquet(f"{path}/records")
    stored = spark.read.parquet(f"{path}/records").select(key, F.col("_metadata.file_path").alias("file"))
    ranges = stored.groupBy("file").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def _any_of(column: Column, values: Sequence) -> Column:
    """``column`` equals one of ``values``, as comparisons that a scan can check against Bloom filters."""
    if len(values) == 1:
        return column == F.lit(values[0])
    middle = len(values) // 2
    return _any_of(column, values[:middle]) | _any_of(column, values[middle:])


def read_records(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """The records of a small batch of keys (repeats and NULL count for nothing).

    The files whose range has a key are opened, at most one for each key unless a key is on several.  Up to ``LITERALS`` keys
    are put into the scan's filter, which skips row groups by range and Bloom filter; a larger batch is
    joined with all of those files.
    """
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in asked.limit(LITERALS + 1).collect()]
    table = spark.read.parquet(f"{path}/records")
    if not few:
        return table.limit(0)
    if len(few) > LITERALS:
        return table.join(asked, key, "left_semi")
    ranges = spark.read.parquet(f"{path}/ranges")
    inside = reduce(lambda a, b: a | b, [F.lit(k).between(F.col("low"), F.col("high")) for k in few])
    files = [r[0] for r in ranges.where(inside).select("file").collect()]
    if not files:
        return table.limit(0)
    return spark.read.schema(table.schema).parquet(*files).where(_any_of(F.col(key), few))
