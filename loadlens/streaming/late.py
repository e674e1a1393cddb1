"""Counts of closed windows, with rows that come too late kept in a table of their own.

A window is closed when it ends at or before the mark: the latest time seen in the
batches before, less the delay.  The mark of each batch is stored with its results, so a repeated batch
decides as it did the first time.  Spark's own windows drop such rows without a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from loadlens.streaming import replay

COUNTS = StructType([StructField("window_start", TimestampType()), StructField("records", LongType())])
MARK = "mark"


def _end(start: Column, width_s: int) -> Column:
    return F.unix_seconds(start) + width_s


def _start(ts: Column, width_s: int) -> Column:
    second = F.unix_seconds(ts)
    return F.timestamp_seconds(second - F.pmod(second, F.lit(width_s)))


def count_with_late(stream: DataFrame, ts: str, width_s: int, delay_s: int, folder: str, merge_every: int = replay.MERGE_EVERY) -> None:
    """Run ``stream`` over all that is available: counts per window and late rows go below ``folder``.

    Rows without a time are late: no window has them.
    """
    combine = replay.added_up(COUNTS, ["window_start"])

    def store(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        mark = _mark(spark, folder, batch)
        start = _start(F.col(ts), width_s)
        closed = F.col(ts).isNull() | (_end(start, width_s) <= mark if mark is not None else F.lit(False))
        rows.where(closed).write.mode("overwrite").parquet(f"{folder}/late/{replay.BATCH}={batch}")
        counts = rows.where(~closed).groupBy(start.alias("window_start")).agg(F.count(F.lit(1)).alias("records"))
        replay.store_batch(counts, batch, f"{folder}/counts", COUNTS, combine, merge_every)
        newest = F.max(F.unix_seconds(ts)) - delay_s
        rows.agg(F.greatest(newest, F.lit(mark).cast("bigint")).alias(MARK)).write.mode("overwrite").parquet(f"{folder}/marks/{replay.BATCH}={batch}")
        replay._drop(spark, [f"{folder}/marks/{replay.BATCH}={n}" for n in replay._numbers(spark, f"{folder}/marks") if n < batch - 1])

    replay.with_hook(stream, store, f"{folder}/progress").awaitTermination()


def _mark(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    """Mark of the last batch, or of the one before a given batch, in seconds."""
    known = [n for n in replay._numbers(spark, f"{folder}/marks") if before is None or n < before]
    return spark.read.parquet(f"{folder}/marks/{replay.BATCH}={known[-1]}").first()[0] if known else None


def closed_counts(spark: SparkSession, folder: str, width_s: int, closed: bool = True) -> DataFrame:
    """window_start and records of the closed windows, which never change, or of the open ones."""
    table = replay.stored_state(spark, f"{folder}/counts", COUNTS, replay.added_up(COUNTS, ["window_start"])).drop(replay.BATCH)
    mark = _mark(spark, folder)
    done = F.lit(False) if mark is None else _end(F.col("window_start"), width_s) <= mark
    return table.where(done if closed else ~done)


def late_rows(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Rows that came after their window was closed."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not replay._numbers(spark, f"{folder}/late"):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(f"{folder}/late")
