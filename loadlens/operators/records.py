"""Keyed records: loading, reads, and replay of an operation log.

An operation has ``key``, ``op``, ``value``, ``ts`` and a unique ``seq``; updates
and inserts are writes.  Order is (``ts``, ``seq``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.functions.joins import split_join
from loadlens.functions.ordered import running

# Operations that change a record, and the size of a record.
WRITES = ("UPDATE", "INSERT")
FIELD_COUNT = 10
FIELD_LENGTH = 100


def _is_write() -> Column:
    return F.col("op").isin(*WRITES)


def load_records(numbers: DataFrame, number: str, fields: int = FIELD_COUNT) -> DataFrame:
    """Load phase: one record per number, with fields filled from its MD5."""

    def field(i: int) -> Column:
        text = F.concat(F.lit("user"), F.col(number).cast("string"), F.lit(f":field{i}"))
        return F.left(F.repeat(F.md5(text.cast("binary")), 4), F.lit(FIELD_LENGTH))

    return numbers.select(
        F.concat(F.lit("user"), F.col(number).cast("string")).alias("key"),
        *[field(i).alias(f"field{i}") for i in range(fields)],
    )


def point_reads(reads: DataFrame, records: DataFrame) -> DataFrame:
    """Batch of reads by key; a key without a record gives ``NOT_FOUND``.

    Records are unique by key, so the join never multiplies rows.  Reads are counted per
    key first: a very popular record is joined in blocks, also where the records come
    placed by key and adaptive execution could not split them.
    """
    found = records.withColumn("is_found", F.lit(True))
    sizes = reads.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    return (
        split_join(reads, found, ["key"], sizes, "left")
        .withColumn("read_status", F.when(F.col("is_found"), "OK").otherwise("NOT_FOUND"))
        .drop("is_found")
    )


def reads_as_of(ops: DataFrame, records: DataFrame) -> DataFrame:
    """Value each read sees: the last write before it, else the loaded value.

    The written value travels in a struct, so a write of NULL counts as a write.
    """
    written = F.when(_is_write(), F.struct(F.col("value").alias("value")))
    log = ops.select("key", "ts", "seq", "op", "value")
    seen = running(
        log, ["key"], ["ts", "seq"], lasts={"written": written}, before=True
    ).where(F.col("op") == "READ")
    loaded = records.select("key", F.struct(F.col("value").alias("value")).alias("loaded"))
    return seen.join(loaded, "key", "left").select(
        "seq",
        "key",
        F.coalesce("written", "loaded")["value"].alias("value"),
        F.when(F.col("written").isNotNull(), "WRITE")
        .when(F.col("loaded").isNotNull(), "LOAD")
        .otherwise("NOT_FOUND")
        .alias("origin"),
    )


def last_writes(ops: DataFrame) -> DataFrame:
    """Last write per key; partial results meet key by key before the shuffle."""
    return ops.where(_is_write()).groupBy("key").agg(
        F.max_by(F.struct("value"), F.struct("ts", "seq")).alias("written"),
        F.count(F.lit(1)).alias("writes"),
    )


def apply_writes(written: DataFrame, records: DataFrame) -> DataFrame:
    """Loaded records after the last writes; unwritten keys keep the loaded value."""
    loaded = records.select("key", F.struct(F.col("value").alias("value")).alias("loaded"))
    return written.join(loaded, "key", "full").select(
        "key",
        F.coalesce("written", "loaded")["value"].alias("value"),
        F.coalesce("writes", F.lit(0)).alias("writes"),
    )


def final_state(ops: DataFrame, records: DataFrame) -> DataFrame:
    """Records after replay of a whole log: last write wins."""
    return apply_writes(last_writes(ops), records)


def key_popularity(ops: DataFrame) -> DataFrame:
    """Operations per key, rank by popularity and cumulative share of all operations."""
    counts = ops.groupBy("key").agg(F.count(F.lit(1)).alias("ops"))
    ranked = running(
        counts, [], [F.col("ops").desc(), F.col("key")],
        sums={"rank": F.lit(1), "ops_so_far": F.col("ops")}, measure=ops,
    )
    total = ops.select(F.count(F.lit(1))).scalar()
    return ranked.select(
        "key", "ops", "rank", (F.col("ops_so_far") / total).alias("cumulative_share")
    )


def op_mix(ops: DataFrame) -> DataFrame:
    """Share of each operation."""
    counts = ops.groupBy("op").agg(F.count(F.lit(1)).alias("ops"))
    # One row per operation is left.
    total = F.sum("ops").over(Window.partitionBy())
    return counts.withColumn("share", F.col("ops") / total)


def new_keys(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys wanted and not present yet: what an insert batch has to add."""
    return wanted.select(*keys).distinct().join(present.select(*keys), keys, "left_anti")
