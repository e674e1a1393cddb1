"""Queries on keyed records."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.operators import records
from loadlens.plans.registry import query
from loadlens.plans.views import kv_base, kv_ops, table, with_views

WRITES = "op IN ('UPDATE', 'INSERT')"


@query(
    "kv_load",
    """
    SELECT 'user' || c_custkey AS key, """
    + ", ".join(
        f"left(repeat(md5('user' || c_custkey || ':field{i}'), 4), 100) AS field{i}"
        for i in range(10)
    )
    + " FROM customer",
)
def kv_load(spark, sf_dir):
    return records.load_records(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query(
    "kv_point_reads",
    """
    SELECT event_id AS seq, 'user' || user_id AS key, c_acctbal AS value,
           CASE WHEN c_custkey IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS read_status
    FROM events LEFT JOIN customer ON user_id * 13 = c_custkey""",
)
def kv_point_reads(spark, sf_dir):
    # Every 13th customer is asked for, so that some reads find no record.
    reads = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user"), F.col("user_id")).alias("asked"),
        F.concat(F.lit("user"), F.col("user_id") * 13).alias("key"),
    )
    return records.point_reads(reads, kv_base(spark, sf_dir)).select(
        "seq", F.col("asked").alias("key"), "value", "read_status"
    )


@query(
    "kv_reads_as_of",
    with_views(
        "kv_ops kv_base",
        f"""
        WITH seen AS (
            SELECT seq, key, op,
                   last_value(CASE WHEN {WRITES} THEN value END IGNORE NULLS) OVER (
                       PARTITION BY key ORDER BY ts, seq
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written
            FROM kv_ops)
        SELECT seq, seen.key, coalesce(written, kv_base.value) AS value,
               CASE WHEN written IS NOT NULL THEN 'WRITE'
                    WHEN kv_base.key IS NOT NULL THEN 'LOAD' ELSE 'NOT_FOUND' END AS origin
        FROM seen LEFT JOIN kv_base ON seen.key = kv_base.key
        WHERE op = 'READ'""",
    ),
)
def kv_reads_as_of(spark, sf_dir):
    return records.reads_as_of(kv_ops(spark, sf_dir), kv_base(spark, sf_dir))


FINAL_STATE = with_views(
    "kv_ops kv_base",
    f"""
    WITH written AS (
        SELECT key, arg_max(value, (ts, seq)) AS value, count(*) AS writes
        FROM kv_ops WHERE {WRITES} GROUP BY key)
    SELECT coalesce(written.key, kv_base.key) AS key,
           CASE WHEN written.key IS NULL THEN kv_base.value ELSE written.value END AS value,
           coalesce(writes, 0) AS writes
    FROM written FULL JOIN kv_base ON written.key = kv_base.key""",
)


@query("kv_final_state", FINAL_STATE)
def kv_final_state(spark, sf_dir):
    return records.final_state(kv_ops(spark, sf_dir), kv_base(spark, sf_dir))


@query(
    "new_keys",
    """
    SELECT DISTINCT l_partkey, l_suppkey FROM lineitem
    EXCEPT
    SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'""",
)
def new_keys(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    returned = items.where(F.col("l_returnflag") == "R")
    return records.new_keys(items, returned, ["l_partkey", "l_suppkey"])
