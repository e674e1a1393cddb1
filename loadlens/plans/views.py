"""Views that put the test tables into the shapes the workloads use.

Each view exists twice: as a DataFrame and, in ``SQL``, as the text of the same
view for the SQL checks.  ``with_views`` puts the needed ones before a statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens.functions.text import tokens_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table.  Times in the files have no zone and are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from(table(spark, sf_dir, "events"))


def requests_from(events: DataFrame) -> DataFrame:
    """Request log: one row per event; ``value`` is a latency in milliseconds."""
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("seq"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("start_us"),
        F.round(F.col("value") * 1000).cast("bigint").alias("dur_us"),
        F.col("value").alias("elapsed_ms"),
        F.col("event_type").alias("label"),
        F.col("user_id").alias("flow"),
        (F.col("event_type") != "error").alias("success"),
        F.length("props").cast("bigint").alias("bytes"),
    )


def kv_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_ops_from(requests(spark, sf_dir))


def kv_ops_from(log: DataFrame) -> DataFrame:
    """Operations on keyed records: reads, updates (click) and inserts (signup)."""
    op = (
        F.when(F.col("label") == "click", "UPDATE")
        .when(F.col("label") == "signup", "INSERT")
        .otherwise("READ")
    )
    return log.select(
        "seq",
        "ts",
        "start_us",
        "dur_us",
        op.alias("op"),
        F.concat(F.lit("user"), F.col("flow")).alias("key"),
        F.col("elapsed_ms").alias("value"),
        F.when(F.col("success"), "OK").otherwise("ERROR").alias("status"),
    )


def kv_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records loaded before the operations run."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user"), F.col("c_custkey")).alias("key"),
        F.col("c_acctbal").alias("value"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in both directions between customers and their suppliers."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = (
        orders.join(items, orders.o_orderkey == items.l_orderkey)
        .select(
            F.concat(F.lit("C"), F.col("o_custkey")).alias("a"),
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("b"),
        )
        .distinct()
    )
    return pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
            )
        )
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query list: all words of each ``benchmark`` text."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        F.col("item_id").alias("query_id"),
        tokens_of(F.col("text")).alias("terms"),
    )


def leaf_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the leaves of a request: order -> suppliers."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(
        F.col("l_orderkey").alias("request"), F.col("l_suppkey").alias("leaf")
    ).agg(F.max("l_extendedprice").alias("t"))


SQL = {
    "requests": """
        SELECT event_id AS seq, ts, epoch_us(ts) AS start_us,
               CAST(round(value * 1000) AS BIGINT) AS dur_us, value AS elapsed_ms,
               event_type AS label, user_id AS flow, event_type <> 'error' AS success,
               CAST(length(props) AS BIGINT) AS bytes
        FROM events""",
    "kv_ops": """
        SELECT seq, ts, start_us, dur_us,
               CASE label WHEN 'click' THEN 'UPDATE' WHEN 'signup' THEN 'INSERT'
                          ELSE 'READ' END AS op,
               'user' || flow AS key, elapsed_ms AS value,
               CASE WHEN success THEN 'OK' ELSE 'ERROR' END AS status
        FROM requests""",
    "kv_base": """
        SELECT 'user' || c_custkey AS key, c_acctbal AS value FROM customer""",
    "pairs": """
        SELECT DISTINCT 'C' || o_custkey AS a, 'S' || l_suppkey AS b
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "edges": """
        SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs""",
    "words": """
        SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws
        FROM documents""",
    "tokens": """
        SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos,
               len(ws) AS doc_len
        FROM words""",
    "index": """
        SELECT term, doc_id, count(*) AS tf, min(pos) AS first_pos, max(doc_len) AS doc_len
        FROM tokens GROUP BY term, doc_id""",
    "search_queries": """
        SELECT item_id AS query_id,
               regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS terms
        FROM benchmark""",
    "leaf_times": """
        SELECT l_orderkey AS request, l_suppkey AS leaf, max(l_extendedprice) AS t
        FROM lineitem GROUP BY ALL""",
}

NEEDS = {
    "kv_ops": ("requests",),
    "edges": ("pairs",),
    "tokens": ("words",),
    "index": ("tokens",),
}


def with_views(names: str, statement: str) -> str:
    """Put the named views, and the views those need, before a statement."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, ()):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    views = ",\n".join(f"{name} AS ({SQL[name]})" for name in ordered)
    body = statement.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
