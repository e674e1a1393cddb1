"""Queries that write the test tables in a file form and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions import text
from loadlens.functions.lineage import cut, scratch_folder
from loadlens.functions.ordered import group_limit
from loadlens.operators import records, search
from loadlens.plans.registry import query, rounded
from loadlens.plans.relational import READY, ready_lines
from loadlens.plans.search import SHARDS
from loadlens.plans.views import documents, kv_base, requests, table, with_views
from loadlens.sources import files, lookup, reports, runs


@query(
    "articles_tsv",
    r"""
    SELECT url AS title, regexp_replace(html, '[\t\r\n]', ' ', 'g') AS body FROM pages""",
)
def articles_tsv(spark, sf_dir):
    folder = scratch_folder(spark, "articles")
    body = F.regexp_replace("html", r"[\t\r\n]", " ")
    pages = table(spark, sf_dir, "pages")
    line = F.concat_ws("\t", "page_id", "url", F.lit("2024-01-01"), body, F.lit("text"))
    pages.select(line).write.text(folder)
    return files.read_articles_tsv(spark, folder)


@query(
    "json_docs",
    "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, n_chars, 0 AS broken FROM documents",
)
def json_docs(spark, sf_dir):
    lines, arrays = scratch_folder(spark, "documents"), scratch_folder(spark, "documents")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    even = F.col("id").cast("bigint") % 2 == 0
    docs.where(even).write.json(lines)
    # The other half as files that are one array each, of about 100 documents.
    part = F.floor(F.col("id").cast("bigint") / 200)
    array = F.to_json(F.collect_list(F.struct("id", "text"))).alias("value")
    packed = docs.where(~even).groupBy(part.alias("part")).agg(array)
    packed.select("value").write.option("maxRecordsPerFile", 1).text(arrays)
    read = files.read_json_docs(spark, lines).unionByName(
        files.read_json_docs(spark, arrays, whole_files=True, names="*txt")
    )
    broken = files.broken_docs(read).agg(F.coalesce(F.sum("broken"), F.lit(0)).cast("int").alias("broken"))
    size = F.length("text").cast("bigint").alias("n_chars")
    found = files.last_docs(read).select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), size)
    # One row: the number of documents that could not be read.
    return found.crossJoin(F.broadcast(broken))


@query(
    "wiki_xml",
    """
    SELECT o_orderkey AS id, 'page ' || o_orderkey AS title, o_orderkey * 10 AS revision,
           'user' || o_custkey AS "user", o_custkey AS userId,
           '#REDIRECT [[' || o_orderpriority || ']] <&>' AS text,
           strftime(o_orderdate + INTERVAL 13 HOUR, '%Y-%m-%d %H:%M:%S') AS timestamp
    FROM orders""",
)
def wiki_xml(spark, sf_dir):
    folder = scratch_folder(spark, "wiki")
    at = F.timestamp_add("HOUR", F.lit(13), F.col("o_orderdate").cast("timestamp"))
    contributor = F.struct(
        F.concat(F.lit("user"), F.col("o_custkey")).alias("username"),
        F.col("o_custkey").alias("id"),
    )
    revision = F.struct(
        (F.col("o_orderkey") * 10).alias("id"),
        F.date_format(at, text.ISO_INSTANT).alias("timestamp"),
        contributor.alias("contributor"),
        F.concat(F.lit("#REDIRECT [["), F.col("o_orderpriority"), F.lit("]] <&>")).alias("text"),
    )
    pages = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("page "), F.col("o_orderkey")).alias("title"),
        F.col("o_orderkey").alias("id"),
        revision.alias("revision"),
    )
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(folder)
    pages = files.read_wiki_xml(spark, folder)
    return pages.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query(
    "query_list",
    r"""
    SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id,
           array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') AS terms
    FROM benchmark""",
)
def query_list(spark, sf_dir):
    folder = scratch_folder(spark, "queries")
    path = F.concat(F.lit("/select?df=text&fl=id&q="), F.url_encode("text"))
    items = table(spark, sf_dir, "benchmark").orderBy("item_id")
    items.select(path).write.text(folder)
    listed = files.read_query_list(spark, folder)
    return listed.select(
        "query_id", F.array_join(text.request_terms(F.col("path")), " ").alias("terms")
    )


NODES_PER_TASK = 250


@query(
    "node_logs",
    with_views(
        "requests",
        """
        SELECT 'node=' || flow AS node, count(*) AS lines,
               count(*) FILTER (label = 'signup' AND floor(elapsed_ms) >= 100) AS ready_lines
        FROM requests GROUP BY flow""",
    ),
)
def node_logs(spark, sf_dir):
    folder = scratch_folder(spark, "logs")
    lines = ready_lines(requests(spark, sf_dir)).select("node", "line")
    # A node has one file; only a busy one is spread by its lines over several writers.
    limit = group_limit(spark)
    sizes = lines.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > limit)
    # At most all lines divided by the limit.
    busy = F.broadcast(sizes.select("node", F.ceil(F.col("rows") / limit).alias("writers")))
    writer = F.pmod(F.xxhash64("line"), F.coalesce("writers", F.lit(1))).alias("writer")
    spread = lines.join(busy, "node", "left").select("node", "line", writer)
    # Writing a folder costs much more than its lines, so tasks are dealt by the number of nodes.
    nodes = lines.agg(F.count_distinct("node")).first()[0]
    tasks = max(1, -(-nodes // NODES_PER_TASK))
    spread.repartition(tasks, "node", "writer").drop("writer").write.partitionBy("node").text(folder)
    logs = files.read_node_logs(spark, folder, "*.txt")
    return logs.groupBy("node").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("line").rlike(READY)).alias("ready_lines"),
    )


@query(
    "results_csv",
    with_views(
        "requests",
        """
        SELECT start_us // 1000 AS "timeStamp", dur_us AS elapsed, label,
               CASE WHEN success THEN '200' ELSE '500' END AS "responseCode",
               'said "' || label || '", twice' AS "responseMessage",
               'thread-' || flow AS "threadName", 'text' AS "dataType", success, bytes,
               '/select?q=' || seq AS "URL", dur_us AS "Latency"
        FROM requests""",
    ),
)
def results_csv(spark, sf_dir):
    folder = scratch_folder(spark, "results")
    rows = requests(spark, sf_dir).select(
        F.floor(F.col("start_us") / 1000).alias("timeStamp"),
        F.col("dur_us").alias("elapsed"),
        "label",
        F.when(F.col("success"), "200").otherwise("500").alias("responseCode"),
        F.concat(F.lit('said "'), F.col("label"), F.lit('", twice')).alias("responseMessage"),
        F.concat(F.lit("thread-"), F.col("flow")).alias("threadName"),
        F.lit("text").alias("dataType"),
        "success",
        "bytes",
        F.concat(F.lit("/select?q="), F.col("seq")).alias("URL"),
        F.col("dur_us").alias("Latency"),
    )
    files.write_results_csv(rows, folder)
    return files.read_results_csv(spark, folder)


@query(
    "stored_runs",
    """
    SELECT 'second' AS run_ts, l_returnflag, count(*) AS items FROM lineitem
    WHERE l_linestatus = 'O' GROUP BY l_returnflag""",
)
def stored_runs(spark, sf_dir):
    folder = scratch_folder(spark, "runs")
    items = table(spark, sf_dir, "lineitem")
    for run, status in (("first", "F"), ("second", "O")):
        report = items.where(F.col("l_linestatus") == status).groupBy("l_returnflag")
        runs.write_run(report.agg(F.count(F.lit(1)).alias("items")), folder, run)
    return runs.read_latest(spark, folder)


@query(
    "kv_table",
    """
    SELECT event_id AS seq, 'user' || user_id AS key, c_acctbal AS value, 'OK' AS read_status
    FROM events JOIN customer ON user_id = c_custkey""",
)
def kv_table(spark, sf_dir):
    folder = scratch_folder(spark, "records")
    name = "records_" + folder[-32:]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = runs.create_kv_table(kv_base(spark, sf_dir), name, buckets, path=folder)
    reads = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user"), F.col("user_id")).alias("key")
    )
    try:
        return cut(records.point_reads(reads, stored))
    finally:
        spark.sql(f"DROP TABLE {name}")


@query(
    "stored_index",
    with_views(
        "index",
        f"""
        SELECT ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % {SHARDS} AS shard,
               count(*) AS postings, CAST(sum(tf) AS BIGINT) AS words,
               count(DISTINCT doc_id) AS docs
        FROM index GROUP BY ALL""",
    ),
)
def stored_index(spark, sf_dir):
    folder = scratch_folder(spark, "index")
    docs = documents(spark, sf_dir)
    return (
        search.store_index(search.build_index(docs), folder, SHARDS, search.index_parts(docs))
        .groupBy(F.col("shard").cast("bigint").alias("shard"))
        .agg(
            F.count(F.lit(1)).alias("postings"),
            F.sum("tf").alias("words"),
            F.count_distinct("doc_id").alias("docs"),
        )
    )


@query(
    "stored_report",
    """
    SELECT 'orders of ' || o_orderkey AS section, 'pingpong_rate' AS metric,
           CAST(o_custkey AS VARCHAR) AS key, CAST(o_orderkey AS DOUBLE) AS value,
           'Mbit/sec' AS unit
    FROM orders
    UNION ALL SELECT 'orders of ' || o_orderkey, 'seconds', CAST(o_custkey AS VARCHAR), 1, 'sec'
    FROM orders""",
)
def stored_report(spark, sf_dir):
    folder = scratch_folder(spark, "reports")
    line = F.format_string(
        "\n\n%s\norders of %d\n%s\n%d bytes in 1.0 seconds = %d Mbit/sec",
        F.lit("-" * reports.RULE_WIDTH),
        "o_orderkey",
        F.lit("-" * reports.RULE_WIDTH),
        "o_custkey",
        "o_orderkey",
    )
    table(spark, sf_dir, "orders").select(line).write.text(folder)
    rows = reports.parse_perf_report(spark, folder)
    return rounded(rows.select("section", "metric", "key", "value", "unit"))


@query(
    "kv_skipping_reads",
    """
    SELECT key, c_acctbal AS value FROM (SELECT DISTINCT 'user' || user_id * 13 AS key FROM events)
    JOIN customer ON key = 'user' || c_custkey""",
)
def kv_skipping_reads(spark, sf_dir):
    # The asked keys are read from a stored table that skips what lacks them.
    folder = scratch_folder(spark, "records")
    lookup.store_records(kv_base(spark, sf_dir), folder, "key", rows_per_file=2_000)
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit("user"), F.col("user_id") * 13).alias("key"))
    return lookup.read_records(spark, folder, asked, "key")
