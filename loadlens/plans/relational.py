"""Queries on node, role and key tables, and on single columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions import text
from loadlens.operators import relational
from loadlens.plans.registry import query
from loadlens.plans.views import requests, table, with_views
from loadlens.sources import files, runs

# Ready line of the fixture: a signup above 100.
READY = r"Server started in 1[0-9]{2,}|Server started in [2-9][0-9]{2,}"


def ready_lines(log):
    """Node logs: each request as one line of its node."""
    started = F.concat(F.lit("Server started in "), F.floor("elapsed_ms").cast("string"))
    handled = F.concat(F.lit("handled "), F.col("label"))
    line = F.when(F.col("label") == "signup", started).otherwise(handled)
    return log.select(F.col("flow").alias("node"), "ts", line.alias("line"))


@query(
    "nodes_not_ready",
    with_views(
        "requests",
        """
        SELECT DISTINCT flow AS node FROM requests
        WHERE flow NOT IN (SELECT flow FROM requests
                           WHERE label = 'signup' AND floor(elapsed_ms) >= 100)""",
    ),
)
def nodes_not_ready(spark, sf_dir):
    log = requests(spark, sf_dir)
    nodes = log.select(F.col("flow").alias("node")).distinct()
    return relational.not_ready(nodes, ready_lines(log), READY)


@query(
    "allowlist_semi",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def allowlist_semi(spark, sf_dir):
    allowed = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return relational.in_allocation(
        orders, allowed.select(F.col("c_custkey").alias("o_custkey")), "o_custkey"
    )


@query(
    "dimension_enrich",
    """
    SELECT s_suppkey, s_name, coalesce(n_name, 'unknown') AS n_name,
           coalesce(r_name, 'unknown') AS r_name
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
                  LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def dimension_enrich(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", F.col("s_nationkey").alias("nation")
    )
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region")
    )
    places = relational.enrich(nations, regions, "region").select("nation", "n_name", "r_name")
    named = relational.enrich(suppliers, places, "nation", default="unknown")
    return named.select("s_suppkey", "s_name", "n_name", "r_name")


@query(
    "topk_per_group",
    """
    SELECT l_suppkey, place, l_orderkey, l_linenumber, l_extendedprice FROM (
        SELECT *, row_number() OVER (
            PARTITION BY l_suppkey
            ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place
        FROM lineitem)
    WHERE place <= 10""",
)
def topk_per_group(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"]
    return relational.top_k(items, ["l_suppkey"], order, 10)


@query(
    "group_members",
    """
    SELECT n_name, part, string_agg(c_name, ',' ORDER BY c_name) AS members
    FROM (SELECT n_name, c_name,
                 (row_number() OVER (PARTITION BY n_name ORDER BY c_name) - 1) // 50 AS part
          FROM (SELECT DISTINCT n_name, c_name
                FROM customer JOIN nation ON c_nationkey = n_nationkey))
    GROUP BY n_name, part""",
)
def group_members(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    roles = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    members = relational.group_members(roles, "n_name", "c_name", per_row=50)
    return members.withColumn("members", F.array_join("members", ","))


@query(
    "union_logs",
    """
    SELECT 'driver' AS role, c_custkey AS id, c_acctbal AS value FROM customer
    UNION ALL SELECT 'root', o_orderkey, o_totalprice FROM orders
    UNION ALL SELECT 'leaf', l_orderkey, l_extendedprice FROM lineitem""",
)
def union_logs(spark, sf_dir):
    def role(name, source, key, value):
        rows = table(spark, sf_dir, source)
        return rows.select(F.lit(name).alias("role"), F.col(key).alias("id"), F.col(value).alias("value"))

    return relational.all_roles(
        role("driver", "customer", "c_custkey", "c_acctbal"),
        role("root", "orders", "o_orderkey", "o_totalprice"),
        role("leaf", "lineitem", "l_orderkey", "l_extendedprice"),
    )


@query("distinct_keys", "SELECT DISTINCT l_partkey FROM lineitem")
def distinct_keys(spark, sf_dir):
    return relational.distinct_keys(table(spark, sf_dir, "lineitem"), "l_partkey")


@query(
    "set_difference",
    """
    SELECT p_partkey FROM part
    EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25""",
)
def set_difference(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    done = items.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 25))
    return relational.missing(
        table(spark, sf_dir, "part").select("p_partkey"),
        done.select(F.col("l_partkey").alias("p_partkey")),
    )


@query(
    "set_difference_all",
    """
    SELECT l_partkey FROM lineitem EXCEPT ALL SELECT l_partkey FROM lineitem
    WHERE l_returnflag = 'R'""",
)
def set_difference_all(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    done = items.where(F.col("l_returnflag") == "R").select("l_partkey")
    return relational.missing(items.select("l_partkey"), done, keep_duplicates=True)


@query(
    "parse_timestamp",
    """
    SELECT o_orderkey, strftime(o_orderdate + to_hours(o_orderkey % 24), '%Y-%m-%d %H:%M:%S')
               AS parsed,
           CAST(NULL AS VARCHAR) AS parsed_bad
    FROM orders""",
)
def parse_timestamp(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    at = F.timestamp_add("HOUR", F.pmod(F.col("o_orderkey"), F.lit(24)).cast("int"), at)
    iso = F.date_format(at, text.ISO_INSTANT)
    show = "yyyy-MM-dd HH:mm:ss"
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format(text.parse_instant(iso), show).alias("parsed"),
        F.date_format(text.parse_instant(F.replace(iso, F.lit("T"), F.lit(" "))), show).alias(
            "parsed_bad"
        ),
    )


@query(
    "run_label",
    "SELECT event_id, strftime(ts, '%Y-%m-%d-%H-%M-%S') AS run_label FROM events",
)
def run_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", text.run_label(F.col("ts").cast("timestamp")).alias("run_label")
    )


@query(
    "json_field_default",
    """
    SELECT event_id, coalesce(props ->> '$.k', '0') AS k,
           coalesce(props ->> '$.status', 'idle') AS status,
           coalesce(props ->> '$.status', 'idle') = 'idle' AS is_idle
    FROM events""",
)
def json_field_default(spark, sf_dir):
    props = F.col("props")
    status = text.json_field(props, "$.status", "idle")
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.json_field(props, "$.k", "0").alias("k"),
        status.alias("status"),
        (status == "idle").alias("is_idle"),
    )


TREE = "tree array<struct<children:array<struct<data:struct<title:string>>>>>"


@query(
    "json_nested_explode",
    """
    SELECT host, count(*) AS seen FROM (
        SELECT 'part' || l_partkey AS host FROM lineitem
        UNION ALL SELECT 'supplier' || l_suppkey FROM lineitem)
    GROUP BY host""",
)
def json_nested_explode(spark, sf_dir):
    def child(prefix, key):
        title = F.concat(F.lit(prefix), F.col(key), F.lit(":7000_live"))
        return F.struct(F.struct(title.alias("title")).alias("data"))

    children = F.array(child("part", "l_partkey"), child("supplier", "l_suppkey"))
    status = F.to_json(
        F.struct(F.array(F.struct(children.alias("children"))).alias("tree"))
    )
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    statuses = items.select(status.alias("status"))
    nodes = statuses.select(
        F.explode(text.json_path(F.col("status"), TREE, "tree.0.children")).alias("child")
    )
    host = F.regexp_replace("child.data.title", r":[0-9]+_live$", "")
    return nodes.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("seen")).orderBy("host")


@query(
    "search_url_params",
    r"""
    SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
           nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref,
           'html' AS df, 'url' AS fl,
           array_to_string(regexp_extract_all(lower(url), '[\p{L}\p{N}]+'), ' ') AS terms
    FROM pages""",
)
def search_url_params(spark, sf_dir):
    # The request asks for the words of the page's own address.
    request = F.concat(F.lit("/select?df=html&fl=url&q="), F.url_encode("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.nullif(text.request_field(F.col("url"), "page"), F.lit("")).alias("page"),
        F.nullif(text.request_field(F.col("url"), "ref"), F.lit("")).alias("ref"),
        text.request_field(request, "df").alias("df"),
        text.request_field(request, "fl").alias("fl"),
        F.array_join(text.request_terms(request), " ").alias("terms"),
    )


# Fixed value: form of an application id in a driver log.
APP_ID = r"(app-[0-9]+-[0-9]+)"


@query(
    "log_id_extract",
    """
    SELECT event_id, CASE WHEN event_type <> 'error'
        THEN strftime(ts, 'app-%Y%m%d%H%M%S-') || user_id END AS app_id
    FROM events""",
)
def log_id_extract(spark, sf_dir):
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmmss")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("lost connection at "), stamp)).otherwise(
        F.concat(
            F.lit("INFO Connected with app ID app-"), stamp, F.lit("-"), F.col("user_id"), F.lit(" to master")
        )
    )
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return lines.select("event_id", text.extract_id(F.col("line"), APP_ID).alias("app_id"))


@query(
    "json_lines_map",
    """
    SELECT 'user' || user_id AS host, '10.0.0.' || arg_max(props ->> '$.k', event_id) AS ip
    FROM events GROUP BY user_id""",
)
def json_lines_map(spark, sf_dir):
    entry = F.to_json(
        F.struct(
            F.concat(F.lit("user"), F.col("user_id")).alias("host"),
            F.concat(F.lit("10.0.0."), F.get_json_object("props", "$.k")).alias("ip"),
        )
    )
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), entry.alias("line"))
    return files.json_map(lines)


@query(
    "latest_run",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS run_ts, event_id, event_type, value FROM events
    WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""",
)
def latest_run(spark, sf_dir):
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    events = table(spark, sf_dir, "events")
    return runs.latest_run(events.select(day.alias("run_ts"), "event_id", "event_type", "value"))
