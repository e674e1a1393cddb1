"""Queries of the text search: index, statistics, ranked search, links, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions.lineage import scratch_folder
from loadlens.functions.text import shard_of
from loadlens.operators import search
from loadlens.plans.registry import query, rounded
from loadlens.plans.views import documents, search_queries, table, with_views

SHARDS = 3
# No fixture document carries a redirect mark; this pattern stands in for it.
MARK = "^The .*"
MARK_SQL = r"^The [^\n\r\x{85}\x{2028}\x{2029}]*"


_indexes: dict[tuple, str] = {}


def index_folder(spark, sf_dir):
    """Folder of an index without positions, written once per application and state of the table; every search reads it."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.max("_metadata.file_modification_time"), F.countDistinct("_metadata.file_path")).first()
    key = (spark.sparkContext.applicationId, sf_dir, *files)
    if key not in _indexes:
        path = scratch_folder(spark, "index")
        docs = documents(spark, sf_dir)
        index = search.build_index(docs.withColumn("shard", shard_of(F.col("doc_id"), SHARDS)), positions=False, keep=["shard"])
        search.store_index(index, path, SHARDS, search.index_parts(docs))
        _indexes[key] = path
    return _indexes[key]


def stored_words(spark, sf_dir):
    """The stored index and its sizes."""
    path = index_folder(spark, sf_dir)
    return spark.read.parquet(f"{path}/terms"), search.index_sizes(spark, path)


@query(
    "filter_redirects",
    f"SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, '{MARK_SQL}')",
)
def filter_redirects(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return search.drop_redirects(docs, "text", MARK).select("doc_id", "lang")


@query(
    "filter_redirects_strict",
    f"""
    SELECT doc_id, lang, derived
    FROM (SELECT doc_id, lang, text, false AS derived FROM documents
          UNION ALL SELECT doc_id, lang, split_part(text, chr(10), 1), true FROM documents)
    WHERE NOT (regexp_matches(text, '{MARK_SQL}')
               AND lower(regexp_replace(text, '{MARK_SQL}', 'true')) = 'true')""",
)
def filter_redirects_strict(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # Whole texts hardly ever are a mark and nothing else, so each text's first line is a further document.
    both = F.explode(F.array(F.struct("text", F.lit(False).alias("derived")), F.struct(F.substring_index("text", "\n", 1).alias("text"), F.lit(True).alias("derived"))))
    rows = docs.select("doc_id", "lang", both.alias("d")).select("doc_id", "lang", "d.*")
    return search.drop_redirects(rows, "text", MARK, strict=True).select("doc_id", "lang", "derived")


@query(
    "page_links",
    """
    SELECT page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst
    FROM pages""",
)
def page_links(spark, sf_dir):
    return search.page_links(table(spark, sf_dir, "pages"), "page_id", "html")


@query(
    "shard_sizes",
    f"""
    SELECT ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % {SHARDS} AS shard,
           count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
           round(sum(strlen(text)) / (SELECT sum(strlen(text)) FROM documents), 6) AS share
    FROM documents GROUP BY ALL""",
)
def shard_sizes(spark, sf_dir):
    return rounded(search.shard_sizes(documents(spark, sf_dir), SHARDS))


@query(
    "inverted_index",
    with_views(
        "tokens",
        """
        SELECT term, doc_id, count(*) AS tf, CAST(any_value(doc_len) AS BIGINT) AS doc_len,
               string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions
        FROM tokens GROUP BY term, doc_id""",
    ),
)
def inverted_index(spark, sf_dir):
    index = search.build_index(documents(spark, sf_dir)).drop("first_pos")
    return index.withColumns(
        {
            "doc_len": F.col("doc_len").cast("bigint"),
            "positions": F.array_join(F.col("positions").cast("array<string>"), " "),
        }
    )


@query(
    "term_stats",
    with_views(
        "index",
        """
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
               CAST(min(first_pos) AS BIGINT) AS first_pos,
               round(1 + ln((SELECT count(DISTINCT doc_id) FROM index) / (count(*) + 1)), 9) AS idf
        FROM index GROUP BY term""",
    ),
)
def term_stats(spark, sf_dir):
    stats = search.stored_term_stats(spark, index_folder(spark, sf_dir))
    return rounded(stats.withColumn("first_pos", F.col("first_pos").cast("bigint")), 9)


SCORED = """
    WITH asked AS (
        SELECT query_id, len(list_distinct(terms)) AS asked, unnest(list_distinct(terms)) AS term
        FROM search_queries),
    stats AS (
        SELECT term, 1 + ln((SELECT count(DISTINCT doc_id) FROM index) / (count(*) + 1)) AS idf
        FROM index GROUP BY term),
    scored AS (
        SELECT query_id, doc_id,
               round(count(*) / any_value(asked) * sum(sqrt(tf) * idf * idf / sqrt(doc_len)), 9)
                   AS score
        FROM index JOIN stats USING (term) JOIN asked USING (term)
        GROUP BY query_id, doc_id)"""

TOP_K = with_views(
    "index search_queries",
    SCORED
    + """
    SELECT * FROM (
        SELECT query_id, doc_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place
        FROM scored)
    WHERE place <= 10""",
)


def _found(df):
    return df.select("query_id", "doc_id", "score", "place")


@query("search_topk", TOP_K)
def search_topk(spark, sf_dir):
    index, sizes = stored_words(spark, sf_dir)
    return _found(search.search(index, search_queries(spark, sf_dir), sizes=sizes))


@query("search_topk_sharded", TOP_K)
def search_topk_sharded(spark, sf_dir):
    index, sizes = stored_words(spark, sf_dir)
    return _found(search.search_sharded(index, search_queries(spark, sf_dir), SHARDS, sizes=sizes))


@query(
    "search_topk_shard_stats",
    with_views(
        "index search_queries",
        f"""
        WITH asked AS (
            SELECT query_id, len(list_distinct(terms)) AS asked,
                   unnest(list_distinct(terms)) AS term
            FROM search_queries),
        placed AS (
            SELECT *, ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % {SHARDS} AS shard
            FROM index),
        sizes AS (SELECT shard, count(DISTINCT doc_id) AS docs FROM placed GROUP BY shard),
        stats AS (
            SELECT shard, term, 1 + ln(any_value(docs) / (count(*) + 1)) AS idf
            FROM placed JOIN sizes USING (shard) GROUP BY shard, term),
        scored AS (
            SELECT query_id, doc_id,
                   round(count(*) / any_value(asked)
                         * sum(sqrt(tf) * idf * idf / sqrt(doc_len)), 9) AS score
            FROM placed JOIN stats USING (shard, term) JOIN asked USING (term)
            GROUP BY query_id, doc_id)
        SELECT * FROM (
            SELECT query_id, doc_id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place
            FROM scored)
        WHERE place <= 10""",
    ),
)
def search_topk_shard_stats(spark, sf_dir):
    index, sizes = stored_words(spark, sf_dir)
    queries = search_queries(spark, sf_dir)
    return _found(search.search_sharded(index, queries, SHARDS, shard_stats=True, sizes=sizes))


@query(
    "query_replay",
    with_views(
        "index search_queries",
        SCORED
        + """,
        listed AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS turn
                   FROM search_queries),
        runs AS (SELECT event_id % (SELECT count(*) FROM search_queries) AS turn,
                        count(*) AS runs FROM events GROUP BY ALL),
        found AS (SELECT query_id, count(*) AS hits FROM scored GROUP BY query_id),
        report AS (
            SELECT query_id, runs, coalesce(hits, 0) AS hits, least(coalesce(hits, 0), 10)
                       AS returned
            FROM listed JOIN runs USING (turn) LEFT JOIN found USING (query_id))
        SELECT *, round((SELECT sum(CASE WHEN hits = 0 THEN runs ELSE 0 END) / sum(runs)
                         FROM report), 6) AS zero_hit_share
        FROM report""",
    ),
)
def query_replay(spark, sf_dir):
    index, sizes = stored_words(spark, sf_dir)
    slots = table(spark, sf_dir, "events").select("event_id")
    return rounded(
        search.replay_queries(index, search_queries(spark, sf_dir), slots, "event_id", sizes=sizes)
    )
