"""Queries on intervals, frames of time, shares and sessions; ranked search over blocks; phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions.lineage import scratch_folder
from loadlens.functions.text import tokens_of
from loadlens.operators import blocks, frames, intervals, search
from loadlens.plans.registry import query, rounded
from loadlens.plans.search import TOP_K
from loadlens.plans.streams import BOUND_HOURS, FOLLOWED, GAP_HOURS, SESSIONS, STAMP
from loadlens.plans.views import documents, requests, search_queries, table, with_views

HOUR_US = 3_600_000_000


@query(
    "requests_in_pauses",
    with_views(
        "requests",
        """
        WITH long AS (SELECT flow, seq, label, start_us, start_us + dur_us * 60000 AS end_us FROM requests),
        pauses AS (
            SELECT flow, seq AS pause, start_us AS pause_start, end_us AS pause_end FROM long WHERE label = 'error'
            UNION ALL SELECT flow, -1, min(start_us), max(end_us) FROM long GROUP BY flow)
        SELECT flow, pause, count(*) AS in_flight,
               CAST(sum(least(end_us, pause_end) - greatest(start_us, pause_start)) AS BIGINT) AS overlap_us
        FROM pauses JOIN long USING (flow)
        WHERE label <> 'error' AND start_us < pause_end AND pause_start < end_us AND start_us < end_us
        GROUP BY flow, pause""",
    ),
)
def requests_in_pauses(spark, sf_dir):
    # A latency of x ms is read as x minutes; an error is a pause, and one more covers all of a node's time.
    end = F.col("start_us") + F.col("dur_us") * 60_000
    long = requests(spark, sf_dir).select("flow", "seq", "label", "start_us", end.alias("end_us"))
    named = long.where("label = 'error'").select("flow", F.col("seq").alias("pause"), F.col("start_us").alias("pause_start"), F.col("end_us").alias("pause_end"))
    whole = long.groupBy("flow").agg(F.min("start_us").alias("pause_start"), F.max("end_us").alias("pause_end"))
    pauses = named.unionByName(whole.withColumn("pause", F.lit(-1).cast("bigint")))
    flight = long.where("label <> 'error'")
    met = intervals.overlap_join(flight, pauses, ["flow"], ("start_us", "end_us"), ("pause_start", "pause_end"))
    return met.groupBy("flow", "pause").agg(F.count(F.lit(1)).alias("in_flight"), F.sum("overlap").alias("overlap_us"))


@query("view_to_purchase", FOLLOWED)
def view_to_purchase(spark, sf_dir):
    log = requests(spark, sf_dir)
    views = log.where("label = 'view'").select("flow", F.col("seq").alias("view"), F.col("start_us").alias("viewed"))
    bought = log.where("label = 'purchase'").select("flow", F.col("seq").alias("purchase"), F.col("start_us").alias("bought"))
    pairs = intervals.band_join(views, bought, ["flow"], "viewed", "bought", BOUND_HOURS * HOUR_US, "left")
    return pairs.select("flow", "view", "purchase")


FRAME = 24 * HOUR_US


@query(
    "moving_latency",
    with_views(
        "requests",
        f"""
        SELECT DISTINCT flow, start_us, count(*) OVER w AS rows, CAST(sum(dur_us) OVER w AS BIGINT) AS total,
               round(CAST(sum(dur_us) OVER w AS DOUBLE) / count(*) OVER w, 6) AS mean, min(dur_us) OVER w AS least, max(dur_us) OVER w AS most
        FROM requests
        WINDOW w AS (PARTITION BY flow ORDER BY start_us RANGE BETWEEN {FRAME} PRECEDING AND CURRENT ROW)""",
    ),
)
def moving_latency(spark, sf_dir):
    return rounded(frames.range_frame(requests(spark, sf_dir), ["flow"], "start_us", "dur_us", FRAME))


@query(
    "latency_shares",
    with_views(
        "requests",
        """
        SELECT seq, label, dur_us, rank() OVER peers AS rank, round(percent_rank() OVER peers, 9) AS percent_rank,
               round(cume_dist() OVER peers, 9) AS cume_dist, ntile(10) OVER (PARTITION BY label ORDER BY dur_us, seq) AS ntile
        FROM requests WINDOW peers AS (PARTITION BY label ORDER BY dur_us)""",
    ),
)
def latency_shares(spark, sf_dir):
    log = requests(spark, sf_dir).select("seq", "label", "dur_us")
    return rounded(frames.shares(log, ["label"], ["dur_us"], 10, ["seq"]), 9)


@query("user_sessions", SESSIONS)
def user_sessions(spark, sf_dir):
    found = frames.sessions(requests(spark, sf_dir), ["flow"], "start_us", GAP_HOURS * HOUR_US, "seq")
    stamps = [F.date_format(F.timestamp_micros(c), STAMP).alias(c) for c in ("first", "last")]
    return found.select("flow", *stamps, "rows")


@query("search_topk_blocks", TOP_K)
def search_topk_blocks(spark, sf_dir):
    path = scratch_folder(spark, "blocks")
    docs = documents(spark, sf_dir)
    index, sizes = search.build_index(docs, positions=False), {"docs": search.indexed_documents(docs), "pieces": search.index_parts(docs)}
    blocks.store_blocks(index, path, **sizes)
    found = blocks.BlockIndex(spark, path).search(search_queries(spark, sf_dir))
    return found.select("query_id", "doc_id", "score", "place")


PHRASE_WORDS = 3


@query(
    "phrase_search",
    with_views(
        "tokens search_queries",
        f"""
        WITH asked AS (
            SELECT query_id, unnest(terms[1:{PHRASE_WORDS}]) AS term,
                   generate_subscripts(terms[1:{PHRASE_WORDS}], 1) - 1 AS step, len(terms[1:{PHRASE_WORDS}]) AS words
            FROM search_queries),
        starts AS (
            SELECT query_id, doc_id, pos - step AS start FROM tokens JOIN asked USING (term)
            GROUP BY query_id, doc_id, pos - step, words HAVING count(DISTINCT step) = words)
        SELECT query_id AS phrase_id, doc_id, count(*) AS n, CAST(min(start) AS BIGINT) AS first_pos
        FROM starts GROUP BY query_id, doc_id""",
    ),
)
def phrase_search(spark, sf_dir):
    # The first words of each query text, as a phrase.
    items = table(spark, sf_dir, "benchmark")
    phrases = items.select(F.col("item_id").alias("phrase_id"), F.slice(tokens_of(F.col("text")), 1, PHRASE_WORDS).alias("terms"))
    found = blocks.phrase_matches(search.build_index(documents(spark, sf_dir)), phrases)
    return found.withColumn("first_pos", F.col("first_pos").cast("bigint"))
