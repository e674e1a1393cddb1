"""Queries that iterate or compute: page rank and the estimate of pi."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions.lineage import cut
from loadlens.functions.text import links_of
from loadlens.operators import estimate, graph
from loadlens.plans.registry import query, rounded
from loadlens.plans.views import edges, table, with_views

ITERATIONS = 10


def _rank_steps() -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM pages_) AS rank FROM pages_)"]
    for i in range(1, ITERATIONS + 1):
        steps.append(
            f"""r{i} AS (
            SELECT p.id, 0.15::DOUBLE / (SELECT count(*) FROM pages_)
                         + 0.85::DOUBLE * coalesce(s.received, 0) AS rank
            FROM pages_ p LEFT JOIN (
                SELECT dst, sum(rank / links) AS received
                FROM edges JOIN r{i - 1} ON src = r{i - 1}.id JOIN pages_ q ON src = q.id
                GROUP BY dst) s ON p.id = s.dst)"""
        )
    return ",\n".join(steps)


RANKS = f"""
    WITH pages_ AS (SELECT src AS id, count(*) AS links FROM edges GROUP BY src),
    {_rank_steps()}"""


def stored_edges(spark, sf_dir):
    """The links come from a join, so they are made once and kept."""
    return cut(edges(spark, sf_dir))


@query(
    "pagerank",
    with_views("edges", RANKS + f" SELECT id, round(rank, 9) AS rank FROM r{ITERATIONS}"),
)
def pagerank(spark, sf_dir):
    return rounded(graph.pagerank(stored_edges(spark, sf_dir), ITERATIONS), 9)


@query(
    "rank_threshold",
    with_views(
        "edges",
        RANKS
        + f"""
        SELECT id, round(rank, 9) AS rank FROM r{ITERATIONS}
        WHERE round(rank, 9) >= 1.0::DOUBLE / (SELECT count(*) FROM pages_)""",
    ),
)
def rank_threshold(spark, sf_dir):
    # Above average: a rank of at least 1 / N.
    ranks = rounded(graph.pagerank(stored_edges(spark, sf_dir), ITERATIONS), 9)
    return graph.rank_threshold(ranks, 1.0 / ranks.count())


PATH = r"^[a-z]+://[^/]+(/[^?#]*)"


def page_articles(spark, sf_dir):
    """The pages as a dump (title, body): titles are paths, and a path that is only linked to is an article without text."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", PATH, 1).alias("title"), links_of(F.col("html")).alias("links"))
    body = F.concat_ws("", F.transform("links", lambda x: F.concat(F.lit("<link><target>"), x, F.lit("</target></link>"))))
    linked = pages.select(F.explode("links").alias("title"), F.lit("").alias("body"))
    return pages.select("title", body.alias("body")).unionByName(linked)


@query(
    "article_ranks",
    f"""
    WITH articles AS (
        SELECT regexp_extract(url, '{PATH}', 1) AS id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS links FROM pages),
    edges AS (SELECT id AS src, unnest(links) AS dst FROM articles),
    pages_ AS (
        SELECT id, coalesce(n, 0) AS links
        FROM (SELECT id FROM articles UNION SELECT dst FROM edges)
        LEFT JOIN (SELECT src AS id, count(*) AS n FROM edges GROUP BY src) USING (id)),
    {_rank_steps()}
    SELECT id, round(rank, 9) AS rank FROM r{ITERATIONS} WHERE rank >= 0.2::DOUBLE / (SELECT count(*) FROM pages_)""",
)
def article_ranks(spark, sf_dir):
    articles = cut(page_articles(spark, sf_dir))
    # Nobody links to the pages, and what they link to has no links: few get much above the 0.15 / N of all.
    least = 0.2 / max(1, articles.select("title").distinct().count())
    return rounded(graph.rank_articles(articles, least, iterations=ITERATIONS), 9)


X, Y = estimate.PRIME_X, estimate.PRIME_Y


@query(
    "monte_carlo_pi",
    f"""
    SELECT count(*) AS points, count(*) FILTER (x * x + y * y <= 1) AS inside,
           round(count(*) FILTER (x * x + y * y <= 1) * 4 / count(*), 9) AS pi
    FROM (SELECT o_orderkey % {X} * {estimate.STEP_X} % {X} / {X} * 2 - 1 AS x,
                 o_orderkey % {Y} * {estimate.STEP_Y} % {Y} / {Y} * 2 - 1 AS y
          FROM orders)""",
)
def monte_carlo_pi(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return rounded(estimate.estimate_pi(orders, "o_orderkey"), 9)
