"""Page rank over a table of links."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from loadlens.functions.joins import split_join
from loadlens.functions.lineage import cut
from loadlens.functions.text import ARTICLE_LINK
from loadlens.operators.search import page_links

DAMPING = 0.85
BLOCK = 1_000_000


def pagerank(
    edges: DataFrame,
    iterations: int = 10,
    damping: float = DAMPING,
    partitions: int | None = None,
    block: int = BLOCK,
    cut_every: int = 2,
    vertices: DataFrame | None = None,
) -> DataFrame:
    """Rank of each page: ``(1 - d) / N + d * sum(rank(src) / links(src))``.

    ``edges`` has ``src`` and ``dst``.  Pages are those of ``vertices(id)`` or, when
    it is left out, those that link somewhere; rank sent to other pages is lost,
    and so is the rank of pages without links.

    The links are placed and sorted once by (page, block) and stay there.  A page with more
    than ``block`` links is cut into blocks, so a hub is spread over many tasks.  A
    step moves one row per page to the links and, after map-side combine, one row
    per target back.
    """
    spark = edges.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("links"))
    # One row per page, read several times below; the links are read twice in all.
    degree = cut(degree.withColumn("blocks", F.ceil(F.col("links") / block).cast("int")))
    pages = degree.select(F.col("src").alias("id"), "links", "blocks")
    if vertices is not None:
        pages = vertices.select("id").distinct().join(pages, "id", "left")
    pages = pages.fillna({"links": 0, "blocks": 0})
    pages = pages.repartition(parts, "id").sortWithinPartitions("id")
    pages = pages.persist(StorageLevel.MEMORY_AND_DISK)
    total = pages.count()

    sizes = degree.select("src", F.col("links").alias("rows"))
    placed = (
        split_join(edges, degree.select("src", "blocks"), ["src"], sizes)
        .select("src", F.pmod(F.hash("dst"), F.col("blocks")).alias("block"), "dst")
        .repartition(parts, "src", "block")
        .sortWithinPartitions("src", "block")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    base = F.lit((1 - damping) / total) if total else F.lit(0.0)
    ranks = pages.withColumn("rank", F.lit(1.0) / F.lit(max(total, 1)))
    for step in range(1, iterations + 1):
        sent = ranks.where("links > 0").select(
            F.col("id").alias("src"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            (F.col("rank") / F.col("links")).alias("share"),
        )
        received = (
            placed.join(sent, ["src", "block"])
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum("share").alias("received"))
        )
        ranks = (
            pages.join(received, "id", "left")
            .withColumn("rank", base + damping * F.coalesce("received", F.lit(0.0)))
            .drop("received")
        )
        if step % cut_every == 0 or step == iterations:
            ranks = cut(ranks)
    placed.unpersist()
    pages.unpersist()
    return ranks.select("id", "rank")


def rank_articles(
    articles: DataFrame, threshold: float, partitions: int | None = None, iterations: int = 10
) -> DataFrame:
    """Whole job on an article dump ``(title, body)``: articles with at least a rank.

    Articles are the pages; links to titles that are not in the dump are dropped.
    """
    links = page_links(articles, "title", "body", ARTICLE_LINK)
    titles = articles.select(F.col("title").alias("id"))
    return rank_threshold(
        pagerank(links, iterations, partitions=partitions, vertices=titles), threshold
    )


def rank_threshold(ranks: DataFrame, threshold: float) -> DataFrame:
    """Pages with at least the given rank, best first."""
    return ranks.where(F.col("rank") >= threshold).orderBy(F.col("rank").desc(), "id")
