"""Ranked search that skips blocks of postings (block-max), and phrases.

Documents are dealt into segments of about ``span`` documents by a hash.  All postings of a term in
one segment are a block, and a small table of heads has the number of postings and the largest
weight of each.  A query first reads heads only: they give document counts, and for each
segment a bound that no document in it can exceed.  The best ``k`` segments by bound are scored;
the k-th best score found is the threshold, and of all other segments only those
whose bound reaches it are scored, too.  The blocks of the rest are not joined, decoded or
shuffled, and no row of the result can be in them.  Scores, ties and places are those of ``search``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens.functions.joins import BROADCAST_BYTES, checked_join
from loadlens.functions.lineage import cut, small_splits, stored_rows
from loadlens.functions.ordered import row_bytes
from loadlens.operators.relational import top_k
from loadlens.operators.search import PART_ROWS, PLACES, TASK_HITS, idf

SPAN = 64
BUCKETS, PARTS = 8, 4
#: Scores are rounded, and a bound is a sum in another order: this much below the threshold still counts.
SLACK = 2e-9
_BLOCKS = "term string, segment int, n bigint, most double"


def store_blocks(
    index: DataFrame, path: str, span: int = SPAN, buckets: int = BUCKETS, parts: int = PARTS,
    docs: int | None = None, pieces: int | None = None,
) -> None:
    """Write an index (term, doc_id, tf, doc_len, first_pos) as blocks and heads.

    Folders are by term and by segment, files inside sorted by both, so a search for few blocks opens few folders and skips
    row groups.  Rows move once: all of a block, and of a file, go to one task, which makes the blocks and writes
    them.  ``docs`` is the number of documents with a word, and ``pieces`` in how many tasks they are written
    (``search.index_parts``); what is missing is counted from the index.  ``sizes`` has the number of documents.
    """
    spark = index.sparkSession
    if docs is None or pieces is None:
        counted, rows = index.agg(F.count_if(F.col("first_pos") == 0), F.count(F.lit(1))).first()
        docs = counted if docs is None else docs
        pieces = max(1, -(-rows // PART_ROWS)) if pieces is None else pieces
    segments = max(1, -(-docs // span))
    segment = F.pmod(F.xxhash64("doc_id"), F.lit(segments)).cast("int")
    # A folder is by term and by a few segments in turn; the rows of a large one go to ``each`` files by further segments.
    each = -(-pieces // (buckets * parts))
    folder = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int") * parts + F.pmod(segment, F.lit(parts))
    place = (folder * each + F.pmod(F.floor(segment / parts), F.lit(each))).cast("int")
    dealt = index.select("term", "doc_id", "tf", "doc_len", segment.alias("segment"), place.alias("place"))
    # More tasks than files: a hash puts some files into one task.
    blocks = dealt.repartition(2 * buckets * parts * each, "place").groupBy("place", "term", "segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.sqrt("tf") / F.sqrt("doc_len")).alias("most"),
        F.collect_list(F.struct("doc_id", "tf", "doc_len")).alias("postings"),
    )
    folder = F.floor(F.col("place") / each)
    names = [F.floor(folder / parts).cast("int").alias("bucket"), F.pmod(folder, F.lit(parts)).cast("int").alias("part")]
    placed = blocks.select("term", "segment", "n", "most", "postings", *names).sortWithinPartitions("bucket", "part", "term", "segment")
    with small_splits(spark):
        placed.write.mode("overwrite").partitionBy("bucket", "part").parquet(f"{path}/blocks")
    heads = spark.read.schema(_BLOCKS + ", bucket int, part int").parquet(f"{path}/blocks").select("term", "segment", "n", "most", "bucket")
    # The files read are in folders of terms already, so nothing moves.
    with small_splits(spark):
        heads.sortWithinPartitions("bucket", "term", "segment").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/heads")
    kind = index.schema["doc_id"].dataType.simpleString()
    sizes = spark.createDataFrame([(docs, buckets, parts, kind)], "docs long, buckets int, parts int, kind string")
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


class BlockIndex:
    """A stored index that answers queries; ``blocks_read`` tells what the last search scored."""

    def __init__(self, spark: SparkSession, path: str):
        self.docs, self.buckets, self.parts, kind = spark.read.parquet(f"{path}/sizes").first()
        self.heads = spark.read.schema(_BLOCKS + ", bucket int").parquet(f"{path}/heads")
        postings = f", postings array<struct<doc_id:{kind},tf:bigint,doc_len:int>>"
        self.blocks = spark.read.schema(_BLOCKS + postings + ", bucket int, part int").parquet(f"{path}/blocks")
        self.wanted: DataFrame | None = None

    def asked_heads(self, queries: DataFrame) -> DataFrame:
        """Heads of all blocks of asked terms, for each query: query_id, asked, term, segment, n, most, idf (stored)."""
        terms = F.array_distinct("terms")
        asked = cut(queries.select("query_id", F.size(terms).alias("asked"), F.explode(terms).alias("term")))
        names = asked.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        if (names.agg(F.sum(row_bytes(names))).first()[0] or 0) <= BROADCAST_BYTES:
            names = F.broadcast(names)
        heads = stored_rows(self.heads.join(names, ["bucket", "term"], "left_semi"), "heads")
        known = heads.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("rows"))
        self.known = cut(known.withColumn("idf", idf(F.lit(self.docs), F.col("df"))))
        self.names, self.weights = names, cut(asked.join(self.known, "term").drop("rows", "df"))
        return stored_rows(checked_join(heads.drop("bucket"), self.weights, ["term"], self.known.select("term", "rows")), "asked")

    def scores(self, chosen: DataFrame) -> DataFrame:
        """Score of every document of the last asked queries in the segments of ``chosen`` (query_id, segment, hits).

        The blocks of a segment meet in one task, so the scores of its documents are added there; only
        asked terms' blocks move, and only those of chosen segments if the list of these is short.
        """
        hits = chosen.agg(F.sum("hits")).first()[0] or 0
        tasks = max(1, -(-hits // TASK_HITS))
        queries = cut(chosen.groupBy("segment").agg(F.collect_set("query_id").alias("queries")))
        short = (queries.agg(F.sum(row_bytes(queries))).first()[0] or 0) <= BROADCAST_BYTES
        blocks = self.blocks.join(self.names, ["bucket", "term"], "left_semi").select("term", "segment", "postings")
        if short:
            blocks = blocks.join(F.broadcast(queries), "segment", "left_semi")
        blocks = blocks.repartition(tasks, "segment")
        queries = F.broadcast(queries) if short else queries.repartition(tasks, "segment")
        found = checked_join(blocks.join(queries, "segment"), self.weights, ["term"], self.known.select("term", "rows"))
        found = found.where(F.array_contains("queries", F.col("query_id")))
        hits = found.select("query_id", "asked", "idf", "segment", F.explode("postings").alias("p"))
        weight = F.sqrt("p.tf") * F.col("idf") * F.col("idf") / F.sqrt("p.doc_len")
        # The segment follows from the document.
        return hits.groupBy("query_id", "segment", F.col("p.doc_id").alias("doc_id")).agg(
            F.round(F.count(F.lit(1)) / F.first("asked") * F.sum(weight), PLACES).alias("score")
        ).drop("segment")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Best ``k`` documents of each query (query_id, terms): query_id, doc_id, score, place."""
        heads = self.asked_heads(queries)
        most = F.sum(F.col("most") * F.col("idf") * F.col("idf")) * F.count(F.lit(1)) / F.first("asked")
        bounds = heads.groupBy("query_id", "segment").agg(most.alias("bound"), F.sum("n").alias("hits"))
        bounds = stored_rows(bounds, "bounds")
        # Each of these segments has a document with an asked term: together at least k if there are that many.
        first = cut(top_k(bounds, ["query_id"], [F.col("bound").desc(), F.col("segment")], k).select("query_id", "segment", "hits"))
        best = [F.col("score").desc(), F.col("doc_id")]
        found = cut(top_k(self.scores(first), ["query_id"], best, k))
        # With fewer than k so far, there are no other segments.
        threshold = found.where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(first, ["query_id", "segment"], "left_anti").join(threshold, "query_id")
        rest = cut(rest.where(F.col("bound") >= F.col("least") - SLACK).select("query_id", "segment", "hits"))
        self.wanted = first.unionByName(rest)
        self.last = heads
        return top_k(found.drop("place").unionByName(self.scores(rest)), ["query_id"], best, k)

    def blocks_read(self) -> DataFrame:
        """For each term of the last search: blocks that were scored for some query, and all of its blocks."""
        read = self.last.join(self.wanted, ["query_id", "segment"]).groupBy("term").agg(F.countDistinct("segment").alias("read"))
        every = self.last.groupBy("term").agg(F.countDistinct("segment").alias("blocks"))
        return every.join(read, "term", "left").fillna(0)


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Documents with all words of a phrase in a row: phrase_id, doc_id, n, first_pos.

    ``index`` has term, doc_id and positions; ``phrases`` has phrase_id and terms (in order, repeats allowed).  Only
    documents that have all words are looked at; in those, the lists of places, each moved back by the word's place in the phrase, are
    intersected.  Phrases without words match nothing.
    """
    words = cut(phrases.select("phrase_id", F.size("terms").alias("words"), F.posexplode("terms").alias("step", "term")))
    asked = words.select("term").distinct()
    postings = stored_rows(index.join(asked, "term", "left_semi").select("term", "doc_id", "positions"), "positions")
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    # Which documents have all words is found without the lists.
    names = words.groupBy("phrase_id").agg(F.countDistinct("term").alias("terms"))
    each = words.select("phrase_id", "term").distinct()
    holds = checked_join(postings.select("term", "doc_id"), each, ["term"], counts).groupBy("phrase_id", "doc_id").agg(F.count(F.lit(1)).alias("terms"))
    whole = stored_rows(holds.join(names, ["phrase_id", "terms"]).select("phrase_id", "doc_id"), "whole")
    sizes = postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    near = checked_join(postings, whole, ["doc_id"], sizes).join(words.select("phrase_id", "term", "step", "words"), ["phrase_id", "term"])
    moved = near.withColumn("starts", F.transform("positions", lambda p: p - F.col("step")))
    lists = moved.groupBy("phrase_id", "doc_id").agg(F.collect_list("starts").alias("lists"))
    common = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), F.array_intersect)
    found = lists.select("phrase_id", "doc_id", common.alias("starts")).where(F.size("starts") > 0)
    return found.select("phrase_id", "doc_id", F.size("starts").cast("bigint").alias("n"), F.array_min("starts").alias("first_pos"))
