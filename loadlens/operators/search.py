"""Ranked text search: inverted index, term statistics, top-k queries.

Score of a document for a query, over the asked terms it contains:
``coord * sum(sqrt(tf) * idf^2) / sqrt(doc_len)`` with
``idf = 1 + ln(N / (df + 1))`` and ``coord`` = matched terms / asked terms.
Ranks go by the score rounded to 9 places, then by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loadlens.functions.joins import BROADCAST_BYTES, checked_join
from loadlens.functions.lineage import cut, small_splits, stored_rows
from loadlens.functions.ordered import row_bytes, running
from loadlens.functions.text import HREF, WORD, is_redirect, links_of, shard_of, tokens_of
from loadlens.operators.relational import top_k

PLACES = 9
#: Bytes of text, or rows, whose index is one part of a stored index: about 100 MB while it is sorted.
PART_BYTES, PART_ROWS = 8 << 20, 1 << 20
#: Pairs of an asked term and a query that one task scores.
TASK_HITS = 1 << 21


def drop_redirects(
    docs: DataFrame, text: str, pattern: str | None = None, strict: bool = False
) -> DataFrame:
    """Documents without those that only point elsewhere."""
    mark = {} if pattern is None else {"pattern": pattern}
    return docs.where(~F.coalesce(is_redirect(F.col(text), strict=strict, **mark), F.lit(False)))


def page_links(pages: DataFrame, page: str, body: str, pattern: str = HREF) -> DataFrame:
    """One row per link of each page body."""
    links = F.explode(links_of(F.col(body), pattern))
    return pages.select(F.col(page).alias("src"), links.alias("dst"))


def build_index(docs: DataFrame, positions: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Inverted index of ``(doc_id, text)``: one row per document and term in it.

    ``doc_id`` is unique, so all words of a group are in one input row and no
    shuffle is needed: the words of a text are sorted with their positions, and
    each run of equal words becomes a row that carries its own run only, so the cost
    grows with the length of a text.  ``positions=False`` leaves out the
    lists, which ranked search does not read.  ``keep`` names further columns of a document to carry along.
    """
    pairs = F.transform(tokens_of(F.col("text")), lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    runs = _let(F.sort_array(pairs), lambda placed: _runs(placed, positions))
    found = docs.select("doc_id", *keep, F.explode(runs).alias("run"))
    return found.select("run.term", "doc_id", *[f"run.{c}" for c in _run_columns(positions) if c != "term"], *keep)


def _run_columns(positions: bool) -> list[str]:
    return ["term", "tf", "first_pos", "doc_len", *(["positions"] if positions else [])]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(placed: Column, positions: bool) -> Column:
    """Runs of equal words of sorted (term, pos) pairs; each run holds its own positions only."""
    new = F.transform(
        placed, lambda x, i: F.when((i == 0) | (x["term"] != F.get(placed, i - 1)["term"]), i)
    )

    def cut_at(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(F.size(placed)))

        def run(start: Column, end: Column) -> Column:
            first = F.get(placed, start)
            columns = [
                first["term"].alias("term"), (end - start).cast("bigint").alias("tf"),
                first["pos"].alias("first_pos"), F.size(placed).alias("doc_len"),
            ]
            if positions:
                own = F.slice(placed, start + 1, end - start)
                columns.append(F.transform(own, lambda x: x["pos"]).alias("positions"))
            return F.struct(*columns)

        whole = F.when(F.size(starts) > 0, ends).otherwise(F.array().cast("array<int>"))
        return F.zip_with(starts, whole, run)

    return _let(F.array_compact(new), cut_at)


def index_parts(docs: DataFrame) -> int:
    """In how many parts the index of ``docs`` is sorted and written, from the bytes of the texts."""
    return max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))


def indexed_documents(docs: DataFrame) -> int:
    """Documents with a word, counted without an index."""
    return docs.agg(F.count_if(F.lower("text").rlike(WORD))).first()[0]


def store_index(index: DataFrame, path: str, shards: int, parts: int | None = None) -> DataFrame:
    """Write an index in folders by a hash of the term, and read it back.

    The rows of a folder are dealt to as many files as its share of ``parts`` asks for, by a hash of the document,
    so a common word is spread over all of them.  Each file is in order of terms: a reader that
    asks for few terms opens their folders only, and skips the parts of a file whose
    terms are not asked for.  ``parts`` comes from the texts (``index_parts``), or else the rows are counted: a
    part is sorted in memory however large the table is, and no text is taken apart a second time to find bounds.
    ``shard`` is the document's shard, unless the index has that column.  Next to the index are the documents of each
    shard (``index_sizes``) and the totals of each term (``stored_term_stats``), counted once.
    """
    spark = index.sparkSession
    if parts is None:
        parts = max(1, -(-index.count() // PART_ROWS))
    if "shard" not in index.columns:
        index = index.withColumn("shard", shard_of(F.col("doc_id"), shards))
    placed = index.withColumn(BUCKET, term_bucket(F.col("term")))
    each = -(-parts // BUCKETS)
    place = F.col(BUCKET) * each + F.pmod(F.xxhash64("doc_id"), F.lit(each)).cast("int")
    part = F.floor(place * F.lit(parts).cast("bigint") / (BUCKETS * each)).cast("int")
    dealt = placed.repartitionById(parts, part).sortWithinPartitions(BUCKET, "term", "doc_id")
    with small_splits(spark):
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/terms")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/terms")
    stored.groupBy("shard").agg(_documents().alias("docs")).write.mode("overwrite").parquet(f"{path}/sizes")
    stored.groupBy("term").agg(*_term_totals()).write.mode("overwrite").parquet(f"{path}/totals")
    return stored


def stored_term_stats(spark: SparkSession, path: str) -> DataFrame:
    """``term_stats`` of a stored index, from the totals next to it."""
    total = index_sizes(spark, path).select(F.sum("docs"))
    totals = spark.read.schema("term string, df bigint, cf bigint, first_pos int").parquet(f"{path}/totals")
    return totals.withColumn("idf", idf(total.scalar(), F.col("df")))


def index_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Documents of each shard of a stored index."""
    return spark.read.schema("shard bigint, docs bigint").parquet(f"{path}/sizes")


BUCKET, BUCKETS = "term_bucket", 32


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def idf(total: Column, df: Column) -> Column:
    return 1 + F.ln(total / (df + 1))


def _documents() -> Column:
    """Number of indexed documents: each has one term at its first position."""
    return F.count_if(F.col("first_pos") == 0)


def _term_totals() -> list[Column]:
    return [F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.min("first_pos").alias("first_pos")]


def term_stats(index: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Per term: documents, occurrences, earliest position and idf."""
    total = index.select(_documents()) if sizes is None else sizes.select(F.sum("docs"))
    return (
        index.groupBy("term")
        .agg(*_term_totals())
        .withColumn("idf", idf(total.scalar(), F.col("df")))
    )


def _asked(queries: DataFrame) -> DataFrame:
    """One row per query and distinct asked term."""
    return queries.select(
        "query_id",
        F.size(F.array_distinct("terms")).alias("asked"),
        F.explode(F.array_distinct("terms")).alias("term"),
    )


def matches(
    index: DataFrame, queries: DataFrame, shards: int | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """Score of every document that contains an asked term.

    The postings of the asked terms are read once, before anything is counted or
    shuffled, and kept: statistics and scores come from them.  ``sizes`` has the number
    of documents per shard (``index_sizes``); without it they are counted from the
    index.  ``shards`` takes document counts from the document's own shard instead
    of the whole index.  The weights have one row per query and asked term (and shard):
    a short list is broadcast, and with a long one the most common terms are cut
    into blocks, so no task gets all documents of a term.
    """
    asked = cut(_asked(queries))
    terms = asked.select("term").distinct()
    on = ["term"]
    if BUCKET in index.columns:
        terms, on = terms.withColumn(BUCKET, term_bucket(F.col("term"))), [BUCKET, "term"]
    if (terms.agg(F.sum(row_bytes(terms))).first()[0] or 0) <= BROADCAST_BYTES:
        terms = F.broadcast(terms)
    wanted = index.join(terms, on, "left_semi").select("term", "doc_id", "tf", "doc_len")
    postings = stored_rows(wanted, "postings")
    if shards is None:
        key = ["term"]
        stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
        total = index.select(_documents()) if sizes is None else sizes.select(F.sum("docs"))
        stats = stats.withColumn("idf", idf(total.scalar(), F.col("rows")))
    else:
        key = ["term", "shard"]
        postings = postings.withColumn("shard", shard_of(F.col("doc_id"), shards))
        if sizes is None:
            own = index.withColumn("shard", shard_of(F.col("doc_id"), shards))
            sizes = own.groupBy("shard").agg(_documents().alias("docs"))
        stats = postings.groupBy("term", "shard").agg(F.count(F.lit(1)).alias("rows"))
        stats = stats.join(sizes, "shard").withColumn("idf", idf(F.col("docs"), F.col("rows")))
    weights = cut(asked.join(stats, "term"))
    counts = weights.select(*key, "rows").distinct()
    # A document's postings meet before they are scored, so scores are added where they arise and none is shuffled;
    # tasks are as many as the measured number of additions asks for.
    hits = weights.agg(F.sum("rows")).first()[0] or 0
    tasks = max(1, -(-hits // TASK_HITS))
    postings = postings.repartition(tasks, "doc_id")
    hits = checked_join(postings, weights.drop("rows"), key, counts).select(
        "query_id",
        "doc_id",
        "asked",
        (F.sqrt("tf") * F.col("idf") * F.col("idf") / F.sqrt("doc_len")).alias("weight"),
    )
    return hits.groupBy("query_id", "doc_id").agg(
        F.round(
            F.count(F.lit(1)) / F.first("asked") * F.sum("weight"), PLACES
        ).alias("score")
    )


def _best() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id")]


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, sizes: DataFrame | None = None
) -> DataFrame:
    """Best ``k`` documents of each query."""
    return top_k(matches(index, queries, sizes=sizes), ["query_id"], _best(), k)


def search_sharded(
    index: DataFrame,
    queries: DataFrame,
    shards: int,
    k: int = 10,
    shard_stats: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Scatter and gather: best ``k`` of each shard, then the best ``k`` of those."""
    scored = matches(index, queries, shards if shard_stats else None, sizes)
    scored = scored.withColumn("shard", shard_of(F.col("doc_id"), shards))
    local = top_k(scored, ["query_id", "shard"], _best(), k).drop("place")
    return top_k(local, ["query_id"], _best(), k)


def replay_queries(
    index: DataFrame,
    queries: DataFrame,
    slots: DataFrame,
    slot: str,
    k: int = 10,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Run a query list over and over, slot by slot, and report hits per query.

    Slots are counted per query before anything is joined.  The zero-hit share is
    the part of all slots whose query finds nothing.
    """
    listed = running(
        queries.select("query_id"), [], ["query_id"], sums={"turn": F.lit(1)}
    ).select("query_id", (F.col("turn") - 1).alias("turn"))
    size = queries.select(F.count(F.lit(1))).scalar()
    runs = slots.groupBy(F.pmod(F.col(slot), size).alias("turn")).agg(
        F.count(F.lit(1)).alias("runs")
    )
    found = matches(index, queries, sizes=sizes).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    hits = F.coalesce("hits", F.lit(0))
    report = cut(
        listed.join(runs, "turn")
        .join(found, "query_id", "left")
        .select("query_id", "runs", hits.alias("hits"), F.least(hits, F.lit(k)).alias("returned"))
    )
    empty = report.select(
        F.sum(F.when(F.col("hits") == 0, F.col("runs")).otherwise(0)) / F.sum("runs")
    )
    return report.withColumn("zero_hit_share", empty.scalar())


def shard_sizes(docs: DataFrame, shards: int) -> DataFrame:
    """Rows and text bytes of each shard, and its share of all bytes."""
    # Lengths are taken where a text is read; the texts themselves do not move.
    sizes = docs.groupBy(shard_of(F.col("doc_id"), shards).alias("shard")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes")
    )
    # One row per shard is left, so the texts need not be read again for the total.
    total = F.sum("bytes").over(Window.partitionBy())
    return sizes.withColumn("share", F.col("bytes") / total)
