"""Exact duplicates with a heavy-hitter split.

Texts are equal when their SHA-256 digests are.  Misra-Gries counters (Spark's frequent
items) name every digest that more than ``SUPPORT`` of all rows share, and perhaps
some others: at most 1 / SUPPORT names come out of each task and of the whole, whatever
the data.  An exact count verifies them and finds the row that stays, with
map-side combine.  Verified winners are broadcast, and rows with such a digest are
decided where they are read.  All other rows are grouped by an ordinary shuffle, in
which no digest has more than ``SUPPORT`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.llm.common import spare, stored

#: Digests on more than this share of all rows are decided without a shuffle.
SUPPORT = 1 / 1024


def digest(text: str) -> Column:
    """SHA-256 of a text's UTF-8 bytes in lower-case hex; NULL counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def frequent(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, group_size, keep_id) of the digests on more than ``support`` of all rows."""
    named = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    # A task may name 1 / support digests, and so may the whole: a proven bound.
    candidates = F.broadcast(named)
    counted = rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(*_group())
    least = rows.agg((F.count(F.lit(1)) * support).alias("least"))
    return counted.crossJoin(F.broadcast(least)).where("group_size > least").drop("least")


def _group() -> list[Column]:
    return [F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")]


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays.  Texts are compared as
    they are; NULL equals the empty text.  A row without doc_id stays only if no
    row of its group has one (keep_id is then NULL), and rows that repeat the largest doc_id are all
    marked as kept, since an id cannot tell them apart.  Other columns are not
    read; an empty table gives no rows.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("digest"))
    rows = stored(narrow, "digests")
    heavy = stored(frequent(rows, support), "heavy")
    decided = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    grouped = rest.join(rest.groupBy("digest").agg(*_group()), "digest")
    return decided.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay; columns stay as they are (rows without doc_id cannot be named and stay).

    Rows are told apart by doc_id and text, so a doc_id on different texts loses none of them.
    """
    gone = duplicates(docs, doc_id, text, support).where("not kept and doc_id is not null")
    key, hashed = spare(docs, "_gone"), spare(docs, "_text")
    gone = gone.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(hashed)).hint("shuffle_hash")
    return docs.join(gone, (docs[doc_id] == F.col(key)) & (digest(text) == F.col(hashed)), "left_anti")


SQL = """
with s as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id is not distinct from max(doc_id) over g as kept, text_sha256
from s window g as (partition by text_sha256)
"""
