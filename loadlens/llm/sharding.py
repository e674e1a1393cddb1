"""Sharding by extendible hashing.

A row's address is a 60-bit hash of its key; a bucket is a prefix of the address.  A bucket
that exceeds the byte limit is split on the next bit, others stay, until every
bucket fits.  What counts is narrow: (address, bytes), summed per prefix with map-side
combine.  Splitting goes in rounds: the first looks at as many bits as the total size
calls for, and each later round at ``STEP`` more bits of the oversized buckets only, so the
directory never has more entries than a few times the number of shards.

Rows that share an address cannot be parted by hashing.  If they exceed the limit,
the bucket goes on as overflow pages: rows in order of key and content, a new page
whenever the running size passes a multiple of the limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.ordered import running
from loadlens.llm.common import stored

BITS = 60
STEP = 8
LIMIT = 64 << 20


def address(key: str) -> Column:
    """First 60 bits of the MD5 of the key as text; a missing key counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column | int, of: str = "_address") -> Column:
    """The first ``bits`` bits of an address."""
    shift = (F.lit(BITS) - bits).cast("int") if isinstance(bits, Column) else F.lit(BITS - bits)
    return F.call_function("shiftright", F.col(of), shift)


def _leaves(cells: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """Buckets of depth start..depth, from bytes per cell of ``depth`` bits: depth, prefix, bytes, rows, oversized.

    A bucket is a leaf if it fits, or holds a single address, or has no bits left in
    this round, and the bucket above it is none.
    """
    levels = F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth")
    at = cells.select(levels, "*").withColumn("prefix", F.call_function("shiftright", "_cell", F.lit(depth) - F.col("depth")))
    nodes = at.groupBy("depth", "prefix").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    nodes = stored(nodes.withColumn("_fits", (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))), "nodes")
    above = nodes.where("not _fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_above"))
    child = nodes.withColumn("_above", F.call_function("shiftright", "prefix", F.lit(1)))
    reached = nodes.where(F.col("depth") == start).unionByName(
        child.where(F.col("depth") > start).join(above, ["depth", "_above"], "left_semi").select(*nodes.columns)
    )
    return reached.where(F.col("_fits") | (F.col("depth") == depth))


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, list[int]]:
    """The buckets of rows (``_address``, ``_bytes``), and the depths that rounds of splitting went to."""
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    depth = min(BITS, max(1, (total // limit).bit_length() + 2))
    start, rounds, left, found = 0, [], rows, []
    while True:
        cells = left.groupBy(_prefix(depth).alias("_cell")).agg(
            F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("_address").alias("low"), F.max("_address").alias("high")
        )
        leaves = stored(_leaves(cells, start, depth, limit), "buckets")
        rounds.append(depth)
        found.append(leaves.where("_fits"))
        large = leaves.where("not _fits").select("prefix")
        if depth == BITS or large.isEmpty():
            return reduce(DataFrame.unionByName, found), rounds
        left = left.withColumn("prefix", _prefix(depth)).join(large, "prefix", "left_semi").drop("prefix")
        start, depth = depth, min(BITS, depth + STEP)


def shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, depth, prefix, page, shard_rows, shard_bytes.

    A shard is (depth, prefix, page); its bytes are those of its texts in UTF-8 (NULL: 0)
    and do not exceed ``limit``, unless it is one row or rows of one address: pages of
    an address end with the row that passes a multiple of the limit, so they exceed it
    by less than a row.  Missing ids share an address; repeated rows are placed one
    after the other; other columns are not read; an empty table gives no rows.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    content = F.xxhash64(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), address(doc_id).alias("_address"), size.alias("_bytes"), content.alias("_content"))
    rows = stored(rows, "addresses")
    buckets, rounds = directory(rows, limit)
    buckets = stored(buckets.select("depth", "prefix", "bytes", F.col("rows").alias("in_bucket"), (F.col("low") == F.col("high")).alias("single")), "directory")
    placed, rest = [], rows
    start = 0
    for last in rounds:
        # The directory of this round names every cell of ``last`` bits, or sends it on.
        part = buckets.where((F.col("depth") > start) | (start == 0)).where(F.col("depth") <= last)
        spread = F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.lit(last) - F.col("depth")) - 1))
        cells = part.select("*", spread.alias("_low")).withColumn(
            "_cell", F.call_function("shiftleft", "prefix", F.lit(last) - F.col("depth")) + F.col("_low")
        )
        joined = rest.withColumn("_cell", _prefix(last)).join(cells.drop("_low"), "_cell", "left").drop("_cell")
        placed.append(joined.where("depth is not null"))
        rest = joined.where("depth is null").select(*rows.columns)
        start = last
        if last == rounds[-1]:
            break
    found = reduce(DataFrame.unionByName, placed)
    whole = found.where(F.col("bytes") <= limit).select(
        "doc_id", F.col("_bytes").alias("n_bytes"), "depth", "prefix", F.lit(0).cast("long").alias("page"),
        F.col("in_bucket").alias("shard_rows"), F.col("bytes").alias("shard_bytes"),
    )
    large = found.where(F.col("bytes") > limit)
    if buckets.where(F.col("bytes") > limit).isEmpty():
        return whole
    paged = running(large, ["depth", "prefix"], ["doc_id", "_content", "_bytes"], sums={"_before": F.col("_bytes")}, before=True)
    paged = stored(paged.withColumn("page", F.floor(F.col("_before") / limit)), "pages")
    sizes = paged.groupBy("depth", "prefix", "page").agg(F.count(F.lit(1)).alias("shard_rows"), F.sum("_bytes").alias("shard_bytes"))
    pages = paged.join(sizes, ["depth", "prefix", "page"]).select(
        "doc_id", F.col("_bytes").alias("n_bytes"), "depth", "prefix", "page", "shard_rows", "shard_bytes"
    )
    return whole.unionByName(pages)


#: The same shards by counting every prefix of every address (for unique ids).
SQL = """
with s as (
  select doc_id, octet_length(encode(coalesce(text, '')))::bigint as n_bytes,
    ('0x' || md5(coalesce(doc_id::varchar, ''))[1:15])::bigint as address from documents),
p as (select *, unnest(range(0, 61)) as depth from s),
q as (select *, address >> (60 - depth)::int as prefix from p),
n as (
  select depth, prefix, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_rows,
    sum(n_bytes) <= {limit} or min(address) = max(address) as fits
  from q group by depth, prefix)
select doc_id, n_bytes, depth, prefix, 0::bigint as page, shard_rows, shard_bytes
from q join n using (depth, prefix) where fits
qualify row_number() over (partition by doc_id order by depth) = 1
"""
