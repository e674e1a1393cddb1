"""Joins that stay balanced when one key holds a large part of the rows.

Adaptive execution splits a skewed partition of a plain join by itself.  It does
not when the other side is already placed by an aggregation, so these joins cut
the few very frequent keys into blocks beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loadlens.functions.lineage import cut
from loadlens.functions.ordered import group_limit, row_bytes, same_keys

#: A side may be broadcast up to this many measured bytes.
BROADCAST_BYTES = 32 << 20


def split_join(
    rows: DataFrame, other: DataFrame, keys: Sequence[str], sizes: DataFrame, how: str = "inner", *, merge: bool = False
) -> DataFrame:
    """Join ``rows`` (inner or left) to ``other`` on equal keys.

    ``sizes`` has the keys and ``rows``, the number of rows per key.  A key above
    the group limit is cut into blocks: its rows by a hash of their content, while
    its rows of ``other`` go to every block.  With ``merge`` both sides are sorted, however small Spark takes them for.
    """
    keys = list(keys)
    limit = group_limit(rows.sparkSession)
    blocks = F.ceil(F.col("rows") / limit).cast("int").alias("_blocks")
    # All rows divided by the limit bounds the number of frequent keys.
    hot = cut(sizes.where(F.col("rows") > limit).select(*keys, blocks))
    if hot.isEmpty():
        return rows.join(other.hint("merge") if merge else other, keys, how)

    count = F.coalesce("_blocks", F.lit(1))
    content = F.xxhash64(*rows.columns)

    def marked(df: DataFrame) -> DataFrame:
        found = df.join(F.broadcast(hot), same_keys(df, hot, keys), "left")
        return found.select(*[df[c] for c in df.columns], count.alias("_blocks"))

    left = marked(rows).withColumn("_block", F.pmod(content, F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")
    right = marked(other).select(*other.columns, every)
    right = right.hint("merge") if merge else right
    return left.drop("_blocks").join(right, [*keys, "_block"], how).drop("_block")


def checked_join(
    rows: DataFrame, other: DataFrame, keys: Sequence[str], sizes: DataFrame, how: str = "inner", *, merge: bool = False
) -> DataFrame:
    """Broadcast ``other`` if its measured bytes are few, else ``split_join`` (with ``merge``, if asked for)."""
    if (other.agg(F.sum(row_bytes(other))).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(other), list(keys), how)
    return split_join(rows, other, keys, sizes, how, merge=merge)
