"""Joins, groups and set operations on node, role and key tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.functions.ordered import running


# The largest k for which Spark limits groups before the shuffle.
PUSHED_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def not_ready(nodes: DataFrame, logs: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose log has no line that matches the ready pattern."""
    ready = logs.where(F.col("line").rlike(pattern)).select("node").distinct()
    return nodes.join(ready, "node", "left_anti")


def in_allocation(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the allow list."""
    return df.join(allowed.select(key), key, "left_semi")


def enrich(rows: DataFrame, names: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """Add the columns of a map table by key; rows without an entry stay.

    The map is unique by key.  It is broadcast when its measured size allows it
    and joined by a shuffle otherwise, so no hint is given here.
    """
    joined = rows.join(names, key, "left")
    if default is None:
        return joined
    return joined.fillna(default, [c for c in names.columns if c != key])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """First ``k`` rows of each group, numbered from 1.

    For a small ``k`` Spark keeps at most ``k`` rows per group and input partition
    before the shuffle, so a large group does not reach one task whole.
    """
    if k > int(df.sparkSession.conf.get(PUSHED_SETTING, "1000")):
        return running(df, by, order, sums={"place": F.lit(1)}).where(F.col("place") <= k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place.cast("bigint")).where(F.col("place") <= k)


def group_members(
    df: DataFrame, group: str, member: str, per_row: int = 1000
) -> DataFrame:
    """Ordered members of each group, at most ``per_row`` of them in one row.

    A small group is one row; the lists of a large one go on in rows ``part`` 1,
    2, ..., so no row and no task has to hold a whole group.
    """
    members = df.select(group, member).distinct()
    numbered = running(members, [group], [member], sums={"n": F.lit(1)}, measure=df)
    part = F.floor((F.col("n") - 1) / per_row).alias("part")
    return numbered.groupBy(group, part).agg(
        F.array_sort(F.collect_list(member)).alias("members")
    )


def all_roles(*frames: DataFrame) -> DataFrame:
    """Rows of several roles in one table, duplicates kept."""
    return reduce(DataFrame.unionByName, frames)


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Set of keys seen."""
    return df.select(*keys).dropDuplicates()


def missing(wanted: DataFrame, done: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Wanted minus done, as a set or, on request, with duplicates counted."""
    return wanted.exceptAll(done) if keep_duplicates else wanted.subtract(done)
