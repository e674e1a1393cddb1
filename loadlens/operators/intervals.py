"""Joins of intervals and of times within a bound, as equi-joins on cells of time.

An interval is placed on the coarsest-needed level: cells there are at least as wide as it is
long, so it lies in one or two of them.  Levels are powers of four.  Two intervals meet on the
coarser of their levels: each side is listed on its own level and on all coarser levels that the other side has, which
are at most 32.  A pair is kept only in the cell where the later one of both starts, so it comes out
once.  A very long interval costs two cells, however many short ones lie in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.joins import checked_join


def _level(length: Column) -> Column:
    """Least power of four that is not below ``length``, as a number of bits."""
    bits = F.length(F.bin(F.greatest(length, F.lit(1)) - 1))
    return (F.ceil(bits / 2) * 2).cast("int")


def _levels(df: DataFrame) -> list[int]:
    """Levels that occur: at most 32 small numbers."""
    return sorted(r[0] for r in df.select("_level").distinct().collect())


def _in_cells(df: DataFrame, side: str, levels: Sequence[int]) -> DataFrame:
    every = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")
    wide = F.filter(F.array_union(F.array("_level"), every), lambda x: x >= F.col("_level"))
    listed = df.select("*", F.explode(wide).alias("_on"))
    first, last = (F.call_function("shiftright", F.col(c), F.col("_on")) for c in ("_start", "_last"))
    listed = listed.select("*", F.explode(F.sequence(first, last)).alias("_cell"))
    return listed.withColumnsRenamed({"_level": f"_level_{side}", "_start": f"_start_{side}", "_last": f"_last_{side}"})


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str]
) -> DataFrame:
    """All pairs of rows with equal keys whose intervals ``[start, end)`` overlap, and the overlap's length.

    Spans name whole-number columns.  Intervals without length, the wrong way round or with NULL overlap
    nothing, and NULL keys equal nothing.  All columns are kept (the sides share only the key columns' names), and
    ``overlap`` is added.  Frequent (keys, cell) are cut into blocks where the other side is not small.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")

    def placed(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        start, end = F.col(span[0]).cast("bigint"), F.col(span[1]).cast("bigint")
        real = df.where(start < end)
        return real.withColumns({"_start": start, "_last": end - 1, "_level": _level(end - start)})

    a, b = placed(left, left_span), placed(right, right_span)
    a, b = _in_cells(a, "a", _levels(b)), _in_cells(b, "b", _levels(a))
    by = [*keys, "_on", "_cell"]
    sizes = a.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    met = checked_join(a, b, by, sizes)
    later, sooner = F.greatest("_start_a", "_start_b"), F.least("_last_a", "_last_b")
    own = F.col("_on") == F.greatest("_level_a", "_level_b")
    owner = F.col("_cell") == F.call_function("shiftright", later, F.col("_on"))
    pairs = met.where(own & owner & (later <= sooner)).withColumn("overlap", sooner - later + 1)
    rest = [c for c in right.columns if c not in keys]
    return pairs.select(*left.columns, *rest, "overlap")


def band_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, after: int, how: str = "inner"
) -> DataFrame:
    """Pairs with equal keys and ``left_time <= right_time <= left_time + after`` (whole numbers).

    ``how="left"`` keeps the rows of ``left`` without a partner.  Cells are as wide as the bound, so a row of
    ``left`` looks into two of them.  Rows of ``left`` are told apart by all their values; equal rows
    give equal results.  NULL keys and times have no partner.
    """
    width = F.lit(after + 1)

    def cell(time: Column) -> Column:
        return F.floor(time / width).cast("bigint") if after >= 0 else time

    start = F.col(left_time).cast("bigint")
    cells = F.explode(F.array_distinct(F.array(cell(start), cell(start + after))))
    a = left.where(start.isNotNull()).withColumn("_cell", cells)
    b = right.withColumn("_cell", cell(F.col(right_time).cast("bigint")))
    by = [*keys, "_cell"]
    sizes = a.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    apart = F.col(right_time) - F.col(left_time)
    pairs = checked_join(a, b, by, sizes).where((apart >= 0) & (apart <= after)).drop("_cell")
    pairs = pairs.select(*left.columns, *[c for c in right.columns if c not in keys])
    if how == "inner":
        return pairs
    if how != "left":
        raise ValueError(f"how is {how}")
    whole = F.struct(*[F.col(c) for c in left.columns])
    found = pairs.select(whole.alias("_row")).distinct()
    alone = left.withColumn("_row", whole).join(found, "_row", "left_anti").drop("_row")
    return pairs.unionByName(alone, allowMissingColumns=True)
