"""Quantiles from sketches that are stored per interval and merged at any time.

A KLL sketch holds a few hundred values whatever the number of rows.  Merging those of
many intervals gives a sketch as good as one made in a single pass; its rank error is about
``1.65 / k`` at the usual 99 % confidence (0.8 % for the size used here).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.joins import checked_join

#: Size parameter of the sketches.
K = 200


def sketched(value: Column, k: int = K) -> Column:
    """Aggregate: sketch of a number column; NULLs are left out."""
    return F.kll_sketch_agg_double(value.cast("double"), F.lit(k))


def store_sketches(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One sketch per group: the keys, ``sketch`` and ``n``, small enough to keep for every interval."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(sketched(F.col(value)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged_quantiles(sketches: DataFrame, by: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """Quantiles over any union of stored sketches: the keys, ``n`` and a column per wanted fraction."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(c) for c, p in wanted.items()]
    return merged.select(*by, "n", *found)


def rank_error(df: DataFrame, estimates: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """How far each estimate is from the rank asked for, as a share of the group: exact, by counting.

    An estimate that occurs several times has a range of ranks; the nearest end counts.
    """
    sizes = estimates.select(*by, F.col("n").alias("rows"))
    rows = checked_join(df.where(F.col(value).isNotNull()), estimates.drop("n"), list(by), sizes)
    v, counts = F.col(value).cast("double"), []
    for c in wanted:
        counts += [F.count_if(v < F.col(c)).alias(f"_below_{c}"), F.count_if(v <= F.col(c)).alias(f"_upto_{c}")]
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts)
    errors = []
    for c, p in wanted.items():
        low, high = F.col(f"_below_{c}") / F.col("n"), F.col(f"_upto_{c}") / F.col("n")
        errors.append(F.greatest(low - p, F.lit(p) - high, F.lit(0.0)).alias(c))
    return found.select(*by, "n", *errors)
