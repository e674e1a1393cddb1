"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from loadlens.functions.joins import checked_join
from loadlens.functions.lineage import cut, stored_rows
from loadlens.functions.ordered import running


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    *,
    exact: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Per group: ``n`` values that are not NULL and one column per wanted quantile.

    ``wanted`` maps column names to fractions; values between two ranks are
    interpolated.  Equal values are counted before any ordering, so the ordered
    rows are the distinct values of a group, and a group with very many of them
    is split by ``running``.  ``weight`` names a column that says how often a row counts.
    ``exact=False`` takes Spark's mergeable sketch.
    """
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    present = df.where(F.col(value).isNotNull())
    if not exact:
        if weight is not None:
            raise ValueError("the sketch takes no weights")
        sketch = [F.percentile_approx(value, F.lit(p), F.lit(10_000)).alias(c) for c, p in wanted.items()]
        return present.groupBy(*by).agg(F.count(value).alias("n"), *sketch)

    # One row per group.  A struct of the keys also matches groups with NULL keys.
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counted = stored_rows(present.groupBy(*by, value).agg(times.alias("_rows")), "counted")
    totals = cut(counted.groupBy(group.alias("_group")).agg(F.sum("_rows").alias("n")))
    ranked = running(counted, by, [value], sums={"_upto": F.col("_rows")})
    ranked = ranked.withColumn("_group", group)
    distinct = ranked.groupBy("_group").agg(F.count(F.lit(1)).alias("rows"))
    joined = checked_join(ranked, totals, ["_group"], distinct)

    picks, results = [], []
    for c, p in wanted.items():
        place = f"({p!r}D * (n - 1))"
        for end, rank in (("lo", f"floor({place})"), ("hi", f"ceil({place})")):
            inside = f"{rank} < _upto AND {rank} >= _upto - _rows"
            picks.append(F.expr(f"max(CASE WHEN {inside} THEN `{value}` END) AS `_{end}_{c}`"))
        rest = f"({place} - floor({place}))"
        results.append(F.expr(f"`_lo_{c}` + (`_hi_{c}` - `_lo_{c}`) * {rest} AS `{c}`"))
    picked = joined.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    return picked.select(*by, "n", *results)
