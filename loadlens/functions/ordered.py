"""Running totals, maxima and last values in the order of each group.

A window function puts a whole group into one task.  That is fine while groups
are small and fails when one group holds a third of a large table.  ``running``
measures the largest group first and takes one of two plans with equal results:

* every group within ``group_limit`` rows and ``group_bytes`` bytes: one window per group;
* otherwise the rows are range partitioned by (group, order), which cuts a large
  group into many slices; windows run inside the slices, and each slice gets the
  value carried in from the slices before it.  Only the first group of a slice
  can have rows before it, so there are fewer carried rows than slices.

``group_limit`` is the session's ``spark.loadlens.groupLimit``, or GROUP_LIMIT; a group
of wide rows is split from ``spark.loadlens.groupBytes``, or GROUP_BYTES, on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DataType, StructType

from loadlens.functions.lineage import cut

GROUP_LIMIT = 4_000_000
LIMIT_SETTING = "spark.loadlens.groupLimit"
GROUP_BYTES = 512 << 20
BYTES_SETTING = "spark.loadlens.groupBytes"

# Bounds of range partitions are kept on the driver.
MOST_SLICES = 100_000
_SLICE, _POS = "_slice", "_pos"


def group_limit(spark: SparkSession) -> int:
    """Rows a group may have before it is split."""
    return int(spark.conf.get(LIMIT_SETTING, str(GROUP_LIMIT)))


def group_bytes(spark: SparkSession) -> int:
    """Bytes a group may have before it is split."""
    return int(spark.conf.get(BYTES_SETTING, str(GROUP_BYTES)))


def _fixed(kind: DataType) -> int:
    """Bytes of a value besides its contents: eight, and those of a struct's fields."""
    return 8 + (sum(_fixed(f.dataType) for f in kind) if isinstance(kind, StructType) else 0)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: eight a column or field, and the contents of texts and lists of fixed-size values."""
    total = F.lit(sum(_fixed(f.dataType) for f in df.schema))
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith("array"):
            total = total + 8 * F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0))
    return total.cast("bigint")


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int, int, int]:
    """Rows and bytes of the largest groups, and of all rows (map-side combined; one row comes back)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b"))
    return tuple(x or 0 for x in sizes.agg(F.max("n"), F.max("b"), F.sum("n"), F.sum("b")).first())


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group."""
    return group_sizes(df, keys)[0]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition on all keys in which NULL equals NULL."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    before: bool = False,
    measure: DataFrame | int | None = None,
) -> DataFrame:
    """Add running aggregates over the rows of a group up to the current row.

    ``sums`` (0 when empty), ``maxes`` and ``lasts`` (last value that is not NULL)
    map new column names to expressions.  ``before=True`` leaves the current row
    out.  ``order`` must be total inside a group for the result to be unique.

    ``measure`` is a frame with the same keys and at least as many rows in every
    group that costs less to count than ``df``, or the size of the largest group.
    """
    sums, maxes, lasts = dict(sums or {}), dict(maxes or {}), dict(lasts or {})
    keys, order = list(keys), list(order)
    end = -1 if before else Window.currentRow

    def windowed(frame: DataFrame, by: list[str]) -> DataFrame:
        span = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        added = {c: F.coalesce(F.sum(x).over(span), F.lit(0)) for c, x in sums.items()}
        added |= {c: F.max(x).over(span) for c, x in maxes.items()}
        added |= {c: F.last(x, ignorenulls=True).over(span) for c, x in lasts.items()}
        return frame.withColumns(added)

    most_rows, most_bytes = group_limit(df.sparkSession), group_bytes(df.sparkSession)
    if isinstance(measure, int):
        rows, size, all_rows, all_bytes = measure, 0, measure, 0
    else:
        rows, size, all_rows, all_bytes = group_sizes(df if measure is None else measure, keys)
    if rows <= most_rows and size <= most_bytes:
        return windowed(df, keys)

    # Slice numbers come from sampled range bounds.  The cut makes them a stored
    # fact, equal in both branches below and after the loss of an executor.
    # As many slices as the measured rows and bytes ask for.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MOST_SLICES, max(parts, -(-all_rows // most_rows), -(-all_bytes // most_bytes)))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    sliced = cut(ranged.withColumn(_SLICE, F.spark_partition_id()))

    by = [_SLICE, *keys]
    placed = sliced.withColumn(_POS, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    totals = [F.sum(x).alias(f"_t_{c}") for c, x in sums.items()]
    totals += [F.max(x).alias(f"_t_{c}") for c, x in maxes.items()]
    totals += [
        F.max_by(F.when(x.isNotNull(), x), F.when(x.isNotNull(), F.col(_POS))).alias(f"_t_{c}")
        for c, x in lasts.items()
    ]
    per_slice = placed.groupBy(*by).agg(*totals)
    earlier = (
        Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_slice.select(
        *by,
        F.count(F.lit(1)).over(earlier).alias("_earlier"),
        *[F.sum(f"_t_{c}").over(earlier).alias(f"_c_{c}") for c in sums],
        *[F.max(f"_t_{c}").over(earlier).alias(f"_c_{c}") for c in maxes],
        *[F.last(f"_t_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in lasts],
    ).where("_earlier > 0")

    local = windowed(sliced, by)
    # At most one row per slice: its size is bounded by the number of partitions.
    joined = local.join(F.broadcast(carried), same_keys(local, carried, by), "left")
    result = {c: F.col(c) + F.coalesce(F.col(f"_c_{c}"), F.lit(0)) for c in sums}
    result |= {c: F.greatest(F.col(c), F.col(f"_c_{c}")) for c in maxes}
    result |= {c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in lasts}
    return joined.select(*[local[c] for c in df.columns], *[x.alias(c) for c, x in result.items()])
