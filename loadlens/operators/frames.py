"""Windows over groups of any size: range frames, ranks by share, sessions.

Everything goes through ``running``, which cuts a group above the limits into slices, so no task
has to hold or sort a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.joins import checked_join
from loadlens.functions.lineage import stored_rows
from loadlens.functions.ordered import running


def range_frame(df: DataFrame, keys: Sequence[str], time: str, value: str, span: int) -> DataFrame:
    """Per group and instant: rows, sum, mean, least and greatest value of ``[time - span, time]``.

    ``time`` and ``value`` are whole numbers; rows without a time are left out, a NULL value counts
    as a row only.  Equal instants are added up first, and rows are by instant.  Time is cut into cells as long as the frame: a frame is the end of one
    cell and the beginning of the next, so it takes one running aggregate in each direction and one
    look-up, however many rows a frame has.
    """
    keys = list(keys)
    v = F.col(value)
    rows = df.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("values"), F.coalesce(F.sum(v), F.lit(0)).alias("total"),
        F.max(v).alias("most"), F.max(-v).alias("least"),
    )
    cell = F.floor(F.col(time) / F.lit(span + 1)).cast("bigint")
    steps = stored_rows(rows.withColumn("_cell", cell), "steps")
    sums = {c: F.col(x) for c, x in (("_n", "n"), ("_values", "values"), ("_total", "total"))}
    maxes = {"_most": F.col("most"), "_least": F.col("least")}
    names = [*sums, *maxes]
    by = [*keys, "_cell"]
    ahead = running(steps, by, [time], sums=sums, maxes=maxes)
    back = running(steps, by, [F.col(time).desc()], sums=sums, maxes=maxes)

    # Each instant asks the cell before its own for everything from time - span on.
    given = back.select(*by, F.col(time).alias("_at"), F.lit(0).alias("_asks"), F.lit(None).cast("bigint").alias("_for"), F.struct(*names).alias("_tail"))
    asks = steps.select(*keys, (F.col("_cell") - 1).alias("_cell"), (F.col(time) - span).alias("_at"), F.lit(1).alias("_asks"), F.col(time).cast("bigint").alias("_for"))
    both = given.unionByName(asks.withColumn("_tail", F.lit(None).cast(given.schema["_tail"].dataType)))
    both = stored_rows(both, "asks")
    found = running(both, by, [F.col("_at").desc(), F.col("_asks"), F.col("_for")], lasts={"_found": F.col("_tail")})
    found = found.where("_asks = 1").select(*keys, F.col("_for").alias(time), F.col("_found").alias("_before"))
    found = found.withColumnsRenamed({c: f"_{c}_" for c in [*keys, time]})
    # One row for each instant on both sides.
    same = F.lit(True)
    for c in [*keys, time]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    joined = ahead.join(found, same)

    def plus(name: str) -> Column:
        return F.col(name) + F.coalesce(F.col(f"_before.{name}"), F.lit(0))

    def most(name: str) -> Column:
        return F.greatest(F.col(name), F.col(f"_before.{name}"))

    values = plus("_values")
    return joined.select(
        *keys, time, plus("_n").alias("rows"), plus("_total").alias("total"),
        (plus("_total") / F.nullif(values, F.lit(0))).alias("mean"), (-most("_least")).alias("least"), most("_most").alias("most"),
    )


def shares(df: DataFrame, keys: Sequence[str], order: Sequence[str], tiles: int, ties: Sequence[str]) -> DataFrame:
    """``df`` with rank, percent_rank, cume_dist and ntile of each row by ``order`` within its group.

    Rows with equal ``order`` are peers; ``ties`` makes the order total, for the tiles.  Peers are counted before
    they are ordered, so rows that share a value over a slice border have one rank.
    """
    keys, order = list(keys), list(order)
    counted = stored_rows(df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_peers")), "peers")
    ranked = running(counted, keys, order, sums={"_upto": F.col("_peers")})
    totals = stored_rows(counted.groupBy(*keys).agg(F.sum("_peers").alias("_of"), F.count(F.lit(1)).alias("rows")), "totals")

    def with_group(rows: DataFrame, other: DataFrame, on: list[str], sizes: DataFrame) -> DataFrame:
        # A struct also matches NULL keys.
        named = rows.withColumn("_group", F.struct(*on))
        other = other.select(F.struct(*on).alias("_group"), *[c for c in other.columns if c not in on])
        sizes = sizes.select(F.struct(*on).alias("_group"), "rows")
        return checked_join(named, other, ["_group"], sizes).drop("_group")

    sizes = totals.select(*keys, "rows") if keys else None
    if keys:
        ranked = with_group(ranked, totals.drop("rows"), keys, sizes)
    else:
        ranked = ranked.crossJoin(F.broadcast(totals.drop("rows")))  # one row
    rank = (F.col("_upto") - F.col("_peers") + 1).alias("rank")
    ranked = stored_rows(ranked.select(*keys, *order, rank, "_upto", "_of", "_peers"), "ranks")
    placed = running(df, keys, [*order, *ties], sums={"_place": F.lit(1)})
    by = [*keys, *order]
    joined = with_group(placed, ranked.drop("_peers"), by, ranked.select(*by, F.col("_peers").alias("rows")))
    # The first groups have one row more: n = tiles * small + larger.
    small, larger = F.floor(F.col("_of") / tiles), F.col("_of") % tiles
    head = larger * (small + 1)
    place = F.col("_place") - 1
    tile = F.when(place < head, F.floor(place / (small + 1))).otherwise(larger + F.floor((place - head) / F.greatest(small, F.lit(1))))
    return joined.select(
        *df.columns, "rank", F.when(F.col("_of") > 1, (F.col("rank") - 1) / (F.col("_of") - 1)).otherwise(0.0).alias("percent_rank"),
        (F.col("_upto") / F.col("_of")).alias("cume_dist"), (tile + 1).cast("bigint").alias("ntile"),
    )


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap: int, tie: str) -> DataFrame:
    """Per group: sessions, runs of rows less than ``gap`` after the one before: first, last, rows.

    ``time`` is a whole number and ``tie`` makes the order total; rows without a time are left out.  A session that goes over
    a slice border is one session, since the time before a slice is carried into it.
    """
    keys = list(keys)
    rows = stored_rows(df.where(F.col(time).isNotNull()).select(*keys, time, tie), "times")
    before = running(rows, keys, [time, tie], lasts={"_before": F.col(time)}, before=True, measure=rows)
    new = F.when(F.col("_before").isNull() | (F.col(time) - F.col("_before") >= gap), 1).otherwise(0)
    marked = before.withColumn("_new", new)
    numbered = running(marked, keys, [time, tie], sums={"session": F.col("_new")}, measure=rows)
    found = numbered.groupBy(*keys, "session").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("rows"))
    return found.select(*keys, "session", "first", "last", "rows")
