"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the mix in words; the ratio of target and size is
the number of copies a document is due.  Whole copies are certain.  The rest of the
target is filled by a Pareto sample: every document has a fixed random number
``u``, its rank is the odds of ``u`` divided by the odds of its inclusion
probability, and documents are taken in rank order up to the fixed size, counted
in words.  Probabilities differ between sources and, with ``tilt``, inside them.

No source is sorted as a whole.  Ranks are mapped to 0..1 and words are summed per
source and cell of ranks with map-side combine; three rounds, each 4096 times finer,
find the cell in which a source reaches its size, and only that cell is ordered.
Whether a row is taken then follows from its own rank and its source's cut.

What a plan costs the driver grows with its joins, so sources are counted once, a round
joins one table (a row per source with all it has to know), and sums of one row go on as numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from loadlens.functions.ordered import group_bytes, row_bytes, running
from loadlens.llm.common import WORD, spare, stored

#: Rows of the table of sources that may be broadcast (a name and seven numbers each).
BROADCAST_SOURCES = 10_000
BROADCAST_NAME_CHARS = 8 << 20

_ROUNDS = (12, 24, 36)


def size_in_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _counted(sizes: DataFrame) -> Row:
    """Rows, characters and bytes of the names, and words of all sources."""
    names = F.coalesce(F.sum(F.length("source")), F.lit(0)).alias("chars")
    size = F.coalesce(F.sum(row_bytes(sizes)), F.lit(0)).alias("bytes")
    return sizes.agg(F.count(F.lit(1)).alias("n"), names, size, F.sum("source_size").alias("words")).first()


def targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, counted: Row | None = None
) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, NULL last, weigh ``weights``, repeated.  Targets add up
    to ``share`` of all sizes; one above ``most`` times its source stops there
    and the excess goes to the others by weight.  The common level, words for each
    unit of weight, is the largest of the levels that leave out the 0, 1, 2, ...
    sources which reach their stop first.
    """
    counted = counted or _counted(sizes)
    # More columns follow; a table near the limit is measured again.
    measure = counted.n if 8 * counted.bytes <= group_bytes(sizes.sparkSession) else None
    weight = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("_rank", F.col("source").isNull())
    ranked = running(named, [], ["_rank", "source"], sums={"_at": F.lit(1)}, before=True, measure=measure)
    weighed = ranked.withColumn("_weight", F.element_at(weight, (F.col("_at") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("_stop", F.lit(float(most)) * F.col("source_size"))
    weighed = stored(weighed.withColumn("_first", F.col("_stop") / F.col("_weight")), "weights")
    filled = running(
        weighed, [], ["_first", "_at"], sums={"_stops": F.col("_stop"), "_weights": F.col("_weight")}, before=True, measure=measure
    )
    rounds, rest = divmod(counted.n, len(weights))
    all_weights = rounds * float(sum(weights)) + float(sum(weights[:rest]))
    level = (F.lit(float(share)) * F.lit(counted.words) - F.col("_stops")) / (F.lit(all_weights) - F.col("_weights"))
    level = filled.agg(F.max(level)).first()[0]
    target = F.least("_stop", F.lit(level).cast("double") * F.col("_weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def _by_source(rows: DataFrame, sources: DataFrame, few: bool, how: str = "left") -> DataFrame:
    """Join on the source, NULL equal to NULL; ``few`` sources are broadcast."""
    other = sources.withColumnRenamed("source", "_source")
    return rows.join(
        F.broadcast(other) if few else other, rows["source"].eqNullSafe(other["_source"]), how
    ).drop("_source")


def with_rank(rows: DataFrame, tilt: Column | None = None, seed: int = 7) -> DataFrame:
    """Add ``_key`` and ``_v``: the Pareto rank mapped to 0..1.  Needs ``_p``, the inclusion probability."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    odds = (1 - F.col("_p")) / F.when(F.col("_p") > 0, F.col("_p")) / (F.lit(1.0) if tilt is None else tilt)
    rank = u / (1 - u) * odds
    return rows.withColumn("_key", key).withColumn("_v", rank / (1 + rank))


def cuts(sized: DataFrame, plan: DataFrame, few: bool, tilt: Column | None = None, seed: int = 7) -> DataFrame:
    """One row per source: whole copies, and the rank (``_cut_v``, ``_cut_key``) up to which rows are taken once more."""
    plan = stored(
        plan.withColumn("_ratio", F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0)))
        .withColumn("_whole", F.floor("_ratio").cast("int"))
        .withColumn("_p", F.col("_ratio") - F.col("_whole"))
        .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")),
        "plan",
    )

    def cell(bits: int) -> Column:
        return F.floor(F.col("_v") * float(1 << bits)).cast("long")

    def inside(at: DataFrame, bits: int) -> DataFrame:
        """The rows in the cell that ``at`` names for their source; all rows of its sources before the first round."""
        ranked = with_rank(_by_source(sized.where("size > 0"), at, few, "inner"), tilt, seed)
        return ranked.where(cell(bits) == F.col("_cell")) if bits else ranked

    # A cell lies within that of the round before: the last one is enough.
    at, known = plan.where("_p > 0").select("source", "_p", "_rest", F.lit(0).cast("long").alias("_start")), 0
    for bits in _ROUNDS:
        counted = inside(at, known).groupBy("source", cell(bits).alias("_in")).agg(
            F.sum("size").alias("_words"), *[F.first(c).alias(c) for c in ("_p", "_rest", "_start")]
        )
        # At most 4096 cells a source and round.
        upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_in")) + F.col("_start")
        crossing = counted.withColumn("_upto", upto).where("_upto >= _rest and _upto - _words < _rest")
        start = (F.col("_upto") - F.col("_words")).alias("_start")
        at, known = stored(crossing.select("source", "_p", "_rest", start, F.col("_in").alias("_cell")), "cells"), bits
    draws = inside(at, known).groupBy("source", "_v", "_key").agg(
        F.sum("size").alias("_words"), F.first("_start").alias("_before"), F.first("_rest").alias("_rest")
    )
    # Measured and then ordered.
    draws = stored(draws, "draws")
    ordered = running(draws, ["source"], ["_v", "_key"], sums={"_upto": F.col("_words")})
    after = F.col("_before") + F.col("_upto")
    # A draw across the limit is taken if that comes nearer to it.
    taken = 2 * after - F.col("_words") <= 2 * F.col("_rest")
    last = F.max(F.when(taken, F.struct("_v", "_key")))
    # Nothing of the cell taken: the cut lies just before its first draw.
    none = F.struct(F.min("_v").alias("_v"), F.lit(None).cast("string").alias("_key"))
    cut = ordered.groupBy("source").agg(F.coalesce(last, none).alias("_cut"))
    return _by_source(plan, cut.select("source", F.col("_cut._v").alias("_cut_v"), F.col("_cut._key").alias("_cut_key")), few)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, tilt: Column | None = None, seed: int = 7
) -> DataFrame:
    """All columns of ``docs`` and, last, a struct ``_mix``: size, source_size, target, copies, taken.

    The struct's name is longer if ``docs`` has a column ``_mix``.

    ``size`` counts words (NULL text: 0) and ``taken`` is ``copies * size``.  The words
    taken from a source differ from its target by at most half of one draw, usually
    one document.  Draws follow from ``doc_id`` and ``seed``, so a second run agrees;
    rows that share a doc_id (or lack one) and a source share a draw and are
    taken together.  Texts without words get the whole copies only.  NULL is a
    source of its own.  An empty table gives no rows.  ``tilt``, a positive column
    over doc_id, source and size, multiplies the odds of inclusion.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_in_words(text).alias("size"))
    sized = stored(narrow, "sizes")
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    counted = _counted(sizes)
    few = counted.n <= BROADCAST_SOURCES and counted.chars <= BROADCAST_NAME_CHARS
    cut = stored(cuts(sized, targets(sizes, weights, share, most, counted), few, tilt, seed), "cuts")
    state = F.struct(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_in_words(text).alias("size"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("_row"), state.alias("_state")).select("_row", "_state.*")
    ranked = with_rank(_by_source(rows, cut, few), tilt, seed)
    once_more = (F.col("_v") < F.col("_cut_v")) | ((F.col("_v") == F.col("_cut_v")) & (F.col("_key") <= F.col("_cut_key")))
    copies = (F.col("_whole") + F.coalesce(once_more, F.lit(False)).cast("int")).alias("copies")
    mixed = ranked.select("_row", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return mixed.select("_row.*", F.struct("size", "source_size", "target", "copies", "taken").alias(spare(docs, "_mix")))


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of the input.

    ``mixed`` is the result of ``mix``, whose struct is the last column.
    """
    state = mixed.columns[-1]
    copies = F.explode(F.array_repeat(F.lit(0), F.col(f"`{state}`.copies").cast("int")))
    name = spare(mixed, "_copy")
    return mixed.select("*", copies.alias(name)).drop(state, name)


#: The same mix with one window per source.
SQL = r"""
with s as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
t as (select source, sum(size)::bigint as source_size from s group by source),
w as (
  select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight,
    row_number() over (order by source nulls last) as place from t),
l as (
  select *, coalesce(sum(2.0::double * source_size) over before, 0) as stops, coalesce(sum(weight) over before, 0) as weights,
    sum(source_size) over () as everything, sum(weight) over () as w
  from w window before as (order by 2.0::double * source_size / weight, place rows between unbounded preceding and 1 preceding)),
c as (select max((1.5::double * everything - stops) / (w - weights)) as level from l),
p as (
  select source, source_size, least(2.0::double * source_size, level * weight) as target,
    coalesce(floor(least(2.0::double * source_size, level * weight) / nullif(source_size, 0)), 0) as whole,
    coalesce(least(2.0::double * source_size, level * weight) / nullif(source_size, 0), 0) as ratio
  from w, c),
r as (
  select s.*, source_size, target, whole, target - whole * source_size as rest, ratio - whole as p,
    (('0x' || md5('7:' || coalesce(doc_id::varchar, ''))[1:13])::bigint::double + 0.5) / 4503599627370496.0::double as u
  from s join p on s.source is not distinct from p.source),
v as (select *, case when p > 0 then u / (1 - u) * ((1 - p) / p) end as k from r),
o as (
  select *, sum(size) over (partition by source order by k / (1 + k), doc_id::varchar) as upto from v)
select doc_id, size, source_size, target,
  (whole * size + case when p > 0 and 2 * upto - size <= 2 * rest then size else 0 end)::bigint as taken
from o
"""
