"""Near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from three steps, each on what the steps before left apart, and every candidate is verified by the
exact similarity of the shingle sets, so a link is never wrong.

1. SimHash: fingerprints of five-word shingles, equal or at most two bits apart, found by the
   byte-position index of ``simhash``.  Texts at 0.8 differ in up to 11 bits, so this
   alone would miss most of them.
2. MinHash: a signature is cut into bands, and texts that agree on a band meet in a bucket.  A pair at
   0.8 meets in none of the bands with a probability of 3 in a million, a closer one more rarely.  A bucket
   offers each text with its smallest one only.
3. Prefixes, for texts of a bucket that are still in different components.  Shingles are
   ordered by how many of these texts have them.  A pair at 0.8 must share one among the
   first of each, and how many of the first follows from both sizes; so sizes are
   cut into classes of five per cent, and a text is listed under its first shingles once for
   each class that a partner may have, and a list holds pairs of those two classes only.  Texts that only share a common passage have it at the end of their order and
   do not meet.  A pair of a list has to pass one more exact bound: the parities of 512 cells that shingles are
   hashed into differ in no more cells than the sets differ in shingles.  A list, too, first offers each text with its smallest one, and then pairs that are still in
   different components.

Texts with equal shingle sets are one class; a class is named by 64 bits and told apart by 64 more.  A large group of copies or
near copies so costs rows, not their square, and no candidate between two components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from loadlens.functions.joins import checked_join
from loadlens.llm.common import ship, small_batches, stored
from loadlens.llm.components import components
from loadlens.llm.simhash import bit_counts, keep_least, linked_fingerprints, majority, shingle_hashes, text_hash

WORDS = 5
#: Least similarity of a link, in tenths.
TENTHS = 8
#: Bands of a signature and minima in a band: 1 - (1 - 0.8 ** 5) ** 32 = 0.999997.
BANDS, ROWS = 32, 5
#: Sizes of a class differ by this factor at most, and a partner is in one of as many classes on each side.
CLASS, CLASSES = 1.05, 5
#: Long words of parities: 64 cells each.
PARITIES = 8
#: Shingles whose hashes are permuted together.
BLOCK = 1 << 12

_draw = np.random.default_rng(42)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; empty for NULL and texts without words."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, WORDS)]))


def buckets(shingles: np.ndarray) -> np.ndarray:
    """One bucket per band; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        permuted = shingles[at : at + BLOCK, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, permuted.min(axis=0))
    found = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(found, np.uint64).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each cell whether it holds an odd number of shingles, as long words."""
    cells = np.bincount((shingles % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES)
    return np.packbits(cells & 1).view(np.int64)


_P = [f"p{k}" for k in range(PARITIES)]


def _sketch(text: Column) -> Column:
    """Struct of ``key`` and ``check``, which name the shingle set, its size ``n``, ``fp``, parities and ``buckets``."""
    ship()

    @pandas_udf(f"key long, check long, n long, fp long, {', '.join(f'{c} long' for c in _P)}, buckets array<long>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = []
            for text in texts.tolist():
                counts, parts, total = np.zeros(64, np.int64), [np.empty(0, np.uint64)], 0
                for hashes in shingle_hashes(text, WORDS):
                    counts += bit_counts(hashes)
                    total += len(hashes)
                    parts.append(hashes)
                shingles = np.unique(np.concatenate(parts))
                raw = shingles.tobytes()
                names = (xxhash.xxh64_intdigest(raw), xxhash.xxh64_intdigest(raw, 1), majority(counts, total))
                found.append((*names, len(shingles), buckets(shingles), parities(shingles)))
            named = {c: np.array([f[k] for f in found], np.uint64).view(np.int64) for k, c in enumerate(("key", "check", "fp"))}
            named |= {"n": [f[3] for f in found], "buckets": [f[4] for f in found]}
            named |= {c: np.array([f[5][k] for f in found], np.int64) for k, c in enumerate(_P)}
            yield pd.DataFrame(named)[["key", "check", "n", "fp", *_P, "buckets"]]

    return sketched(text)


def _shingles(text: Column) -> Column:
    ship()

    @pandas_udf("array<long>")
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t).view(np.int64) for t in texts.tolist()])

    return listed(text)


def _near_size(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 10 >= F.greatest(a, b) * TENTHS


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that are similar enough (stored)."""
    # The second one is mostly in one pair: its set travels, to where the first one's is.
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    sides = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return stored(sides.where(shared * 10 >= (F.size("sa") + F.size("sb") - shared) * TENTHS).select("a", "b"), "similar")


def _classes(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes), a class of texts with one shingle set named by ``key`` (stored)."""

    def named(rows: DataFrame) -> DataFrame:
        least = [F.min(c).alias(c) for c in ("hash", "n", "fp", *_P)]
        found = rows.groupBy("key").agg(F.min("doc_id").alias("least"), *least, F.min("check").alias("low"), F.max("check").alias("high"))
        return stored(found, "classes")

    classes = named(sketched)
    mixed = classes.where("low != high").select("key")
    if not mixed.isEmpty():
        # Sets of one name: they get names from all 128 bits.
        fresh = F.when(F.col("mixed"), F.xxhash64("key", "check")).otherwise(F.col("key"))
        joined = sketched.join(mixed.withColumn("mixed", F.lit(True)), "key", "left")
        sketched = stored(joined.withColumn("key", fresh).drop("mixed"), "sketches")
        classes = named(sketched)
    return sketched, classes.drop("low", "high")


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose fingerprints are equal or at most two bits apart."""
    rows = classes.where("n > 0").select("fp", "key", "n")
    heads = stored(rows.groupBy("fp").agg(F.min_by("key", F.struct("n", "key")).alias("head"), F.min("n").alias("of"), F.count(F.lit(1)).alias("rows")), "heads")
    many = heads.where("rows > 1")
    equal = checked_join(rows, many.select("fp", "head", "of"), ["fp"], many.select("fp", "rows")).where("key != head")
    equal = equal.where(_near_size("n", "of")).select(F.col("head").alias("a"), F.col("key").alias("b"))
    sides = [heads.select(F.col("fp").alias(x), F.col("head").alias(f"{x}_"), F.col("of").alias(f"n{x}")) for x in "ab"]
    # Tables of a row for each text or entry are not broadcast: stored columns that repeat make Spark size them too low.
    linked = linked_fingerprints(heads).join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b")
    linked = linked.where(_near_size("na", "nb"))
    return equal.union(linked.select(F.col("a_").alias("a"), F.col("b_").alias("b")))


def _placed(rows: DataFrame, roots: DataFrame, key: str = "key", root: str = "root") -> DataFrame:
    """``rows`` and, as ``root``, the component of ``key``."""
    named = roots.select(F.col("node").alias(key), F.col("root").alias("_root"))
    return rows.join(named, key, "left").select(*rows.columns, F.coalesce("_root", key).alias(root))


def _apart(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of groups that hold more than one component (stored)."""
    groups_ = rows.groupBy(*by).agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least != _most")
    return stored(rows.join(stored(groups_.select(*by), "apart"), by), "open")


def _prefixes(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Lists of ``keys`` (key, n): low, high, shingle, key, n, rest, upper (stored).

    ``rest`` are the shingles from this one on.  A list of two classes is for pairs of one text of each, ``upper`` for
    the larger; a list of one class (low = high) for pairs within it.
    """
    wanted = keys.join(sets, "key").select("key", "n", F.explode("shingles").alias("shingle"))
    wanted = stored(wanted, "shingles")
    counts = stored(wanted.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "counts")
    # Shingles of one text only come first and need no place; a window holds the shingles of one text.
    common = checked_join(wanted, counts.withColumn("f", F.col("rows")).drop("rows"), ["shingle"], counts)
    order = Window.partitionBy("key").orderBy(F.col("f").desc(), F.col("shingle").desc())
    rest = common.withColumn("rest", F.row_number().over(order))
    own = F.floor(F.ln("n") / F.lit(math.log(CLASS)))
    partner = F.explode(F.sequence(own - CLASSES, own + CLASSES))
    rest = rest.where(F.col("rest") * 10 >= F.col("n") * TENTHS).select("*", own.alias("own"), partner.alias("other"))
    # The least size of a partner in that class, rounded down, and what both have to share.
    least = F.greatest(F.floor(F.pow(F.lit(CLASS), "other") - 0.001), F.ceil(F.col("n") * TENTHS / 10))
    enough = F.col("rest") * (10 + TENTHS) >= (F.col("n") + least) * TENTHS
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    found = rest.where(enough).select(low, high, "shingle", "key", "n", "rest", (F.col("own") > F.col("other")).alias("upper"))
    return stored(found, "prefixes")


def _two_sided(lists: DataFrame) -> DataFrame:
    """The lists that can have a pair: several components, and texts of both classes (stored)."""
    by = ["low", "high", "shingle"]
    ends = [f(c).alias(f"_{f.__name__}_{c}") for c in ("root", "upper") for f in (F.min, F.max)]
    found = lists.groupBy(*by).agg(*ends).where("_min_root != _max_root and (low = high or _min_upper != _max_upper)")
    return stored(lists.join(stored(found.select(*by), "apart"), by), "open")


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Components of the links behind ``roots`` and further links ``found``: only components are linked anew (stored)."""
    ends = _placed(_placed(found, roots, "a", "ra"), roots, "b", "rb")
    over = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    each = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("root")), F.struct(F.col("b").alias("node"), F.col("rb").alias("root"))))
    known = roots.select("node", "root").union(ends.select(each.alias("e")).select("e.*")).distinct()
    raised = known.join(over.toDF("root", "_over"), "root", "left")
    return stored(raised.select("node", F.coalesce("_over", "root").alias("root")), "roots")


def _can_share(a: str, b: str) -> Column:
    """Whether two entries of a list leave room for enough shared, and for few enough other, shingles."""
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    rest = F.least(f"{a}.rest", f"{b}.rest") * (10 + TENTHS) >= both * TENTHS
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _P])
    return rest & _near_size(f"{a}.n", f"{b}.n") & (differ * (10 + TENTHS) <= both * (10 - TENTHS))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, hash of the text, root, component_id.

    ``component_id`` is the smallest doc_id among all rows that can be reached over
    links, NULL if none has one; ``root`` names the component.  NULL and wordless texts are
    copies of each other.  Repeated rows stay; other columns are not read; an empty table gives no rows.  A long text
    is hashed in blocks; its set of shingles takes eight bytes for each.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("hash"), F.col(text).alias("text"))
    sketched = rows.select("doc_id", "hash", _sketch(F.col("text")).alias("_s"))
    spark = docs.sparkSession
    with small_batches(spark):
        sketched = stored(sketched.select("doc_id", "hash", "_s.*"), "sketches")
    sketched, classes = _classes(sketched)
    near = stored(_fingerprint_pairs(classes).distinct(), "pairs")

    index = sketched.select("key", "n", F.explode("buckets").alias("bucket")).distinct()
    index = stored(index, "buckets")
    heads = index.groupBy("bucket").agg(F.min("key").alias("head"), F.min_by("n", "key").alias("of"), F.count(F.lit(1)).alias("rows"))
    heads = stored(heads.where("rows > 1"), "heads")
    met = stored(checked_join(index, heads.drop("rows"), ["bucket"], heads), "met")
    # One text of each class that meets another one.
    ends = near.select(F.explode(F.array("a", "b")).alias("key")).union(met.select("key"))
    wanted = ends.distinct().join(classes, "key").select("key", "hash")
    # Build the hash tables on the keys; Spark counts 20 bytes for a text and would broadcast those of a smaller table.
    texts = stored(rows.select("hash", "text").join(wanted.hint("shuffle_hash"), "hash"), "texts")
    texts = texts.groupBy("key").agg(F.min("text").alias("text"))
    with small_batches(spark):
        sets = stored(texts.select("key", _shingles(F.col("text")).alias("shingles")), "shingles")

    links = _verified(near, sets)
    roots = components(links)
    first = met.where("key != head").where(_near_size("n", "of")).select(F.col("head").alias("a"), F.col("key").alias("b"))
    first = _placed(_placed(first.distinct(), roots, "a", "ra"), roots, "b", "rb").where("ra != rb").select("a", "b")
    found = _verified(stored(first, "pairs"), sets)
    if not found.isEmpty():
        roots = _merged(roots, found)

    open_ = _apart(_placed(met.select("bucket", "key", "n"), roots), ["bucket"])
    lists = _prefixes(stored(open_.select("key", "n").distinct(), "keys"), sets)
    by = ["low", "high", "shingle"]
    for star in (True, False):
        placed = _two_sided(_placed(lists, roots))
        # Only what is left in open lists gets its parities.
        placed = stored(placed.join(classes.select("key", *_P).hint("merge"), "key"), "entries")
        entry = placed.select(*by, "upper", F.struct("key", "n", "rest", "root", *_P).alias("b"))
        right = entry.where("low = high or upper").drop("upper")
        left = entry.where("not upper").drop("upper").withColumnRenamed("b", "a")
        if star:
            left = stored(left.groupBy(*by).agg(F.min("a").alias("a")), "heads")
            sizes = right.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
            offered = checked_join(right, left, by, sizes, merge=True)
        else:
            offered = left.join(right.hint("merge"), by).where("low < high or a.key < b.key")
        offered = offered.where("a.root != b.root").where(_can_share("a", "b"))
        pairs = offered.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b"))
        found = _verified(stored(pairs.distinct(), "pairs"), sets)
        if not found.isEmpty():
            roots = _merged(roots, found)

    named = _placed(classes.select("key", "least"), roots)
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    members = stored(named.join(least.hint("merge"), "root").select("key", "root", "component_id"), "members")
    return sketched.select("doc_id", "hash", "key").join(members.hint("merge"), "key").drop("key")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the smallest doc_id.

    Columns stay as they are; rows without doc_id and repeated ones as in ``simhash.keep_one``.
    """
    return keep_least(docs, groups(docs, doc_id, text), doc_id, text)
