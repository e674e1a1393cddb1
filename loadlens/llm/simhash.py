"""SimHash near-duplicates by an inverted index over the positions of fingerprint bytes.

A fingerprint has eight bytes.  Two fingerprints that differ in at most two bits
differ in at most two bytes, so they share at least six bytes at the same
positions: that is the guaranteed minimum number of matches.  A plain posting list per
(position, byte) holds 1/256 of all rows, and tallying its pairs is quadratic.  The
index therefore holds the postings already intersected at the minimum: one list for
each choice of six positions and their six byte values, 28 per distinct
fingerprint.  A pair of one list is tallied (how many positional bytes the
two share in all, from the zero bytes of their difference), is kept in one list
only, the first of those that its shared bytes name, and is verified by counting
bits.  At most 65,536 distinct fingerprints fit one list and at most 136 of them are
within two bits of a given one, so links grow with rows and not with their square.

Rows with equal fingerprints are one class: only distinct fingerprints are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from loadlens.llm.common import ship, spare, stored
from loadlens.llm.components import components

BYTES = 8
#: Differing bits that still link two fingerprints.
MOST_BITS = 2
#: Positional bytes that such a pair shares at least.
LEAST_SHARED = BYTES - MOST_BITS
SEED = 42
#: Shingles whose bits are counted together.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 values of a text's shingles, repeats included, in blocks."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    width = min(words, len(found))
    for at in range(0, len(found) - width + 1 if width else 0, BLOCK):
        part = found[at : at + BLOCK + width - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(width))))
        yield np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], "<u8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingle hashes.

    A-Z are lower-cased; words are runs without ASCII white space; a text with
    fewer words than a shingle is one shingle; NULL and texts without words give 0.
    """
    set_bits, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        set_bits += bit_counts(hashes)
        n += len(hashes)
    return majority(set_bits, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(set_bits: np.ndarray, n: int) -> int:
    """The number whose bits are those that over half of ``n`` hashes have."""
    return int.from_bytes(np.packbits(set_bits * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_of(text: Column, words: int = 3) -> Column:
    """Fingerprint of a text column as a signed 64-bit number."""

    ship()

    @pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint(t, words) for t in texts.tolist()], np.uint64)
            yield pd.Series(found.view(np.int64))

    return hashed(text)


def _byte(number: Column, place: int) -> Column:
    return F.shiftrightunsigned(number, 8 * place).bitwiseAND(F.lit(255))


def _mask(places: tuple[int, ...]) -> int:
    unsigned = sum(255 << (8 * p) for p in places)
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in ``fp`` that differ in at most two bits."""
    choices = list(combinations(range(BYTES), LEAST_SHARED))
    postings = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(c))) for c in choices]))
    index = prints.where("fp is not null").select("fp").distinct().select(postings.alias("list", "bytes"), "fp")
    left = index.withColumnRenamed("fp", "a")
    right = index.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    same = [(_byte(differ, p) == 0) for p in range(BYTES)]
    shared = reduce(lambda x, y: x + y, [s.cast("int") for s in same])
    # The first choice of six positions that lies within the shared ones.
    first = F.coalesce(
        *[F.when(reduce(lambda x, y: x & y, [same[p] for p in c]), F.lit(k)) for k, c in enumerate(choices)]
    )
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= MOST_BITS) & (shared >= LEAST_SHARED)
    # Spark takes the 28 postings of a fingerprint for one row and would broadcast the whole index.
    met = left.join(right.hint("merge"), ["list", "bytes"])
    return met.where(near & (F.col("list") == first)).select("a", "b")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id among all rows that can be reached over
    links, the row itself included.  NULL and wordless texts have fingerprint 0
    and are linked like any other.  A missing doc_id is no candidate for
    ``component_id``, which is NULL if a whole component lacks ids.  Repeated rows
    stay; other columns are not read; an empty table gives no rows.
    """
    found = _grouped(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text), words).alias("fp")))
    return found.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp and others) with component_id and root, the fingerprint that names the component."""
    rows = stored(rows, "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(linked_fingerprints(classes))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Tables of a row for each fingerprint are not broadcast.
    found = stored(named.join(least.hint("merge"), "root").select("fp", "component_id", "root"), "members")
    return rows.join(found.hint("merge"), "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the smallest doc_id.

    Columns stay as they are.  Rows without doc_id cannot be named and stay.  Rows are
    told apart by doc_id and text, so a doc_id on different texts loses none of them; if
    the smallest doc_id of a component stands on several of its rows, the one with
    the smallest hash of its text stays, and of equal texts the smallest row.
    """
    prints = fingerprint_of(F.col(text), words).alias("fp")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("hash"), prints)
    return keep_least(docs, _grouped(rows), doc_id, text)


def text_hash(text: str) -> Column:
    """64-bit hash of a text; NULL counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_least(docs: DataFrame, groups: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that stay, from ``groups``: doc_id, hash, root and component_id of each row."""
    body, key = text_hash(text), spare(docs, "_gone")
    hashed = spare(docs, "_text")
    gone = groups.where("doc_id != component_id").select("doc_id", "hash")
    least = groups.where("doc_id = component_id")
    repeated = least.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("best")).where("n > 1")
    repeated = stored(repeated, "repeated")
    repeats = not repeated.isEmpty()
    if repeats:
        gone = gone.union(least.join(repeated, "root").where("hash != best").select("doc_id", "hash"))
    gone = gone.distinct().toDF(key, hashed).hint("shuffle_hash")
    # Build the hash table on the ids; the texts are not sorted.
    kept = docs.join(gone, (docs[doc_id] == F.col(key)) & (body == F.col(hashed)), "left_anti")
    if not repeats:
        return kept
    # Of rows with one id and text the first by the text of all their values stays, whatever types they have.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = kept.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), body.alias("hash"), whole.alias("row"))
    first = rows.groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return first.unionByName(kept.where(F.col(doc_id).isNull()))
