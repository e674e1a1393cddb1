"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are short and documents long, so the question is containment: which share
of an item's distinct five-word shingles stands in the document.  Items are
partitioned by their number of shingles (1, 2-3, 4-7, ...).  In a partition with at most
``u`` shingles an item may miss at most ``u - ceil(t * u)`` of them and still reach
the threshold ``t``; its MinHash sketch is therefore one longer than that: the so many
smallest shingle hashes.  A document that contains the item holds at least one
sketch value, so the search has no false negatives.  Documents are hashed once,
hashes above the largest sketch value are skipped, and the rest are looked up in
the sorted sketches.  Candidates are verified by exact containment on the words.

Items are broadcast in blocks of ``BLOCK_CHARS`` characters (measured first); with
more blocks each document is searched once per block, in a job of its own.  Documents are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from loadlens.llm.common import Memo, normal_words, ship, spare, stored

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_CHARS = 4 << 20

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, from the hashes of the words."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _STEP + words[k : k + n]
    total ^= total >> np.uint64(31)
    total *= _MIX
    return total ^ (total >> np.uint64(29))


@dataclass(frozen=True)
class Item:
    """A test item: its id, shingle width, distinct shingles and their hashes."""

    item_id: object
    width: int
    shingles: frozenset[tuple[str, ...]]
    hashes: np.ndarray
    needed: int


def make_item(item_id: object, text: str | None, threshold: float, shingle: int = SHINGLE) -> Item | None:
    """An item without words is None; one shorter than a shingle is one shingle of all its words."""
    words = normal_words(text)
    if not words:
        return None
    width = min(shingle, len(words))
    runs = frozenset(zip(*(words[k:] for k in range(width))))
    hashes = np.array([word_hash(w) for w in words], np.uint64)
    needed = math.ceil(Fraction(str(threshold)) * len(runs))
    return Item(item_id, width, runs, np.unique(shingle_hashes(hashes, width)), max(1, needed))


@dataclass(frozen=True)
class Sketches:
    """Sketch values of all items of one shingle width, sorted, and the item of each."""

    values: np.ndarray
    owners: np.ndarray


def sketches_of(items: list[Item], threshold: float) -> dict[int, Sketches]:
    """Bottom-k MinHash sketches; k follows from the size partition of an item."""
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for place, item in enumerate(items):
        upper = (1 << len(item.shingles).bit_length()) - 1
        k = upper - math.ceil(Fraction(str(threshold)) * upper) + 1
        found.setdefault(item.width, []).append((item.hashes[:k], place))
    out = {}
    for width, parts in found.items():
        values = np.concatenate([v for v, _ in parts])
        owners = np.concatenate([np.full(len(v), p) for v, p in parts])
        order = np.argsort(values, kind="stable")
        out[width] = Sketches(values[order], owners[order])
    return out


def search(text: str | None, items: list[Item], sketches: dict[int, Sketches], hash_of: Memo) -> list[tuple]:
    """(item_id, n_item, n_shared) of every item whose containment in the text reaches the threshold."""
    words = normal_words(text)
    if not words:
        return []
    word_hashes = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
    hash_of.trim()
    out = []
    for width, sketch in sketches.items():
        hashes = shingle_hashes(word_hashes, width)
        low = np.unique(hashes[hashes <= sketch.values[-1]])
        start = np.searchsorted(sketch.values, low, "left")
        end = np.searchsorted(sketch.values, low, "right")
        hit = start < end
        owners = {int(o) for a, b in zip(start[hit], end[hit]) for o in sketch.owners[a:b]}
        for place in sorted(owners):
            item = items[place]
            at = np.flatnonzero(np.isin(hashes, item.hashes))
            shared = {tuple(words[i : i + width]) for i in at} & item.shingles
            if len(shared) >= item.needed:
                out.append((item.item_id, len(item.shingles), len(shared)))
    return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int = BLOCK_CHARS) -> Iterator[list]:
    """Items in blocks of about ``block_chars`` characters, a block at a time on the driver."""
    known = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = total // block_chars + 1
    for k in range(blocks):
        block = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else known
        yield block.collect()


def _n_blocks(benchmark: DataFrame, text: str, block_chars: int) -> int:
    return (benchmark.agg(F.sum(F.length(text))).first()[0] or 0) // block_chars + 1


def _finder(shared: Broadcast, kind: str):
    """A function on text columns that searches one block of items."""

    @pandas_udf(f"array<struct<item_id:{kind},n_item:bigint,n_shared:bigint>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (items, sketches), hash_of = shared.value, Memo(word_hash)
        names = ("item_id", "n_item", "n_shared")
        for texts in batches:
            hits = (search(t, items, sketches, hash_of) for t in texts.tolist())
            yield pd.Series([[dict(zip(names, hit)) for hit in each] for each in hits])

    return found


def _by_block(
    docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, threshold: float, block_chars: int, use
) -> list[DataFrame]:
    """``use(column)`` on ``docs`` for each block of items, ``column`` being the items found in a text.

    With several blocks each is a job of its own, whose result is stored; its items then leave the driver and the workers
    before the next block comes.
    """
    kind = benchmark.schema[item_id].dataType.simpleString()
    context = ship().sparkContext
    many, out = _n_blocks(benchmark, item_text, block_chars) > 1, []
    for rows in item_blocks(benchmark, item_id, item_text, block_chars):
        items = [i for i in (make_item(r[0], r[1], threshold) for r in rows) if i]
        shared = context.broadcast((items, sketches_of(items, threshold)))
        found = use(_finder(shared, kind)(F.col(text)))
        if many:
            found = stored(found, "block")
            shared.destroy()
        out.append(found)
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for every item found in a row of ``docs``.

    Words are lower-cased runs of letters and digits.  Items of fewer than five words
    are one shingle of all their words; items and documents without words, and
    NULL texts, match nothing.  Repeated rows or items give repeated results; ids
    may be NULL; other columns are not read.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def hits(found: Column) -> DataFrame:
        each = narrow.select("doc_id", found.alias("m")).select("doc_id", F.explode("m").alias("m"))
        share = (F.col("m.n_shared") / F.col("m.n_item")).alias("containment")
        return each.select("doc_id", "m.item_id", "m.n_item", "m.n_shared", share)

    parts = _by_block(narrow, "text", benchmark, item_id, item_text, threshold, block_chars, hits)
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item; columns stay as they are, whatever they are called.

    NULL texts and texts without words hold none; repeated rows stay or go together; without items all rows stay.
    """
    name = spare(docs, "_items")
    if _n_blocks(benchmark, item_text, block_chars) == 1:
        found = _by_block(docs, text, benchmark, item_id, item_text, threshold, block_chars, lambda c: docs.withColumn(name, c))
        return found[0].where(F.size(name) == 0).drop(name)
    # Texts are named by their digest; those that hold an item of some block go.
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    parts = _by_block(docs, text, benchmark, item_id, item_text, threshold, block_chars, lambda c: docs.where(F.size(c) > 0).select(digest.alias(name)))
    gone = reduce(DataFrame.unionByName, parts).distinct()
    return docs.join(gone, digest == gone[name], "left_anti")


#: The same result by exact containment of all shingles.
SQL = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark),
bi as (select item_id, w, least(5, len(w)) as k, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from b where len(w) > 0),
bs as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as s from bi),
di as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bs)),
ds as (select distinct doc_id, k, array_to_string(w[i:i + k - 1], ' ') as s from di),
n as (select item_id, count(*) as n_item from bs group by item_id)
select doc_id, item_id, n_item, count(*) as n_shared, count(*) / n_item as containment
from ds join bs using (k, s) join n using (item_id)
group by doc_id, item_id, n_item having count(*) * 10 >= n_item * 8
"""
