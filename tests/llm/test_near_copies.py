"""Near copies against the similarity of all pairs."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from loadlens.llm import near_copies, simhash


def plain_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def plain_least(rows):
    """Smallest id reachable over pairs at 0.8 or more, for each row."""
    sets = [plain_set(t) for _, t in rows]
    least = [i for i, _ in rows]
    pairs = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if len(sets[i] & sets[j]) * 10 >= len(sets[i] | sets[j]) * 8
    ]
    for _ in rows:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return least


def changed(words, places):
    return " ".join(f"x{k}" if k in places else w for k, w in enumerate(words))


@pytest.fixture(scope="module")
def rows(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    out, draw = [tuple(r) for r in given], random.Random(8)
    words = [f"w{draw.randrange(500)}" for _ in range(204)]
    # Each further text is close to the one before only: a chain.
    out += [(5000 + n, changed(words, set(range(0, 16 * n, 16)))) for n in range(9)]
    out += [(6000 + n, changed(words[::-1], {draw.randrange(204) for _ in range(4)})) for n in range(60)]
    return [*out, (7000, None), (7001, " "), (7002, "that it."), (7003, "THAT IT."), (7004, "")]


def test_groups_against_all_pairs(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.groups(table).collect()}
    want = dict(zip((i for i, _ in rows), plain_least(rows), strict=True))
    assert got == want
    # Five and more bits apart in SimHash.
    assert got[56] == got[2] == want[2] and got[255] == 1 and got[875] == got[582]
    kept = near_copies.keep_one(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}
    assert near_copies.groups(table.limit(0)).count() == 0


def test_stage_links_similar_texts(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()}
    # Similarities 0.833 and 0.830; the fingerprints differ in 7 and 11 bits.
    assert {1, 6} <= kept and not {145, 177} & kept


def test_texts_that_share_a_passage(spark):
    """Common passages with own words around them: from well below 0.8 to above it."""
    draw = random.Random(11)
    passage = [f"p{k}" for k in range(300)]
    rows = []
    for n in range(150):
        own = [f"o{draw.randrange(10**9)}" for _ in range(draw.choice([8, 27, 33, 36, 40, 50, 60, 90, 150]))]
        cut = draw.randrange(len(own))
        rows.append((n, " ".join(own[:cut] + passage + own[cut:])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.groups(table).collect()}
    assert [got[i] for i, _ in rows] == plain_least(rows)
    assert len(set(got.values())) > 20


def test_prefixes_keep_every_similar_pair(spark):
    draw = random.Random(12)
    sets = {}
    for k in range(60):
        base = {draw.randrange(400) for _ in range(draw.choice([1, 5, 20, 60, 120]))}
        sets[k] = base
        for j in range(3):
            gone = {x for x in base if draw.random() < 0.1 * j}
            sets[100 + 3 * k + j] = (base - gone) | {draw.randrange(1000) for _ in range(len(base) // 12)}
    sets = {k: v for k, v in sets.items() if v}  # texts without words are one class and in no list
    table = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "key long, shingles array<long>")
    keys = table.select("key", F.size("shingles").cast("long").alias("n"))
    lists = near_copies._prefixes(keys, table).collect()
    by = {}
    for r in lists:
        by.setdefault((r.low, r.high, r.shingle), []).append(r)
    room = lambda a, b: min(a.rest, b.rest) * 18 >= (a.n + b.n) * 8 and (a.low == a.high or a.upper != b.upper)
    met = {(a.key, b.key) for rows in by.values() for a in rows for b in rows if a.key < b.key and room(a, b)}
    similar = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 8}
    assert similar and similar <= met


def test_names_that_collide_and_odd_rows(spark):
    sketched = spark.createDataFrame(
        [(1, 11, 5, 1, 3, 9, [1]), (2, 12, 5, 1, 3, 9, [1]), (3, 13, 5, 2, 4, 8, [1]), (4, 14, 6, 7, 4, 8, [])],
        "doc_id long, hash long, key long, check long, n long, fp long, buckets array<long>",
    ).withColumns({c: F.lit(0).cast("long") for c in near_copies._P})
    rows, classes = near_copies._classes(sketched)
    keys = {r.doc_id: r.key for r in rows.collect()}
    assert keys[1] == keys[2] != keys[3] and keys[4] == 6 and classes.count() == 3

    long = " ".join(f"w{k}" for k in range(120_000))
    data = [(1, long, {"a": 1}), (2, long + " end", None), (None, long, None), (3, "one two", None), (3, "other words", None), (3, "one two", None), (3, "one two", {"b": 2})]
    table = spark.createDataFrame(data, "doc_id long, text string, _gone map<string,int>")
    table = table.withColumns({c: F.lit("x") for c in ("_text", "key", "hash", "fp", "root", "a.b")})
    kept = near_copies.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id), r.text[:9]) for r in kept.collect()) == [("1", "w0 w1 w2 "), ("3", "one two"), ("3", "other wor"), ("None", "w0 w1 w2 ")]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(table).collect()) == ["1", "3", "3", "None"]


def test_parities_differ_in_no_more_cells_than_sets():
    draw = random.Random(16)
    for n in (0, 1, 30, 500, 5000):
        a = {draw.getrandbits(64) for _ in range(n)}
        b = {x for x in a if draw.random() < 0.9} | {draw.getrandbits(64) for _ in range(n // 20)}
        pa, pb = (near_copies.parities(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert sum((int(x) ^ int(y)).bit_count() if (int(x) ^ int(y)) >= 0 else ((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(pa, pb)) <= len(a ^ b)
