"""SimHash groups, decontamination and exact duplicates against brute force."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loadlens.llm import components, decontaminate, exact_dedup, simhash

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    found = [w for w in lower.split(" ") if w]
    if not found:
        return 0
    width = min(words, len(found))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + width]).encode(), 42) for i in range(len(found) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Root of each index: smallest index reachable over at most two differing bits."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "Ä ö  x\ty\x0bz", "a b c d e f g " * 30_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_against_all_pairs(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1, 1 << 63]
    prints = set(base)
    for b in base:
        for bits in (1, 2, 2, 3):
            prints.add(b ^ sum(1 << p for p in draw.sample(range(64), bits)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.linked_fingerprints(spark.createDataFrame([(p,) for p in [*signed, signed[0], None]], "fp long")).collect()
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_groups_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows] + [(5000, None), (5001, "  "), (5002, rows[3][1]), (5003, "that it."), (5004, "THAT IT.")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("fp", F.lit(1))
    got = {r.doc_id: r for r in simhash.near_groups(table).collect()}
    ids = sorted(got)
    texts = dict(rows)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    root = plain_components(prints)
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == [ids[r] for r in root]
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {ids[r] for r in root}


def test_group_edges(spark):
    rows = [(None, "one two three"), (4, "one two three"), (4, "one two three"), (None, None), (9, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_groups(table).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted(
        [("None", "4"), ("4", "4"), ("4", "4"), ("None", "None"), ("9", "9")]
    )
    assert sorted(str(r.doc_id) for r in simhash.keep_one(table).collect()) == ["4", "9", "None", "None"]
    assert simhash.near_groups(table.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 190)]
    star = [(7, i) for i in range(300, 400)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (7, 300), (None, 1)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 100 for i in range(100, 191)} | {7: 7} | {i: 7 for i in range(300, 400)}
    assert components.components(links.limit(0)).count() == 0


def words(n, seed):
    draw = random.Random(seed)
    return [f"w{draw.randrange(10_000)}" for _ in range(n)]


def test_contained_items_are_found(spark):
    long_item, edge = words(60, 1), words(14, 2)
    shares = edge[:12] + ["other", "end"]
    docs = [
        (1, " ".join(words(30_000, 3) + [w.upper() + "," for w in long_item] + words(500, 4))),
        (2, " ".join(words(50, 5) + shares + words(50, 6))),
        (3, " ".join(words(50, 7) + edge[:11] + ["no", "no", "no"])),
        (4, "Only THREE, words!"),
        (5, None), (6, ""), (None, " ".join(long_item)), (1, " ".join(long_item)),
    ]
    items = [(10, " ".join(long_item)), (11, " ".join(edge)), (12, "three words"), (13, None), (14, "..."), (12, "three words")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in decontaminate.contaminated(d, b).collect())
    # Of ten shingles of item 11 document 2 has eight, document 3 seven.
    assert got == sorted([
        ("1", 10, 56, 56), ("1", 10, 56, 56), ("None", 10, 56, 56), ("2", 11, 10, 8), ("4", 12, 1, 1), ("4", 12, 1, 1)
    ])
    clean = decontaminate.clean(d, b)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [3, 5, 6]
    blocks = decontaminate.contaminated(d, b, block_chars=60)
    assert sorted((str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in blocks.collect()) == got
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.contaminated(d.limit(0), b).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 31, 64, 100])
def test_any_eight_tenths_of_an_item_meet_its_sketch(n):
    text = " ".join(words(n + 4, n))
    item = decontaminate.make_item(1, text, 0.8)
    sketch = decontaminate.sketches_of([item], 0.8)[5].values
    # The worst case: the missing shingles are those with the smallest hashes.
    present = item.hashes[len(item.hashes) - item.needed :]
    assert len(set(sketch.tolist()) & set(present.tolist())) >= 1


@pytest.mark.parametrize("support", [1 / 1024, 0.3, 1.0])
def test_exact_duplicates(spark, support):
    rows = [(i, "hot") for i in range(40)] + [(100, None), (101, ""), (102, "a"), (103, "a"), (103, "a"), (None, "a"), (None, "z"), (104, "A"), (105, "b" * 200_000), (106, "b" * 200_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("kept", F.lit("x"))
    got = sorted(map(str, exact_dedup.duplicates(table, support=support).collect()))
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        digest = hashlib.sha256((t or "").encode()).hexdigest()
        want.append(f"Row(doc_id={i}, keep_id={keep}, group_size={len(ids)}, kept={i == keep}, text_sha256='{digest}')")
    assert got == sorted(want)
    assert exact_dedup.duplicates(table.limit(0), support=support).count() == 0
    left = exact_dedup.drop_duplicates(table, support=support)
    assert left.columns == table.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["39", "101", "103", "103", "None", "None", "104", "106"])


def test_one_id_on_different_texts_loses_none(spark):
    a, b, c = "one two three four", "quite another text here", "a third text stands alone"
    rows = [(1, a), (2, b), (2, a), (3, c), (3, b), (4, "p q r"), (4, "x y z"), (None, a), (None, "k l m"), (4, "x y z")]
    table = spark.createDataFrame([(*r, n % 2) for n, r in enumerate(rows)], "doc_id long, text string, n int")
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(table).collect())
    # Rows without doc_id stay.
    assert got == sorted([("1", a), ("2", b), ("3", c), ("4", "p q r"), ("4", "x y z"), ("None", a), ("None", "k l m")])
    again = simhash.keep_one(table.repartition(5)).collect()
    assert [r.n for r in again if r.text == "x y z"] == [0]
    exact = spark.createDataFrame([(9, "a"), (5, "a"), (5, "b"), (None, "b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_duplicates(exact).collect()) == [("5", "b"), ("9", "a"), ("None", "b")]
