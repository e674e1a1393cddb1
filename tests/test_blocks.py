"""Search over blocks: the rows of the plain search, with most blocks of a common word not read."""

import random

import pytest
from pyspark.sql import functions as F

from loadlens.operators import blocks, search


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(6)
    common = ["the", "of", "and"]
    rows = []
    for i in range(800):
        words = [draw.choice(common) if draw.random() < 0.4 else f"w{int(draw.paretovariate(0.6)) % 3000}" for _ in range(draw.randrange(1, 60))]
        if i % 97 == 0:
            words += ["zebra"] * (1 + i % 3)
        rows.append((i, " ".join(words)))
    return [*rows, (900, ""), (901, "the"), (902, "the"), (903, None)]


@pytest.fixture(scope="module")
def stored(spark, texts, tmp_path_factory):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = search.build_index(docs)
    path = str(tmp_path_factory.mktemp("blocks") / "b")
    blocks.store_blocks(index, path, span=16, buckets=2, parts=2)
    return index, path


QUERIES = [
    (1, ["the", "zebra"]), (2, ["zebra"]), (3, ["the"]), (4, ["the", "of", "and", "w1", "w2", "w77"]),
    (5, ["nowhere"]), (6, []), (7, ["the", "the", "zebra", "w5"]), (8, ["w1", "nowhere"]),
]


@pytest.mark.parametrize("k", [1, 3, 10, 2000])
def test_rows_are_those_of_the_plain_search(spark, stored, k):
    index, path = stored
    queries = spark.createDataFrame(QUERIES, "query_id long, terms array<string>")
    got = blocks.BlockIndex(spark, path).search(queries, k).select("query_id", "doc_id", "score", "place")
    want = search.search(index, queries, k).select("query_id", "doc_id", "score", "place")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_most_blocks_of_a_common_word_are_not_read(spark, stored):
    _, path = stored
    found = blocks.BlockIndex(spark, path)
    queries = spark.createDataFrame([(1, ["the", "zebra"])], "query_id long, terms array<string>")
    assert found.search(queries, 5).count() == 5
    read = {r.term: (r.read, r.blocks) for r in found.blocks_read().collect()}
    common, all_common = read["the"]
    assert all_common > 40 and common < all_common / 3


@pytest.mark.parametrize("lists", ["short", "long"])
def test_pieces_and_tasks_change_no_row(spark, stored, texts, tmp_path, plan, monkeypatch, lists):
    """Many files and tasks, and lists too long to be sent to all: the same rows, and scores never move."""
    index, _ = stored
    monkeypatch.setattr(blocks, "TASK_HITS", 50)
    if lists == "long":
        monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    path = tmp_path / "b"
    docs = search.indexed_documents(spark.createDataFrame(texts, "doc_id long, text string"))
    assert docs == index.select("doc_id").distinct().count()
    blocks.store_blocks(index, str(path), span=16, buckets=2, parts=2, docs=docs, pieces=40)
    assert len(list((path / "blocks").glob("*/*/*.parquet"))) > 20
    queries = spark.createDataFrame(QUERIES, "query_id long, terms array<string>")
    found = blocks.BlockIndex(spark, str(path))
    got = found.search(queries, 5).select("query_id", "doc_id", "score", "place")
    want = search.search(index, queries, 5).select("query_id", "doc_id", "score", "place")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    every = spark.createDataFrame([(q, s, 10) for q in (1, 4) for s in range(60)], "query_id long, segment int, hits long")
    scored = found.scores(every)
    assert "hashpartitioning(query_id" not in plan(scored) and scored.rdd.getNumPartitions() == 24


def test_an_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    blocks.store_blocks(search.build_index(docs), str(tmp_path / "b"))
    queries = spark.createDataFrame(QUERIES, "query_id long, terms array<string>")
    assert blocks.BlockIndex(spark, str(tmp_path / "b")).search(queries).count() == 0


def test_phrases(spark, stored, texts):
    index, _ = stored
    phrases = [(1, ["the", "of"]), (2, ["the", "the", "the"]), (3, ["zebra", "zebra"]), (4, ["of"]), (5, ["no", "the"]), (6, [])]
    got = blocks.phrase_matches(index, spark.createDataFrame(phrases, "phrase_id long, terms array<string>"))
    want = []
    for p, terms in phrases:
        for i, text in texts:
            words = (text or "").split()
            at = [k for k in range(len(words) - len(terms) + 1) if words[k : k + len(terms)] == terms] if terms else []
            if at:
                want.append((p, i, len(at), at[0]))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert blocks.phrase_matches(index.where(F.lit(False)), spark.createDataFrame(phrases, "phrase_id long, terms array<string>")).count() == 0
