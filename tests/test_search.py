"""Index, statistics and ranked search against brute force."""

import math
import random

import pytest

from loadlens.functions import joins
from loadlens.operators import search

WORDS = "red green blue dog cat bird tree stone the the the the".split()


def make_docs(n=60, seed=5):
    pick = random.Random(seed)
    docs = [(i, " ".join(pick.choice(WORDS) for _ in range(pick.randrange(1, 30)))) for i in range(n)]
    return [*docs, (n, "..."), (n + 1, "")]


def brute_scores(docs, queries, group=lambda doc_id: 0):
    words = {i: t.split() for i, t in docs if t.strip(".")}
    out = {}
    for q, terms in queries:
        terms = set(terms)
        for i, ws in words.items():
            peers = [p for p in words if group(p) == group(i)]
            found = [t for t in terms if t in ws]
            if not found:
                continue
            total = 0.0
            for t in found:
                df = sum(t in words[p] for p in peers)
                idf = 1 + math.log(len(peers) / (df + 1))
                total += math.sqrt(ws.count(t)) * idf * idf / math.sqrt(len(ws))
            out[q, i] = len(found) / len(terms) * total
    return out


@pytest.fixture(scope="module")
def docs():
    return make_docs()


@pytest.fixture(scope="module")
def index(spark, docs):
    return search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))


QUERIES = [(1, ["red", "the", "red"]), (2, ["dog"]), (3, ["unknown"]), (4, ["unknown", "cat", "the"])]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, terms array<string>")


def test_index(index, docs):
    rows = {(r.term, r.doc_id): r for r in index.collect()}
    for i, text in docs:
        ws = [] if not text.strip(".") else text.split()
        for term in set(ws):
            row = rows.pop((term, i))
            assert row.positions == [p for p, w in enumerate(ws) if w == term]
            assert (row.tf, row.first_pos, row.doc_len) == (len(row.positions), row.positions[0], len(ws))
    assert not rows


def test_term_stats(index, docs):
    words = [t.split() for _, t in docs if t.strip(".")]
    for r in search.term_stats(index).collect():
        assert r.df == sum(r.term in w for w in words)
        assert r.cf == sum(w.count(r.term) for w in words)
        assert r.idf == pytest.approx(1 + math.log(len(words) / (r.df + 1)))


@pytest.mark.parametrize("list_kind", ["short", "long"])
def test_scores(index, queries, docs, both_ways, list_kind, monkeypatch):
    if list_kind == "long":
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    want = brute_scores(docs, QUERIES)
    got = {(r.query_id, r.doc_id): r.score for r in search.matches(index, queries).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_top_k_and_shards_agree(index, queries):
    whole = search.search(index, queries, 7).collect()
    parts = search.search_sharded(index, queries, 4, 7).collect()
    order = lambda rows: sorted((r.query_id, r.place, r.doc_id, r.score) for r in rows)
    assert order(whole) == order(parts) and {r.query_id for r in whole} == {1, 2, 4}
    for q in (1, 2, 4):
        scores = [r.score for r in sorted(whole, key=lambda r: r.place) if r.query_id == q]
        assert scores == sorted(scores, reverse=True)


def test_shard_statistics(spark, index, queries, docs):
    from pyspark.sql import functions as F

    from loadlens.functions.text import shard_of

    ids = spark.createDataFrame([(i,) for i, _ in docs], "doc_id long")
    shard = {r.doc_id: r.s for r in ids.select("doc_id", shard_of(F.col("doc_id"), 3).alias("s")).collect()}
    want = brute_scores(docs, QUERIES, shard.get)
    got = {(r.query_id, r.doc_id): r.score for r in search.matches(index, queries, 3).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_replay(spark, index, queries, docs):
    want = brute_scores(docs, QUERIES)
    slots = spark.range(10)  # 4 queries over 10 slots: 3, 3, 2, 2 runs
    got = {r.query_id: r for r in search.replay_queries(index, queries, slots, "id", 5).collect()}
    hits = {q: sum(k[0] == q for k in want) for q, _ in QUERIES}
    assert {q: (r.runs, r.hits, r.returned) for q, r in got.items()} == {
        q: (runs, hits[q], min(hits[q], 5)) for q, runs in zip((1, 2, 3, 4), (3, 3, 2, 2))
    }
    assert {r.zero_hit_share for r in got.values()} == {0.2}


def test_stored_index_has_term_folders_and_sizes(spark, index, docs, tmp_path):
    path = str(tmp_path / "index")
    stored = search.store_index(index, path, 3)
    folders = {int(p.name.split("=")[1]) for p in (tmp_path / "index" / "terms").glob(f"{search.BUCKET}=*")}
    assert folders == {r[0] for r in stored.select(search.BUCKET).distinct().collect()} and len(folders) > 3
    assert stored.select(index.columns).exceptAll(index).count() == 0 and stored.count() == index.count()
    sizes = {r.shard: r.docs for r in search.index_sizes(spark, path).collect()}
    assert sum(sizes.values()) == sum(1 for _, t in docs if t.strip("."))


def test_asked_terms_are_filtered_before_any_shuffle(spark, index, queries, tmp_path, monkeypatch):
    """Only postings of asked terms are kept, and the stored index is scanned once for them."""
    kept = []
    real = search.stored_rows
    monkeypatch.setattr(search, "stored_rows", lambda df, name: kept.append(df) or real(df, name))
    stored = search.store_index(index, str(tmp_path / "index"), 3)
    sizes = search.index_sizes(spark, str(tmp_path / "index"))
    search.matches(stored, queries, sizes=sizes).collect()
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert len(kept) == 1 and "BroadcastHashJoin" in plan and "hashpartitioning(term" not in plan.split("FileScan")[0]
    assert {r.term for r in kept[0].select("term").distinct().collect()} <= {"red", "the", "dog", "cat"}


def test_index_cost_grows_with_the_length_of_a_text(spark):
    import time

    took = []
    for n in (20_000, 60_000):
        text = " ".join(f"w{i}" for i in range(n))
        start = time.time()
        rows = search.build_index(spark.createDataFrame([(1, text)], "doc_id long, text string"))
        assert rows.select("term", "positions").write.format("noop").mode("overwrite").save() is None
        took.append(time.time() - start)
    assert took[1] < 9 * took[0]


def test_search_reads_no_positions(spark, index, queries, tmp_path, plan):
    stored = search.store_index(index, str(tmp_path / "index"), 3)
    scans = plan(search.search(stored, queries)).split("ReadSchema: ")[1:]
    assert scans and all("positions" not in s.split(">")[0] for s in scans)


def test_redirects_are_dropped(spark):
    docs = spark.createDataFrame(
        [(1, "#REDIRECT [[x]]"), (2, "#REDIRECT [[x]]\nmore"), (3, "text"), (4, None)], "id int, text string"
    )
    assert sorted(r.id for r in search.drop_redirects(docs, "text").collect()) == [3, 4]
    assert sorted(r.id for r in search.drop_redirects(docs, "text", strict=True).collect()) == [2, 3, 4]


def test_index_parts_follow_the_rows_not_the_settings(spark, index, tmp_path, monkeypatch):
    """Parts are sorted in memory, so their number follows the rows, and a common word is spread over several."""
    monkeypatch.setattr(search, "PART_ROWS", 2)
    stored = search.store_index(index, str(tmp_path / "index"), 3)
    files = {str(p) for p in (tmp_path / "index" / "terms").glob("*/*.parquet")}
    assert len(files) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    the = stored.where("term = 'the'").selectExpr("_metadata.file_path AS f").distinct().count()
    assert the > 1 and stored.select(index.columns).exceptAll(index).count() == 0 and stored.count() == index.count()
    for name in files:
        terms = [r.term for r in spark.read.parquet(f"file://{name}").collect()]
        assert terms == sorted(terms)


def test_bytes_of_texts_give_the_parts(spark, monkeypatch):
    monkeypatch.setattr(search, "PART_BYTES", 10)
    docs = spark.createDataFrame([(1, "a" * 25), (2, None), (3, "\u00e9" * 5)], "doc_id long, text string")
    assert search.index_parts(docs) == 4 and search.index_parts(docs.where("doc_id = 2")) == 1


def test_scores_are_added_where_they_arise(index, queries, plan):
    """One row per query and document never goes through a shuffle."""
    assert "hashpartitioning(query_id" not in plan(search.matches(index, queries))


def test_number_of_scoring_tasks_changes_nothing(index, queries, monkeypatch):
    want = sorted(search.matches(index, queries).collect())
    monkeypatch.setattr(search, "TASK_HITS", 5)
    scored = search.matches(index, queries)
    assert scored.rdd.getNumPartitions() > 10 and sorted(scored.collect()) == want


def test_columns_of_a_document_can_be_kept(spark, index, docs):
    texts = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id % 7 AS place")
    kept = search.build_index(texts, keep=["place"])
    assert kept.columns == [*index.columns, "place"] and kept.where("place <> doc_id % 7").count() == 0
    assert kept.drop("place").exceptAll(index).count() == 0


@pytest.mark.parametrize("setting, within", [(None, 16 << 20), ("1m", 1 << 20), ("3000b", 3000), ("2g", 16 << 20)])
def test_index_builds_read_little_per_task(spark, setting, within):
    """A smaller setting stays, a larger one is lowered and comes back."""
    from loadlens.functions.lineage import SPLIT_SETTING, small_splits

    if setting is not None:
        spark.conf.set(SPLIT_SETTING, setting)
    try:
        before = spark.conf.get(SPLIT_SETTING)
        with pytest.raises(KeyError), small_splits(spark):
            assert spark.conf.get(SPLIT_SETTING) == str(within)
            raise KeyError
        assert spark.conf.get(SPLIT_SETTING) == before
    finally:
        spark.conf.unset(SPLIT_SETTING)
