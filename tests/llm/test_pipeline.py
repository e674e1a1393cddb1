"""The pipeline against brute force, stage by stage."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loadlens.llm import decontaminate, langid, mixing
from loadlens.llm.queries import language_model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each of the first four stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, None, "s", 0), (9001, "12 34", "en", None, 5)], docs.schema)
    docs, out = docs.unionByName(odd), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append(rows)
    return out


def test_language_stage(spark, kept):
    model = language_model(spark.createDataFrame(kept[0], "doc_id long, text string, lang string, source string, n_chars long"))
    want = set()
    for r in kept[0]:
        scores = langid.log_scores(r.text, model) if r.text else None
        if scores is not None and 1 / np.exp(scores - scores.max()).sum() >= 0.5:
            want.add(r.doc_id)
    assert {r.doc_id for r in kept[1]} == want and not {9000, 9001} & want


def five_words(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    width = min(5, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def test_near_copy_stage(kept):
    sets = {r.doc_id: five_words(r.text) for r in kept[1]}
    similar = {i: [j for j in sets if len(sets[i] & sets[j]) * 10 >= len(sets[i] | sets[j]) * 8] for i in sets}
    left = set(sets)
    for i in sorted(sets):  # a document goes if a smaller one is reachable
        reach, edge = {i}, [i]
        while edge:
            edge = list({j for k in edge for j in similar[k]} - reach)
            reach.update(edge)
        if min(reach) < i:
            left.discard(i)
    assert {r.doc_id for r in kept[2]} == left


def test_decontamination_stage(spark, kept):
    items = [decontaminate.make_item(r.item_id, r.text, 0.8) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(text):
        words = decontaminate.normal_words(text)
        runs = set(zip(*(words[k:] for k in range(5))))
        return any(len(item.shingles & runs) * 10 >= len(item.shingles) * 8 for item in items)

    assert {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2] if not holds(r.text)}


def test_mixing_stage(spark, kept):
    sizes, taken = {}, {}
    for r in kept[3]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in kept[4]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert {r.doc_id for r in kept[4]} <= {r.doc_id for r in kept[3]}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    most = max(len(r.text.split()) for r in kept[3])
    for r in mixing.targets(table).collect():
        assert abs(taken.get(r.source, 0) - r.target) <= most / 2 + 1


def test_last_stage_and_run(spark, kept):
    docs = spark.createDataFrame(kept[4], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), key=lambda r: r.start)
    plain, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for row, r in zip(sorted(kept[4], key=lambda r: r.doc_id), got, strict=True):
        ids = np.array(plain.encode(row.text, add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_run_covers_the_table(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
