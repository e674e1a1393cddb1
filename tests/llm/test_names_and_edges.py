"""Extra columns with the names that operators use themselves, and texts above the size of a part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.llm import decontaminate, exact_dedup, langid, mixing

OWN = ["_items", "_items_", "_language", "_gone", "_text", "_mix", "_copy", "_row", "_state", "_source", "size", "digest", "keep_id", "target", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "en", "s"), (2, "one two three four five six", "en", "s"), (3, "ein zwei drei", "de", None), (None, "ein zwei drei", "de", "t"), (4, None, None, "t")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return table.withColumns({c: F.lit(c) for c in OWN})


def kept(df, docs):
    assert df.columns == docs.columns
    rows = df.collect()
    assert all(r[c] == c for r in rows for c in OWN)
    return sorted(str(r.doc_id) for r in rows)


def test_columns_stay(spark, docs):
    items = spark.createDataFrame([(1, "two three four five six"), (2, None)], "item_id long, text string")
    assert kept(decontaminate.clean(docs, items), docs) == ["3", "4", "None"]
    assert kept(decontaminate.clean(docs, items, block_chars=4), docs) == ["3", "4", "None"]
    assert kept(exact_dedup.drop_duplicates(docs), docs) == ["2", "3", "4", "None"]
    assert kept(langid.keep_identified(docs, langid.fit(docs)), docs) == ["1", "2", "3", "None"]
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "_mix_"]
    assert set(kept(mixing.repeat(mixed), docs)) <= {"1", "2", "3", "4", "None"}


def test_a_text_is_one_whatever_the_size_of_parts(monkeypatch):
    text = "--Ärger, 42 the CAT?! " * 400 + "x" * 500 + " ΑΣ " + "1" * 300 + "end"
    whole = {n: np.sort(langid.hashed_grams(text, langid.Grams(n, 12))) for n in (1, 2, 3, 5)}
    for part in (1, 2, 3, 7, 64, 1000):
        monkeypatch.setattr(langid, "PART", part)
        for n, want in whole.items():
            assert (np.sort(langid.hashed_grams(text, langid.Grams(n, 12))) == want).all()
    assert len(langid.hashed_grams("12 !!", langid.Grams())) == 0


def test_many_blocks_of_items(spark):
    items = [(k, f"item{k} has five words{k} here") for k in range(40)]
    docs = [(k, f"before item{k} has five words{k} here after") for k in range(0, 40, 3)] + [(100, "nothing")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.contaminated(d, b).collect()))
    assert sorted(map(tuple, decontaminate.contaminated(d, b, block_chars=100).collect())) == one and len(one) == 14
    assert [r.doc_id for r in decontaminate.clean(d, b, block_chars=100).collect()] == [100]
