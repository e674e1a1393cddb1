"""Token counts, token files, shards and mixing against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loadlens.llm import mixing, sharding, token_counts, token_planes

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b\n\n c \x1c d!\x1c!  x  ", "", None, "   ", " a", "don't 's  'll x's", "é　ü 漢字 \U0001f600 x\ty z", "x" * 5000, "1 2 3 " * 20_000]


def plain_count(word, scores):
    """Fewest pieces of the best segmentation by ordinary dynamic programming."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            score = scores.get(word[start:end])
            if score is not None:
                new = (best[start][0] + score, best[start][1] + 1)
                if new[0] > best[end][0] or (new[0] == best[end][0] and new[1] < best[end][1]):
                    best[end] = new
    return best[-1][1]


def test_trie_counts(spark, monkeypatch):
    scores = token_counts.zipf_scores(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert math.fsum(map(math.exp, scores.values())) == pytest.approx(1)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()] + ODD
    counter = token_counts.Counter(scores, public_tokenizers.PATTERN)
    got = list(counter.count(texts))
    for text, (n_words, n_tokens) in zip(texts, got):
        parts = counter.split(text) if text else []
        known = Counter(parts)
        if max(map(len, parts), default=0) < 200:
            want = sum(n * plain_count(w.encode().decode("latin-1"), scores) for w, n in known.items())
            assert (n_words, n_tokens) == (len(parts), want)
    # A trie that is dropped now and then gives the same counts.
    monkeypatch.setattr(token_counts, "MOST_NODES", 50)
    assert list(token_counts.Counter(scores, public_tokenizers.PATTERN).count(texts)) == got


def test_count_tokens_columns(spark):
    table = spark.createDataFrame([(1, "a b", "n"), (1, "a b", "n"), (None, None, None)], "doc_id long, text string, n_tokens string")
    found = token_counts.count_tokens(table, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert found.columns == [*table.columns, "_tokens"]
    assert sorted(r._tokens.n_tokens for r in found.collect()) == [0, 2, 2]
    assert token_counts.count_tokens(table.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_encoder_equals_whole_text_encoding(spark):
    plain = Tokenizer.from_file(TOKENIZER)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect()] + ["x<|endoftext|> y <|endoftext|>"]
    for text, ids in zip(texts, token_planes.Encoder(TOKENIZER, most=100).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_encoder_cuts_change_nothing(monkeypatch):
    parts = [*" \n\r\t.,-'\"($_", "  ", "\n\n", "\x85", "\xa0", "\u2003", "\u3000", "\x1c", "\u200b", "'s", "'ll", "a", "Zb", "é", "×", "÷", "ɏ", "ɐ", "ж", "中", "٣", "²", "3", "<|", "|>", "<|endoftext|>", "😀", "\u0301", "½"]
    draw = random.Random(5)
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(4000)] + [None, "", "x" * 300, ""]
    plain = Tokenizer.from_file(TOKENIZER)
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for window in (1, 7, 64, 4 << 20):
        monkeypatch.setattr(token_planes, "WINDOW", window)
        assert list(token_planes.Encoder(TOKENIZER, most=500).encode(texts)) == want
        assert list(token_planes.Encoder(TOKENIZER).encode(pa.array(texts)[5:90])) == want[5:90]
    assert list(token_planes.Encoder(TOKENIZER).encode([None, ""])) == [b"", b""] and not list(token_planes.Encoder(TOKENIZER).encode([]))


def test_encoder_looks_a_piece_up_once_a_window():
    tool, asked = token_planes.Encoder(TOKENIZER), []
    look_up = tool.look_up
    tool.look_up = lambda pieces: asked.append(len(pieces)) or look_up(pieces)
    assert len(list(tool.encode(pa.array(["The cat (sat).\nThe cat sat!"] * 20_000)))) == 20_000
    assert len(asked) == 1 and asked[0] < 12


def test_encoder_keeps_few_pieces():
    tool = token_planes.Encoder(TOKENIZER)
    for at in range(0, 850_000, 50_000):
        texts = [" ".join("".join(chr(97 + int(c)) for c in str(k)) for k in range(i, i + 1000)) for i in range(at, at + 50_000, 1000)]
        assert len(list(tool.encode(texts))) == 50
    assert len(tool.known) + len(tool.elder) < 450_000


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    for sample in (ids, ids % 50_000, ids * 0):
        assert (token_planes.from_planes(token_planes.to_planes(sample, kind), n, kind) == sample).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip_and_chunk_index(kind):
    docs = [(5, [1, 2, 3]), (None, []), (7, list(range(100))), (7, [50_000])]
    out = pa.BufferOutputStream()
    writer = token_planes.PlaneWriter(out, kind, block=16)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    writer.close()
    reader = token_planes.PlaneReader(pa.BufferReader(out.getvalue()))
    assert [(d, np.frombuffer(b, "<u4").tolist()) for d, b in reader.documents()] == docs
    flat = [i for _, ids in docs for i in ids]
    chunks = reader.footer["chunks"]
    assert sum(c[1] for c in chunks) == len(flat)
    last = sum(c[1] for c in chunks[:-1])
    assert reader.ids(len(chunks) - 1).tolist() == flat[last:]


def test_token_files(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(6, "again"), (6, "again"), (None, "no id")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("start", F.lit(1))
    written = token_planes.write_tokens(table.repartition(3), TOKENIZER)
    got = token_planes.digest(written.documents()).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    ids = [(d, plain.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    crc = {}
    for d, x in ids:
        crc.setdefault(d, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in ordered:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in crc[r.doc_id]
        start += r.n_tokens
    nothing = token_planes.write_tokens(table.limit(0), TOKENIZER)
    assert nothing.documents().count() == 0


def test_shards_fit_and_split_only_where_needed(spark):
    rows = [(i, "x" * (i % 97)) for i in range(3000)] + [(5000, "y" * 9000), (None, "abc"), (None, None), (1, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("depth", F.lit("clash"))
    got = sharding.shards(table, limit=4000).toPandas()
    assert len(got) == len(rows)
    bits = [int(hashlib.md5(("" if math.isnan(d) else str(int(d))).encode()).hexdigest()[:15], 16) for d in got.doc_id]
    assert all(b >> (60 - int(d)) == p for b, d, p in zip(bits, got.depth, got.prefix))
    sizes = got.groupby(["depth", "prefix", "page"]).n_bytes.agg(["sum", "count"])
    assert ((sizes["sum"] <= 4000) | (sizes["count"] == 1)).all()
    got["address"] = bits
    for (depth, prefix), _ in got.groupby(["depth", "prefix"]):
        if depth:  # the bucket above was too large
            above = got[[b >> (61 - int(depth)) == int(prefix) >> 1 for b in got.address]]
            assert above.n_bytes.sum() > 4000 and above.address.nunique() > 1
    assert sharding.shards(table.limit(0)).count() == 0


def test_one_key_with_most_bytes_gets_pages(spark):
    rows = [(7, "z" * 90)] * 400 + [(i, "a" * 50) for i in range(100)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=1000).toPandas()
    hot = got[got.doc_id == 7]
    assert len(got) == 500 and hot.page.nunique() == 36
    assert (got.groupby(["depth", "prefix", "page"]).n_bytes.transform("sum") == got.shard_bytes).all()
    assert hot.shard_bytes.max() < 1000 + 90


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing, stopping and sharing the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(sizes)
    total = share * sum(sizes.values())
    while open_:
        rest = total - sum(target.values())
        per = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if per * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: per * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix(spark):
    draw = np.random.default_rng(5)
    rows = [(i, "w " * int(draw.integers(0, 40)), draw.choice(["a", "b", "c", "d", None], p=[0.4, 0.3, 0.2, 0.05, 0.05])) for i in range(2000)]
    rows += [(9000, None, "a"), (9001, "", "only empty"), (None, "x y", "b"), (3, "x y z", "b"), (3, "x y z", "b")]
    table = spark.createDataFrame([(i, t, str(s) if s is not None and s != "None" else None) for i, t, s in rows], "doc_id long, text string, source string")
    table = table.withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))
    mixed = mixing.mix(table)
    assert mixed.columns == [*table.columns, "_mix"]
    got = mixed.select("doc_id", "source", "_mix.*").toPandas()
    assert len(got) == len(rows) and (got.taken == got.copies * got["size"]).all() and got.copies.between(0, 2).all()
    key = got.source.where(got.source.notna(), None).tolist()
    sizes = {}
    for s, n in zip(key, got["size"]):
        sizes[s] = sizes.get(s, 0) + int(n)
    want = plain_targets(sizes)
    for s in sizes:
        part = got[[k == s for k in key]]
        assert part.target.iloc[0] == pytest.approx(want[s]) and (part.source_size == sizes[s]).all()
        assert abs(part.taken.sum() - want[s]) <= 40
    again = mixing.mix(table.repartition(7)).select("doc_id", "source", "_mix.*").toPandas()
    order = ["doc_id", "source", "size", "copies"]
    assert again.sort_values(order).reset_index(drop=True).equals(got.sort_values(order).reset_index(drop=True))
    repeated = mixing.repeat(mixed)
    assert repeated.columns == table.columns and repeated.count() == got.copies.sum()
    assert mixing.mix(table.limit(0)).count() == 0
    assert mixing.mix(table.where("doc_id = 9001")).select("_mix.taken").first()[0] == 0


def test_tilt_prefers_marked_rows(spark):
    rows = [(i, "w w w", "a" if i < 600 else "b") for i in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    even = F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0)
    got = mixing.mix(table, weights=(1, 3), share=0.8, tilt=even).select("doc_id", "source", "_mix.*").toPandas()
    part = got[got.source == "a"]
    assert part[part.doc_id % 2 == 0].taken.sum() > 1.5 * part[part.doc_id % 2 == 1].taken.sum()
    assert abs(part.taken.sum() - part.target.iloc[0]) <= 3


def test_trie_looks_no_further_than_pieces_reach():
    """Of a word's parts only those are looked up that end some piece, and counts are those of all segmentations."""
    import random

    from loadlens.llm.token_counts import Trie

    draw = random.Random(8)
    scores = {c: -5.0 - i for i, c in enumerate("abcd")} | {"ab": -4.0, "abc": -9.0, "bcd": -9.0, "d" * 40: -3.0, "ca": -10.0}

    def best(word):
        found = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            ways = [(found[j][0] + scores[word[j:i]], found[j][1] - 1) for j in range(i) if word[j:i] in scores]
            found.append(max(ways))
        return -found[-1][1]

    class Counted(dict):
        looked = 0

        def get(self, key):
            Counted.looked += 1
            return dict.get(self, key)

    trie = Trie(scores)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randrange(1, 60))) for _ in range(200)] + ["d" * 90]
    assert [trie.count(w) for w in words] == [best(w) for w in words]
    trie = Trie(scores)
    trie.ends = Counted(trie.ends)
    trie.count("abc" * 100)
    assert Counted.looked <= 300 * 4
