"""Quality rules and common lines against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loadlens.llm import line_quality as lq

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    words = WORD.findall(text or "")
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def plain_normal(line):
    return " ".join(WORD.findall("".join(c.lower() if c.isascii() else c for c in line)))


def plain_lost(rows, most, share):
    """Words in common lines of each (host, text)."""
    texts = {(h, t or "") for _, t, h in rows}
    lines = {key: [plain_normal(x) for x in key[1].split("\n") if WORD.search(x)] for key in texts}
    lost = {}
    for host in {h for h, _ in texts}:
        mine = {k: set(v) for k, v in lines.items() if k[0] == host and v}
        counts = {}
        for v in mine.values():
            for x in v:
                counts[x] = counts.get(x, 0) + 1
        common = {x for x, n in counts.items() if n > most and n > share * len(mine)}
        for k in mine:
            lost[k] = sum(len(x.split(" ")) for x in lines[k] if x in common)
    return lost


def odd_rows():
    draw = random.Random(15)
    words = ["a", "b", "Æ", "#x", "<c>", "d*", "e f", "g"]
    shared = ["Read  more", "read more\t", "ALL rights Reserved.", "x"]
    rows = []
    for i in range(150):
        lines = [draw.choice([" ", "\t", "\v", "  "]).join(draw.choice(words) for _ in range(draw.randrange(0, 14))) for _ in range(draw.randrange(0, 9))]
        for _ in range(draw.randrange(3)):
            lines.insert(draw.randrange(len(lines) + 1), draw.choice(shared))
        rows.append((i, draw.choice(["\n", "\n\n", "\r\n"]).join(lines), draw.choice(["h1", "h2", None, ""])))
    rows += [(200, None, "h1"), (201, "", "h1"), (None, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (3, rows[5][1], "h9")]
    rows += [(300 + i, "boilerplate line\nown " + "w " * 60, "h1") for i in range(40)]  # copies: one text
    return rows


@pytest.mark.parametrize("limit", [None, "20"])
def test_against_plain_python(spark, monkeypatch, limit):
    from loadlens.functions import joins

    rows = odd_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    table = table.withColumns({c: F.lit("x") for c in ("_row", "_quality", "_host", "h", "n_words", "_counts")})
    if limit:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        spark.conf.set("spark.loadlens.groupLimit", limit)
    try:
        judged, name = lq.judged(table, most_docs=4, share=0.05, least_words=3)
        assert judged.columns == [*table.columns, name] and name not in table.columns
        got = sorted((str(r.doc_id), r.text or "", str(r.source), tuple(r[name])) for r in judged.collect())
    finally:
        spark.conf.unset("spark.loadlens.groupLimit")
    lost = plain_lost(rows, 4, 0.05)
    want = []
    for i, text, host in rows:
        found = plain_rules(text)
        n, gone = found[0], lost.get((host, text or ""), 0)
        failed = n < 50 or found[4] * 100 > n * 50
        kept = not failed and n - gone >= 3 and n - gone >= n * 0.5
        want.append((str(i), text or "", str(host), (*found, gone, failed, kept)))
    assert got == sorted(want)
    assert any(w[3][5] for w in want) and any(w[3][7] for w in want)


def test_common_lines_are_taken_out(spark):
    rows = [(i, f"Menu  Home\nown words {i}\nmenu home", "h", "x") for i in range(12)]
    rows += [(20, "menu home\nother host", "g", "x"), (21, None, "h", "x"), (22, "Menu  Home", "h", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, _row string")
    got = lq.without_common_lines(table, most_docs=5, share=0.1)
    assert got.columns == table.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[3] == "own words 3" and texts[20] == "menu home\nother host" and texts[21] is None and texts[22] == ""
    assert len(texts) == len(rows)


def test_copies_count_once_and_depleted_texts_go(spark):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, "the same copy\n" + "word " * 5 + own(0, 60), "h") for i in range(50)]
    rows += [(100 + i, "common footer line of this site\n" + own(i, 60 if i % 2 else 20) + "\n" + "many common words here " * 8, "h") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in lq.keep_good(table).collect()}
    # Fifty copies are one text, so their lines are not common.
    assert kept >= set(range(50))
    assert lq.keep_good(table.limit(0)).count() == 0
    assert lq.keep_good(table).columns == table.columns


def test_no_python_and_long_texts(spark, plan):
    long = " ".join(f"w{k % 5000}" for k in range(300_000))
    table = spark.createDataFrame([(1, long, "h")], "doc_id long, text string, source string")
    judged, name = lq.judged(table)
    assert not re.search("Python|Pandas|Arrow", plan(judged))
    row = judged.first()[name]
    assert (row.n_words, row.n_repeat_words) == (300_000, 300_000) and row.base_failed
